"""Schemas of the stored entities, and the rules their rows obey."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Version of the stored layout; each version's step is in state.STEPS.
VERSION = 3

_SCALARS = ["peak_db", "rms_db", "crest_factor", "attack_ms", "decay_ms", "f0_hz", "pitch_confidence", "harmonic_ratio", "spectral_centroid", "spectral_bandwidth", "spectral_rolloff", "spectral_flatness"]
_LISTS = {"mfcc_mean": 13, "mfcc_var": 13, "spectral_contrast": 7}
#: Descriptors that a file and a segment share; both schemas are made from them.
DESCRIPTORS = [*(T.StructField(n, T.DoubleType()) for n in _SCALARS), *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in _LISTS), T.StructField("onset_count", T.IntegerType())]
LIST_WIDTHS = dict(_LISTS)


_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<float>": T.ArrayType(T.FloatType()), "map<string;double>": T.MapType(T.StringType(), T.DoubleType())}


def _struct(spec: str) -> T.StructType:
    """A schema of 'name type [not null], ..', made without a session."""
    fields = (x.split(" ") for x in spec.split(", "))
    return T.StructType([T.StructField(f[0], _TYPES[f[1]], len(f) == 2) for f in fields])


SAMPLES = _struct("id bigint not-null, filepath string not-null, filename string, folder string, duration_s double, sample_rate int, channels int, added_at timestamp, last_scanned_at timestamp, file_size bigint, file_mtime double, file_hash string, content_changed_at timestamp, segment_candidates_found int, segments_capped boolean, effective_sensitivity double, segments_detected_at timestamp")
ANALYSIS = T.StructType([T.StructField("sample_id", T.LongType(), False), T.StructField("analyzed_at", T.TimestampType()), T.StructField("tempo_bpm", T.DoubleType()), T.StructField("tempo_confidence", T.DoubleType()), T.StructField("is_loop", T.BooleanType()), T.StructField("key", T.StringType()), *DESCRIPTORS])
SEGMENT_ANALYSIS = T.StructType([T.StructField("segment_id", T.LongType(), False), *DESCRIPTORS])
CLASSIFICATION = _struct("sample_id bigint not-null, content_class string, structural_type string, confidence double, provenance string, source_model string, content_class_confirmed boolean, structural_type_confirmed boolean, is_user_confirmed boolean")
SEGMENTS = _struct("id bigint not-null, sample_id bigint not-null, start_ms bigint not-null, end_ms bigint not-null, detection_method string, is_user_confirmed boolean, strength double, detected_at timestamp, needs_review boolean, cache_path string, cache_rendered_at timestamp")
EMBEDDING = _struct("sample_id bigint not-null, model_name string not-null, vector array<float>, embedded_at timestamp")
SEGMENT_EMBEDDING = _struct("segment_id bigint not-null, model_name string not-null, vector array<float>")
TEXT_TAGS = _struct("id bigint not-null, sample_id bigint, tag_or_caption string, source_model string, score double, is_user_confirmed boolean, created_at timestamp")
TAGS = _struct("id bigint not-null, name string")
SAMPLE_TAGS = _struct("sample_id bigint, tag_id bigint, added_at timestamp")
SEGMENT_CLASSIFICATION = _struct("segment_id bigint not-null, content_class string, structural_type string, confidence double, is_user_confirmed boolean")
MAP_LAYOUT = _struct("id bigint not-null, computed_at timestamp, scope_description string, weights map<string;double>, seed bigint, is_current boolean, reducer string, model_path string")
MAP_POSITION = _struct("layout_id bigint, sample_id bigint, segment_id bigint, map_x double, map_y double")
LIBRARIES = _struct("id bigint not-null, path string, is_root boolean, in_scope boolean, added_at timestamp, last_scanned_at timestamp")

TABLES = {"samples": SAMPLES, "analysis": ANALYSIS, "classification": CLASSIFICATION, "segments": SEGMENTS, "segment_analysis": SEGMENT_ANALYSIS, "embedding": EMBEDDING, "segment_embedding": SEGMENT_EMBEDDING, "text_tags": TEXT_TAGS, "tags": TAGS, "sample_tags": SAMPLE_TAGS, "segment_classification": SEGMENT_CLASSIFICATION, "map_layout": MAP_LAYOUT, "map_position": MAP_POSITION, "libraries": LIBRARIES}


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has; none in a sound table."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of `child` without a parent; none in a sound table."""
    return child.join(parent.select(F.col(parent_key).alias("_key")), F.col(child_key) == F.col("_key"), "left_anti")


def cascade(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of `child` that survive when only `parent` is left."""
    return child.join(parent.select(F.col(parent_key).alias("_key")), F.col(child_key) == F.col("_key"), "left_semi")


def differences(df: DataFrame, wanted: T.StructType) -> dict[str, list[str]]:
    """How a stored table's columns differ from a schema: missing, extra, changed."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in wanted}
    return {"missing": sorted(want.keys() - have.keys()), "extra": sorted(have.keys() - want.keys()), "changed": sorted(n for n in have.keys() & want.keys() if have[n] != want[n])}


def conformed(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """`df` in a schema's columns and types; what it lacks is null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))
