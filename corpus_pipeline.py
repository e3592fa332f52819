"""From documents to token ids: classifier, line dedup, near-duplicate join, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it
as Parquet to the shared folder and reads it back as the next stage's docs.  All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import bpe, jaccard, linededup, mixing, quality
from nearfield.llm._io import dropped, stored, table

#: The mixture takes this share of the tokens that reach it, by the weights below.
MIX_PERCENT = 60


def _free(name: str, taken: list[str]) -> str:
    """The name, or one with further marks that no column has."""
    return name if name not in taken else _free(name + "_", taken)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the rated ones, doesn't reject."""
    model = quality.fit_rated(docs, quality.grades(table(spark, sf_dir, "labels")), n_grades=quality.N_GRADES)
    names = tuple(_free(n, docs.columns) for n in ("_expected", "_tail"))
    return quality.scored(docs, model, names=names).where(F.col(names[1]) >= quality.MIN_TAIL).drop(*names)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; documents with no line left go too."""
    return linededup.without_later_copies(docs, drop_emptied=True)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its 5-word shingles."""
    return jaccard.representatives(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A seeded share of the tokens, by domain, language and source weights."""
    levels = {"_domain": mixing.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    weights = {"_domain": mixing.DOMAIN_WEIGHTS, "lang": mixing.LANG_WEIGHTS}
    return mixing.mixed(docs, levels, weights, percent=MIX_PERCENT).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to."""
    return bpe.encode(docs, keep=("doc_id", "lang", "source"), tokens=True, digests=True)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_near),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL can express neither the classifier's fit nor the encoding; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, last = stored(stage(spark, docs, sf_dir)), before
        # a stage's output goes once the next one is written
        if last is not None:
            dropped(last)
        before = docs
    return docs
