"""Staleness, worklists, protected corrections, tags, and stored layouts, as functions from tables to tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.scalars import normalised_tag

# Staleness: a comparison with a missing stamp is not stale.


def analysis_due(stamp: Column, changed: Column) -> Column:
    """Never done, or changed since."""
    return stamp.isNull() | F.coalesce(changed > stamp, F.lit(False))


def segments_due(stamp: Column, changed: Column) -> Column:
    """Needs a visit; the same test, on the segments' own stamp."""
    return analysis_due(stamp, changed)


def segments_stale(stamp: Column, changed: Column) -> Column:
    """Done, but changed since: only then hand-made segments are refreshed."""
    return F.coalesce(changed > stamp, F.lit(False))


def embeddings_due(samples: DataFrame, vectors: DataFrame, segments: DataFrame, segment_vectors: DataFrame) -> DataFrame:
    """samples (id, changed, windows_wanted) with three flags: its own vector is stale, it lacks windows, it has segments without a vector; rows with none are left out."""
    own = vectors.select(F.col("sample_id").alias("id"), "embedded_at")
    windows = segments.where("detection_method = 'window'").select(F.col("sample_id").alias("id")).distinct().withColumn("_w", F.lit(True))
    orphans = segments.join(segment_vectors.select(F.col("segment_id").alias("_s")), F.col("id") == F.col("_s"), "left_anti").select(F.col("sample_id").alias("id")).distinct().withColumn("_o", F.lit(True))
    out = samples.join(own, "id", "left").join(windows, "id", "left").join(orphans, "id", "left")
    out = out.withColumns({"stale": analysis_due(F.col("embedded_at"), F.col("changed")), "lacks_windows": F.col("windows_wanted") & F.col("_w").isNull(), "has_orphans": F.col("_o").isNotNull()})
    return out.where("stale or lacks_windows or has_orphans").select("id", "stale", "lacks_windows", "has_orphans")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_key).alias("_k")), F.col(child_key) == F.col("_k"), "left_anti")


# Corrections


def corrected(rows: DataFrame, key: str, facet: str, found: DataFrame) -> DataFrame:
    """rows (key, facet, confirmed) with facet from `found`, except where a user confirmed it."""
    new = found.select(key, F.col(facet).alias("_new"))
    out = rows.join(new, key, "left")
    value = F.when(F.col("confirmed"), F.col(facet)).otherwise(F.coalesce("_new", facet))
    return out.withColumn(facet, value).drop("_new")


def set_by_user(rows: DataFrame, key: str, ids: list[int], facet: str, value: str) -> DataFrame:
    """A user's value: confirmed, and of manual provenance."""
    mine = F.col(key).isin(ids) if ids else F.lit(False)
    return rows.withColumns({facet: F.when(mine, F.lit(value)).otherwise(F.col(facet)), "confirmed": F.col("confirmed") | mine, "provenance": F.when(mine, F.lit("manual")).otherwise(F.col("provenance"))})


def reset_class(scores: DataFrame, key: str, classes: list[str], threshold: float = 0.5) -> DataFrame:
    """(key, class, confidence): the best stored class, the first in order of equals; no class below the threshold."""
    order = F.array_position(F.array(*map(F.lit, classes)), F.col("class"))
    best = scores.where(order > 0).groupBy(key).agg(F.max(F.struct("score", (-order).alias("o"), "class")).alias("m"))
    return best.select(key, F.when(F.col("m.score") >= threshold, F.col("m.class")).alias("class"), F.col("m.score").alias("confidence"))


def tags_added(tags: DataFrame, uses: DataFrame, key: str, item: int, name: str) -> tuple[DataFrame, DataFrame]:
    """A tag on an item: case aside the stored tag is used, in its first spelling; else the next id is given."""
    spark = tags.sparkSession
    name = spark.range(1).select(normalised_tag(F.lit(name))).first()[0]
    if name is None:
        raise ValueError("a tag needs a name")
    row = tags.where(F.lower("name") == name.lower()).agg(F.min("id")).first()[0]
    if row is None:
        row = (tags.agg(F.max("id")).first()[0] or 0) + 1
        tags = tags.unionByName(spark.createDataFrame([(row, name)], "id long, name string"))
    use = spark.createDataFrame([(item, row)], f"{key} long, tag_id long")
    return tags, uses.unionByName(use).distinct()


def tags_removed(tags: DataFrame, uses: DataFrame, key: str, item: int, name: str) -> tuple[DataFrame, DataFrame]:
    """A tag off an item; tags that no item carries disappear."""
    gone = tags.where(F.lower("name") == name.lower()).select(F.col("id").alias("tag_id"))
    uses = uses.join(gone.withColumn(key, F.lit(item).cast("long")), [key, "tag_id"], "left_anti")
    return pruned(tags, uses), uses


def pruned(tags: DataFrame, uses: DataFrame) -> DataFrame:
    return tags.join(uses.select(F.col("tag_id").alias("_t")), F.col("id") == F.col("_t"), "left_semi")


# Segments

#: Parents whose counts are summed in one task.
_RANGE = 4096


def replaced_segments(stored: DataFrame, found: DataFrame, parents: list[int] | None, next_id: int) -> DataFrame:
    """Automatic, unconfirmed segments of the parents give way to new ones; those of no length, or equal to one that stays, are left out."""
    mine = F.lit(True) if parents is None else F.col("sample_id").isin(parents) if parents else F.lit(False)
    stay = stored.where(~(mine & (F.col("detection_method") == "auto") & ~F.col("is_user_confirmed")))
    keys = ["sample_id", "start_ms", "end_ms", "detection_method"]
    fresh = found.where("end_ms > start_ms").dropDuplicates(keys).join(stay.select(*keys), keys, "left_anti")
    # ids by rank within parents, parents by running count within ranges of _RANGE ids, and ranges by running count: one task sorts a row for each range alone
    per = fresh.groupBy("sample_id").agg(F.count("*").alias("_n")).withColumn("_g", F.floor(F.col("sample_id") / _RANGE))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = per.groupBy("_g").agg(F.sum("_n").alias("_n")).select("_g", before(Window.orderBy("_g")).alias("_f"))
    base = per.withColumn("_b", before(Window.partitionBy("_g").orderBy("sample_id"))).join(ranges, "_g").select("sample_id", (F.col("_f") + F.col("_b")).alias("_b"))
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy("start_ms", "end_ms"))
    fresh = fresh.withColumn("_r", rank).join(base, "sample_id").withColumn("id", F.lit(next_id - 1) + F.col("_b") + F.col("_r")).drop("_r", "_b")
    return stay.unionByName(fresh, allowMissingColumns=True)


def refreshed_manual(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """Hand-made segments of changed parents (sample_id, duration_ms): flagged if they don't lie in it any more, their render forgotten, bounds untouched."""
    out = segments.join(durations.select("sample_id", F.col("duration_ms").alias("_d")), "sample_id", "left")
    mine = F.col("_d").isNotNull() & (F.col("detection_method") == "manual")
    return out.withColumns({"needs_review": F.when(mine, (F.col("start_ms") >= F.col("_d")) | (F.col("end_ms") > F.col("_d"))).otherwise(F.col("needs_review")), "cache_path": F.when(~mine | F.col("_d").isNull(), F.col("cache_path"))}).drop("_d")


def edited_segment(segments: DataFrame, vectors: DataFrame, item: int, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """A moved segment is a user's: manual, confirmed, reviewed, without render or vector."""
    if end <= start:
        raise ValueError("a segment has a length")
    it = F.col("id") == item
    put = lambda c, v: F.when(it, F.lit(v)).otherwise(F.col(c))
    out = segments.withColumns({"start_ms": put("start_ms", start), "end_ms": put("end_ms", end), "detection_method": put("detection_method", "manual"), "is_user_confirmed": put("is_user_confirmed", True), "needs_review": put("needs_review", False), "cache_path": F.when(~it, F.col("cache_path"))})
    return out, vectors.where(F.col("segment_id") != item)


def added_segment(segments: DataFrame, parent: int, start: int, end: int, next_id: int) -> DataFrame:
    """A user's new segment: manual and confirmed, exempt from the rules of automatic ones."""
    if end <= start:
        raise ValueError("a segment has a length")
    new = segments.sparkSession.createDataFrame([(next_id, parent, start, end, "manual", True, False)], "id long, sample_id long, start_ms long, end_ms long, detection_method string, is_user_confirmed boolean, needs_review boolean")
    return segments.unionByName(new, allowMissingColumns=True)


def removed_segment(segments: DataFrame, vectors: DataFrame, item: int) -> tuple[DataFrame, DataFrame]:
    """A segment and its vector, taken away; windows of the encoder stay."""
    gone = segments.where((F.col("id") == item) & (F.col("detection_method") != "window")).select(F.col("id").alias("_g"))
    return segments.join(gone, F.col("id") == F.col("_g"), "left_anti"), vectors.join(gone, F.col("segment_id") == F.col("_g"), "left_anti")


def targets(current: int | None, selected: list[int], all_selected: bool) -> list[int]:
    """What a correction goes to: the selection if it is more than one and asked for, else the current item."""
    return selected if all_selected and len(selected) > 1 else [current] if current is not None else []


# Folders


def with_root(libraries: DataFrame, path: str) -> DataFrame:
    """One root at most: the folder named here."""
    return libraries.withColumn("is_root", F.col("path") == path)


def scope_paths(libraries: DataFrame) -> list[str] | None:
    """Folders in scope, in order; None where there are no folders at all, which is everything."""
    rows = libraries.select("path", "in_scope").orderBy("path").collect()
    return [r["path"] for r in rows if r["in_scope"]] if rows else None


def without_folder(libraries: DataFrame, samples: DataFrame, children: dict[str, tuple[DataFrame, str]], path: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """A folder, the samples under it, and all that hangs on these, taken away."""
    left = samples.where(~F.startswith("filepath", F.lit(path.rstrip("/") + "/")))
    keys = left.select(F.col("id").alias("_k"))
    return libraries.where(F.col("path") != path), left, {n: df.join(keys, F.col(k) == F.col("_k"), "left_semi") for n, (df, k) in children.items()}


# Layouts


def layout_added(layouts: DataFrame, new: DataFrame) -> DataFrame:
    """A new layout is the current one; old ones stay."""
    return layouts.withColumn("is_current", F.lit(False)).unionByName(new.withColumn("is_current", F.lit(True)), allowMissingColumns=True)


#: Steps from one stored version to the next, on a table's name and rows.
STEPS: dict[int, Callable[[str, DataFrame], DataFrame]] = {
    # a single confirmation becomes one for each facet, so nothing loses its protection
    2: lambda name, df: df.withColumns({"content_class_confirmed": F.coalesce("is_user_confirmed", F.lit(False)), "structural_type_confirmed": F.coalesce("is_user_confirmed", F.lit(False))}) if name == "classification" and "content_class_confirmed" not in df.columns else df,
    3: lambda name, df: df.withColumn("needs_review", F.lit(False)) if name == "segments" and "needs_review" not in df.columns else df,
}


def migrated(name: str, df: DataFrame, version: int, target: int) -> DataFrame:
    if version > target:
        raise ValueError(f"stored version {version} is newer than {target}")
    for step in range(version + 1, target + 1):
        df = STEPS[step](name, df) if step in STEPS else df
    return df


#: What each version added: a table and a column of it.
ADDED: dict[int, tuple[str, str]] = {2: ("classification", "content_class_confirmed"), 3: ("segments", "needs_review")}


def shape_version(tables: dict[str, DataFrame]) -> int:
    """The version of a store that carries no number: the last of those, in order, whose columns are there."""
    version = 1
    for number, (table, column) in sorted(ADDED.items()):
        if table not in tables or column not in tables[table].columns:
            break
        version = number
    return version
