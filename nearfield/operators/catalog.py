"""List projections over parents and children: sections, counts, tags, labels, ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.scalars import hit_label


def top_joined(rows: DataFrame, key: str, text: str, score: str, k: int, out: str = "tags") -> DataFrame:
    """By key, its k best texts by score (ties by text) joined by ', '.  Ranks are limited before texts are gathered."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), text))
    best = rows.where(F.col(score).isNotNull()).withColumn("_r", rank).where(F.col("_r") <= k)
    return best.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(text).alias("_t")))), lambda s: s["_t"]), ", ").alias(out))


def names_joined(rows: DataFrame, key: str, name: str, out: str = "names") -> DataFrame:
    """By key, its names in order, case aside, joined by ', '."""
    ordered = F.array_sort(F.collect_list(F.struct(F.lower(name).alias("l"), F.col(name).alias("n"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["n"]), ", ").alias(out))


def score_map(rows: DataFrame, key: str, name: str, score: str, out: str = "class_scores") -> DataFrame:
    """By key, name -> score; of a name's several scores the greatest."""
    one = rows.where(F.col(name).isNotNull() & F.col(score).isNotNull()).groupBy(key, name).agg(F.max(score).alias("_s"))
    return one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(name), F.col("_s")))).alias(out))


def child_counts(children: DataFrame, parent: str, window: Column, flagged: Column) -> DataFrame:
    """By parent: children that aren't windows, and flagged ones, in one pass."""
    return children.groupBy(parent).agg(F.count_if(~window).alias("segment_count"), F.count_if(flagged).alias("flagged"))


def sections(children: DataFrame, parent: str, start: str, columns: list[str], out: str = "sections") -> DataFrame:
    """By parent, its children in order of start, as an array of structs."""
    return children.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct(start, *(c for c in columns if c != start)))).alias(out))


def usage(names: DataFrame, uses: DataFrame, key: str, used: str) -> DataFrame:
    """All names with how often they are used, 0 included."""
    n = uses.groupBy(F.col(used).alias("_u")).agg(F.count("*").alias("n"))
    return names.join(n, F.col(key) == F.col("_u"), "left").drop("_u").withColumn("n", F.coalesce("n", F.lit(0)))


def listed(samples: DataFrame, *, classes: DataFrame, analysis: DataFrame, tags: DataFrame, counts: DataFrame, key: str = "id") -> DataFrame:
    """Samples with what is known of them; each part is aggregated by sample before it is joined."""
    out = samples
    for part in (classes, analysis, tags, counts):
        out = out.join(part, key, "left")
    return out.withColumns({"tags": F.coalesce("tags", F.lit("")), "segment_count": F.coalesce("segment_count", F.lit(0)), "flagged": F.coalesce("flagged", F.lit(0))})


def item_labels(samples: DataFrame, segments: DataFrame) -> DataFrame:
    """(kind, id, label): a sample's name; a segment's label in its sample's name."""
    own = samples.select(F.lit("sample").alias("kind"), "id", F.col("filename").alias("label"))
    names = samples.select(F.col("id").alias("sample_id"), "filename")
    hits = segments.join(names, "sample_id").select(F.lit("segment").alias("kind"), "id", F.concat(hit_label(F.col("start_ms"), F.col("end_ms"), F.col("detection_method") == "window"), F.lit(" in "), F.col("filename")).alias("label"))
    return own.unionByName(hits)


def child_type(window: Column, manual: Column) -> Column:
    return F.when(window, F.lit("window")).when(manual, F.lit("manual")).otherwise(F.lit("hit"))


def latest_by_id(rows: DataFrame, key: str, id_: str, text: str, out: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(text, id_).alias(out))


# Order


def list_order(*, score: str = "score", anchor: Column | None = None, ties: list[str]) -> list[Column]:
    """The anchor, then falling scores, missing ones last, then the ties."""
    first = [anchor.desc()] if anchor is not None else []
    return [*first, F.coalesce(F.col(score), F.lit(-1.0)).desc(), *(F.col(t).asc_nulls_first() for t in ties)]


def ranked_within(rows: DataFrame, parent: str, score: str, start: str, id_: str) -> DataFrame:
    """Children's places in their parent: falling score, missing as -1, then start, then id."""
    w = Window.partitionBy(parent).orderBy(F.coalesce(F.col(score), F.lit(-1.0)).desc(), start, id_)
    return rows.withColumn("place", F.row_number().over(w))


def worklist_order(rows: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Rows with `position` from a list of keys; those not in it come last (a number beyond all positions)."""
    return rows.join(order.select(key, "position"), key, "left").withColumn("position", F.coalesce("position", F.lit(2**31 - 1)))


def suggestions(tags: DataFrame, curated: DataFrame, key: str, tag: str, score: str, k: int = 6) -> DataFrame:
    """By key, the k best tags that aren't curated already, case aside."""
    used = curated.select(key, F.lower(tag).alias("_l")).distinct()
    fresh = tags.withColumn("_l", F.lower(tag)).join(used, [key, "_l"], "left_anti").drop("_l")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tag))
    return fresh.withColumn("place", rank).where(F.col("place") <= k)


def first_positions(rows: DataFrame, key: list[str], position: str) -> DataFrame:
    """Each key once, with its first position."""
    return rows.groupBy(*key).agg(F.min(position).alias(position))


def overlaid(rows: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Rows with `changed` ones in their place; changes of unknown keys are ignored."""
    known = changed.join(rows.select(key), key, "left_semi")
    return rows.join(known.select(key), key, "left_anti").unionByName(known.select(*rows.columns))


def staged(rows: DataFrame, edits: DataFrame, drafts: DataFrame) -> DataFrame:
    """Intervals (id, start, end) under edits by id, and drafts with negative ids; `edited` is false where an edit changes nothing."""
    e = edits.select("id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    out = rows.select("id", "start", "end").join(e, "id", "left")
    changed = F.coalesce((F.col("_s") != F.col("start")) | (F.col("_e") != F.col("end")), F.lit(False))
    out = out.select("id", F.coalesce("_s", "start").alias("start"), F.coalesce("_e", "end").alias("end"), changed.alias("edited"))
    return out.unionByName(drafts.select("id", "start", "end", F.lit(True).alias("edited")))
