"""Ranking orders (parents) and line items (children) against an anchor."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield import files, working
from nearfield.functions.scalars import ln_positive, log1p_nonnegative
from nearfield.io import Tables
from nearfield.operators import catalog, filters, index, similarity
from nearfield.plans._registry import query

AXES = similarity.Axes({"level": ["price", "amount"], "rate": ["discount", "tax"]})
WEIGHTS = {"level": 1.0, "rate": 0.5}


def children(t: Tables, tasks: int | None = None) -> DataFrame:
    """Line items with an id of their own: the order's number times 1000, and the place in it.  tasks: over how many they are dealt by order; else Spark's setting."""
    lines = t.lineitem if tasks is None else t.lineitem.hint("repartition", tasks, "l_orderkey")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    start = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    return lines.select((F.col("l_orderkey") * 1000 + place).alias("id"), F.col("l_orderkey").alias("parent"), (start / 1000000).cast("long").alias("start"), ((start / 1000000).cast("long") + F.col("l_quantity").cast("long")).alias("end"), (F.col("l_linestatus") == "O").alias("window"), ln_positive(F.col("l_extendedprice")).alias("price"), log1p_nonnegative(F.col("l_quantity")).alias("amount"), F.when(F.col("l_quantity") > 10, F.col("l_discount")).alias("discount"), F.when(F.col("l_quantity") > 10, F.col("l_tax")).alias("tax"))


def parents(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), ln_positive(F.col("o_totalprice")).alias("price"))


def items(t: Tables) -> DataFrame:
    return similarity.population(parents(t), children(t), AXES.features)


def sources(t: Tables) -> dict[str, index.Source]:
    """Orders and line items as parts of the population, by the versions of their files."""
    none = parents(t).where("false")
    only = lambda p, c: lambda: similarity.population(p, c, AXES.features)
    return {
        "orders": index.Source(files.version(t.spark, f"{t.folder}/orders.parquet"), only(parents(t), children(t).where("false"))),
        "lineitem": index.Source(files.version(t.spark, f"{t.folder}/lineitem.parquet"), only(none, children(t)), lambda tasks: similarity.population(none, children(t, tasks), AXES.features)),
    }


def kept_index(t: Tables) -> index.Index:
    """The index of a folder's tables in the working folder: made by the first ranking, refreshed when files have changed."""
    name = hashlib.blake2b(t.folder.encode(), digest_size=8).hexdigest()
    return index.Index(t.spark, f"{working.folder(t.spark)}/nearfield/index-{name}", AXES)


def ranker(t: Tables) -> similarity.Ranker:
    """What ranks the tables as they are now."""
    kept, now = kept_index(t), sources(t)
    kept.refresh(now)
    return kept.ranker(now)


def anchor(t: Tables) -> int:
    """The child of least id."""
    return t.lineitem.agg(F.min("l_orderkey")).first()[0] * 1000 + 1


_ITEMS = """
WITH c AS (
  SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, l_orderkey AS parent,
    CAST(epoch_us(l_shipdate) // 1000000 AS BIGINT) AS s, CAST(epoch_us(l_shipdate) // 1000000 AS BIGINT) + CAST(floor(l_quantity) AS BIGINT) AS e, l_linestatus = 'O' AS win,
    CASE WHEN l_extendedprice > 0 THEN ln(l_extendedprice) END AS price, CASE WHEN l_quantity >= 0 THEN ln(1 + l_quantity) END AS amount,
    CASE WHEN l_quantity > 10 THEN l_discount END AS discount, CASE WHEN l_quantity > 10 THEN l_tax END AS tax
  FROM lineitem),
items AS MATERIALIZED (
  SELECT 'sample' AS kind, o_orderkey AS id, o_orderkey AS parent, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e, FALSE AS win, CASE WHEN o_totalprice > 0 THEN ln(o_totalprice) END AS price, CAST(NULL AS DOUBLE) AS amount, CAST(NULL AS DOUBLE) AS discount, CAST(NULL AS DOUBLE) AS tax FROM orders
  UNION ALL SELECT 'segment', id, parent, s, e, win, price, amount, discount, tax FROM c),
med AS (SELECT median(price) AS m1, median(amount) AS m2, median(discount) AS m3, median(tax) AS m4 FROM items),
dev AS (SELECT median(abs(price - m1)) * 1.4826 AS s1, median(abs(amount - m2)) * 1.4826 AS s2, median(abs(discount - m3)) * 1.4826 AS s3, median(abs(tax - m4)) * 1.4826 AS s4 FROM items, med),
z AS MATERIALIZED (
  SELECT kind, id, parent, s, e, win,
    CASE WHEN price IS NOT NULL THEN greatest(-4, least(4, (price - m1) / CASE WHEN s1 > 1e-9 THEN s1 ELSE 1 END)) END AS z1,
    CASE WHEN amount IS NOT NULL THEN greatest(-4, least(4, (amount - m2) / CASE WHEN s2 > 1e-9 THEN s2 ELSE 1 END)) END AS z2,
    CASE WHEN discount IS NOT NULL THEN greatest(-4, least(4, (discount - m3) / CASE WHEN s3 > 1e-9 THEN s3 ELSE 1 END)) END AS z3,
    CASE WHEN tax IS NOT NULL THEN greatest(-4, least(4, (tax - m4) / CASE WHEN s4 > 1e-9 THEN s4 ELSE 1 END)) END AS z4
  FROM items, med, dev),
a AS (SELECT z1 AS a1, z2 AS a2, z3 AS a3, z4 AS a4 FROM z WHERE kind = 'segment' AND id = (SELECT min(l_orderkey) * 1000 + 1 FROM lineitem)),
raw AS (
  SELECT kind, id, parent, s, e, win,
    sqrt((coalesce(pow(z1 - a1, 2), 0) + coalesce(pow(z2 - a2, 2), 0)) / nullif((z1 - a1 IS NOT NULL)::INT + (z2 - a2 IS NOT NULL)::INT, 0)) AS r1,
    sqrt((coalesce(pow(z3 - a3, 2), 0) + coalesce(pow(z4 - a4, 2), 0)) / nullif((z3 - a3 IS NOT NULL)::INT + (z4 - a4 IS NOT NULL)::INT, 0)) AS r2
  FROM z, a),
p AS (SELECT quantile_cont(r1, 0.95) AS p1, quantile_cont(r2, 0.95) AS p2 FROM raw),
d AS MATERIALIZED (
  SELECT kind, id, parent, s, e, win,
    CASE WHEN r1 IS NOT NULL THEN CASE WHEN p1 > 0 THEN greatest(0, least(1, r1 / p1)) ELSE r1 END END AS d1,
    CASE WHEN r2 IS NOT NULL THEN CASE WHEN p2 > 0 THEN greatest(0, least(1, r2 / p2)) ELSE r2 END END AS d2
  FROM raw, p)
"""


def _folded(score: str, where: str = "TRUE") -> str:
    return f"""
, scored AS (SELECT *, {score} AS score FROM d WHERE {where}),
best AS (SELECT parent, max(CASE WHEN kind = 'sample' THEN score END) AS own, max(CASE WHEN kind = 'segment' THEN score END) AS top FROM scored GROUP BY parent),
hit AS (SELECT s.parent, min(s.id) AS id FROM scored s JOIN best b ON s.parent = b.parent AND s.kind = 'segment' AND s.score = b.top GROUP BY s.parent),
folded AS (
  SELECT b.parent AS sample_id, CASE WHEN own IS NULL OR top > own THEN top ELSE own END AS score, CASE WHEN top IS NOT NULL AND (own IS NULL OR top > own) THEN h.id END AS hit_id
  FROM best b LEFT JOIN hit h USING (parent) WHERE own IS NOT NULL OR top IS NOT NULL)
"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select("sample_id", F.round("score", 6).alias("score"), "hit_id")


_BLEND = "1 - (coalesce(d1 * 1.0, 0) + coalesce(d2 * 0.5, 0)) / nullif((CASE WHEN d1 IS NOT NULL THEN 1.0 ELSE 0 END) + (CASE WHEN d2 IS NOT NULL THEN 0.5 ELSE 0 END), 0)"
_SHOWN = "SELECT sample_id, round(score, 6) AS score, hit_id FROM folded"


@query("rank_fold", "G1 C5 C6 C17 H9 H10 D8 D9 D10 D11 D12 D13", _ITEMS + _folded(_BLEND) + _SHOWN)
def rank_fold(t: Tables) -> DataFrame:
    return _shown(ranker(t).ranked("segment", anchor(t), WEIGHTS))


@query("rank_top", "F2 F1 D13 E10", _ITEMS + _folded(_BLEND) + "SELECT sample_id, round(score, 6) AS score, hit_id FROM folded ORDER BY round(score, 6) DESC, sample_id LIMIT 20")
def rank_top(t: Tables) -> DataFrame:
    """The 20 nearest parents: a bounded heap in each partition, no full sort."""
    return rank_fold(t).orderBy(F.desc("score"), "sample_id").limit(20)


@query("rank_scoped", "C23 B3 D13", _ITEMS + _folded(_BLEND, "parent IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')") + _SHOWN)
def rank_scoped(t: Tables) -> DataFrame:
    scope = t.orders.join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_orderkey").alias("parent"))
    return _shown(ranker(t).ranked("segment", anchor(t), WEIGHTS, scope))


@query("rank_weights_partial", "D11", _ITEMS + _folded("1 - d1 / nullif(CASE WHEN d1 IS NOT NULL THEN 1.0 ELSE 0 END, 0)") + _SHOWN)
def rank_weights_partial(t: Tables) -> DataFrame:
    """A negative weight counts as none."""
    return _shown(ranker(t).ranked("segment", anchor(t), {"level": 1.0, "rate": -2.0}))


@query("rank_missing_axis", "D11 D13", _ITEMS + _folded("CASE WHEN d2 IS NOT NULL THEN 1 - d2 END") + _SHOWN)
def rank_missing_axis(t: Tables) -> DataFrame:
    """Only the rates count: parents without a child that has one are absent."""
    return _shown(ranker(t).ranked("segment", anchor(t), {"level": 0.0, "rate": 1.0}))


@query("axis_distances", "D15 M8", _ITEMS + "SELECT id, axis, round(distance, 6) AS distance FROM (SELECT id, 'level' AS axis, d1 AS distance FROM d WHERE kind = 'sample' UNION ALL SELECT id, 'rate', d2 FROM d WHERE kind = 'sample')")
def axis_distances(t: Tables) -> DataFrame:
    d = ranker(t).distances("segment", anchor(t)).where("kind = 'sample'")
    m = d.select("id", F.create_map(F.lit("level"), "d_level", F.lit("rate"), "d_rate").alias("m"))
    return m.select("id", F.explode("m").alias("axis", "distance")).withColumn("distance", F.round("distance", 6))


@query("range_filter", "B6 B8", _ITEMS + "SELECT id, round(d1, 6) AS d_level FROM d WHERE kind = 'segment' AND round(d1, 6) BETWEEN 0.1 AND 0.3 AND round(d2, 6) BETWEEN 0 AND 0.5")
def range_filter(t: Tables) -> DataFrame:
    d = ranker(t).distances("segment", anchor(t)).where("kind = 'segment'").withColumns({c: F.round(c, 6) for c in ("d_level", "d_rate")})
    return d.where(filters.Criteria(axis_ranges={"level": (0.1, 0.3), "rate": (0.0, 0.5)}).column()).select("id", "d_level")


@query("weighted_matrix_norm", "D31", _ITEMS + "SELECT kind, id, round(pow(coalesce(z1, 0), 2) * 1.0 / 2 + pow(coalesce(z2, 0), 2) * 1.0 / 2 + pow(coalesce(z3, 0), 2) * 0.5 / 2 + pow(coalesce(z4, 0), 2) * 0.5 / 2, 6) AS squares FROM z")
def weighted_matrix_norm(t: Tables) -> DataFrame:
    r = ranker(t)
    return r.z.select("kind", "id", F.round(similarity.weighted_squares(r.axes, WEIGHTS), 6).alias("squares"))


@query("standardised", "D8", _ITEMS + "SELECT kind, id, round(z1, 6) AS price, round(z2, 6) AS amount, round(z3, 6) AS discount, round(z4, 6) AS tax FROM z")
def standardised(t: Tables) -> DataFrame:
    return ranker(t).z.select("kind", "id", *(F.round(c, 6).alias(c) for c in AXES.features))


@query("hit_badges", "M4 F8", _ITEMS + _folded(_BLEND) + "SELECT sample_id, hit_id FROM folded WHERE hit_id IS NOT NULL")
def hit_badges(t: Tables) -> DataFrame:
    return rank_fold(t).where("hit_id is not null").select("sample_id", "hit_id")


@query("child_order", "F3 C20", _ITEMS + f", scored AS (SELECT *, round({_BLEND}, 6) AS score FROM d WHERE kind = 'segment') SELECT parent, id, CAST(row_number() OVER (PARTITION BY parent ORDER BY coalesce(score, -1) DESC, s, id) AS INTEGER) AS place FROM scored")
def child_order(t: Tables) -> DataFrame:
    d = ranker(t).distances("segment", anchor(t)).where("kind = 'segment'").withColumn("score", F.round(1 - similarity.blend(WEIGHTS), 6))
    return catalog.ranked_within(d, "parent", "score", "start", "id").select("parent", "id", "place")


@query("population_counts", "G1", _ITEMS + "SELECT kind, count(*) AS n, count(amount) AS with_amount FROM items GROUP BY kind")
def population_counts(t: Tables) -> DataFrame:
    return items(t).groupBy("kind").agg(F.count("*").alias("n"), F.count("amount").alias("with_amount"))
