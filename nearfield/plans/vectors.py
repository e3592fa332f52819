"""Vector queries over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.arrays import dot, norm, unit
from nearfield.io import Tables
from nearfield.operators import similarity, vectors
from nearfield.plans._registry import query

_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_NORM = "sqrt(list_sum(list_transform({a}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


def _query_vector(t: Tables) -> list[float]:
    return [float(x) for x in t.embeddings.where("vec_id = 0").first()["embedding"]]


_SEARCH = f"WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, {_COS.format(a='embedding', b='q.e')} / {_NORM.format(a='q.e')} AS score FROM embeddings, q)"


@query("vector_search", "D14 H19 M9 C17", _SEARCH + " SELECT vec_id, round(score, 6) AS score FROM s")
def vector_search(t: Tables) -> DataFrame:
    items = t.embeddings.select("vec_id", F.col("embedding").alias("vector"))
    return similarity.searched(items, _query_vector(t), 64).select("vec_id", F.round("score", 6).alias("score"))


@query("vector_search_fold", "D14 D12", _SEARCH + ", r AS (SELECT label, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY label ORDER BY round(score, 6) DESC, vec_id) AS n FROM s) SELECT CAST(label AS BIGINT) AS sample_id, score, vec_id AS hit_id FROM r WHERE n = 1")
def vector_search_fold(t: Tables) -> DataFrame:
    none = F.lit(None).cast("long")
    items = t.embeddings.select(F.lit("segment").alias("kind"), F.col("vec_id").alias("id"), F.col("label").cast("long").alias("parent"), none.alias("start"), none.alias("end"), F.lit(False).alias("window"), F.col("embedding").alias("vector"))
    scores = similarity.searched(items, _query_vector(t), 64).withColumn("score", F.round("score", 6))
    return similarity.fold(scores).select("sample_id", "score", "hit_id")


@query("vector_width_guard", "D14 B19", "SELECT count(*) AS n FROM (SELECT CASE WHEN vec_id % 7 = 0 THEN embedding[1:10] ELSE embedding END AS e FROM embeddings) WHERE len(e) = 64")
def vector_width_guard(t: Tables) -> DataFrame:
    items = t.embeddings.select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("vector"))
    return similarity.searched(items, _query_vector(t), 64).agg(F.count("*").alias("n"))


_PAIRS = f"WITH u AS (SELECT vec_id, label, embedding AS e, {_NORM.format(a='embedding')} AS m FROM embeddings), s AS (SELECT a.vec_id AS q, b.vec_id AS n, a.label AS lq, b.label AS ln, round({_COS.format(a='a.e', b='b.e')} / (a.m * b.m), 12) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id)"
_TOP5 = _PAIRS + ", top AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, n) AS rank FROM s QUALIFY rank <= 5)"


@query("knn_topk", "C19 E9", _TOP5 + " SELECT q, n, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS sim FROM top")
def knn_topk(t: Tables) -> DataFrame:
    return vectors.neighbours(t.embeddings, 5).select("q", "n", "rank", F.round("sim", 6).alias("sim"))


@query("precision_at_5", "D29", _TOP5 + " SELECT q, round(avg((lq = ln)::INT), 6) AS precision FROM top GROUP BY q")
def precision_at_5(t: Tables) -> DataFrame:
    return vectors.precision(vectors.neighbours(t.embeddings, 5), t.embeddings, "vec_id", "label").select("q", F.round("precision", 6).alias("precision"))


@query("hit_at_5", "D29", _TOP5 + " SELECT q, max((lq = ln)::INT) AS hit FROM top GROUP BY q")
def hit_at_5(t: Tables) -> DataFrame:
    return vectors.precision(vectors.neighbours(t.embeddings, 5), t.embeddings, "vec_id", "label").select("q", "hit")


_HALF = f"u2 AS (SELECT vec_id, embedding[1:32] AS e, {_NORM.format(a='embedding[1:32]')} AS m FROM embeddings), s2 AS (SELECT a.vec_id AS q, b.vec_id AS n, round({_COS.format(a='a.e', b='b.e')} / (a.m * b.m), 12) AS sim FROM u2 a JOIN u2 b ON a.vec_id <> b.vec_id), top2 AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, n) AS rank FROM s2 QUALIFY rank <= 5)"


@query("jaccard_at_5", "D29 G5", _TOP5 + ", " + _HALF + ", x AS (SELECT t.q, count(*) AS c FROM top t JOIN top2 v ON t.q = v.q AND t.n = v.n GROUP BY t.q) SELECT v.vec_id AS q, round(coalesce(c, 0) / (10.0 - coalesce(c, 0)), 6)::DOUBLE AS jaccard FROM embeddings v LEFT JOIN x ON x.q = v.vec_id")
def jaccard_at_5(t: Tables) -> DataFrame:
    """Whole vectors against their first halves."""
    half = t.embeddings.select("vec_id", F.slice("embedding", 1, 32).alias("embedding"))
    return vectors.overlap(vectors.neighbours(t.embeddings, 5), vectors.neighbours(half, 5)).select("q", F.round("jaccard", 6).alias("jaccard"))


@query("separation", "D29 J11", _PAIRS + " SELECT round(avg(sim) FILTER (lq = ln), 6) AS within, round(avg(sim) FILTER (lq <> ln), 6) AS across, round(avg(sim) FILTER (lq = ln) - avg(sim) FILTER (lq <> ln), 6) AS separation FROM s")
def separation(t: Tables) -> DataFrame:
    return vectors.separation(t.embeddings, "label").select(*(F.round(c, 6).alias(c) for c in ("within", "across", "separation")))


@query("mean_pool_vector", "D16", "WITH p AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), m AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM p GROUP BY label, pos) SELECT label, CAST(pos AS INTEGER) AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM m")
def mean_pool_vector(t: Tables) -> DataFrame:
    return vectors.mean_pooled(t.embeddings, "label", "embedding").select("label", "pos", F.round("value", 6).alias("value"))


@query("masked_pooling", "D17", "SELECT vec_id, round((embedding[1]::DOUBLE + embedding[3]::DOUBLE) / 2 / sqrt(pow((embedding[1]::DOUBLE + embedding[3]::DOUBLE) / 2, 2) + pow((embedding[2]::DOUBLE + embedding[4]::DOUBLE) / 2, 2)), 6) AS first FROM embeddings")
def masked_pooling(t: Tables) -> DataFrame:
    """The first two of three frames of two numbers."""
    e = F.col("embedding").cast("array<double>")
    frames = F.array(*(F.slice(e, i, 2) for i in (1, 3, 5)))
    return t.embeddings.select("vec_id", F.round(vectors.masked_pool(frames, F.lit(2))[0], 6).alias("first"))


_CLASSES = ["rhythmic", "melodic", "vocal", "other"]
_PROMPTS = "p AS (SELECT CASE label WHEN 0 THEN 'rhythmic' WHEN 1 THEN 'melodic' WHEN 2 THEN 'vocal' ELSE 'other' END AS class, list(m ORDER BY i) AS pe FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label)"
_SCORES = f"WITH {_PROMPTS}, c AS (SELECT v.vec_id, class, max({_COS.format(a='v.embedding', b='pe')}) AS score FROM embeddings v, p GROUP BY v.vec_id, class)"


def _class_scores(t: Tables) -> DataFrame:
    label = F.col("label")
    name = F.when(label == 0, "rhythmic").when(label == 1, "melodic").when(label == 2, "vocal").otherwise("other")
    # a prompt for each label: the mean of all its vectors
    means = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    prompts = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v")).select(name.alias("class"), F.transform("v", lambda e: e["m"]).alias("vector"))
    return vectors.class_scores(t.embeddings, prompts, "vec_id", "embedding")


@query("class_scores", "C18 D18", _SCORES + " SELECT vec_id, class, round(score, 6) AS score FROM c")
def class_scores(t: Tables) -> DataFrame:
    return _class_scores(t).withColumn("score", F.round("score", 6))


_ZERO = _SCORES + """, pr AS (SELECT vec_id, class, exp(8 * (score - max(score) OVER w)) AS e, CASE class WHEN 'rhythmic' THEN 0 WHEN 'melodic' THEN 1 WHEN 'vocal' THEN 2 ELSE 3 END AS i FROM c WINDOW w AS (PARTITION BY vec_id)),
q AS (SELECT vec_id, class, i, e / sum(e) OVER (PARTITION BY vec_id) AS prob FROM pr),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, i) AS n FROM q),
two AS (SELECT a.vec_id, a.class AS c1, b.class AS c2, a.prob - b.prob AS margin, (a.vec_id % 10) / 10.0 AS h FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.n = 1 AND b.n = 2),
best AS (SELECT vec_id, CASE WHEN c1 IN ('rhythmic', 'melodic') AND c2 IN ('rhythmic', 'melodic') AND margin < 0.15 AND h >= 0.7 THEN 'melodic' WHEN c1 IN ('rhythmic', 'melodic') AND c2 IN ('rhythmic', 'melodic') AND margin < 0.15 AND h <= 0.3 THEN 'rhythmic' ELSE c1 END AS best FROM two)
SELECT best.vec_id, best, round(prob, 6) AS confidence, CASE WHEN prob >= 0.5 THEN best END AS assigned FROM best JOIN q ON q.vec_id = best.vec_id AND q.class = best.best"""


@query("zero_shot_classify", "J4 J6 D18 H24 H25 C18", _ZERO)
def zero_shot_classify(t: Tables) -> DataFrame:
    scores = _class_scores(t).withColumn("h", (F.col("vec_id") % 10) / 10.0)
    return vectors.zero_shot(scores, "vec_id", _CLASSES, 8.0, harmonic=F.col("h")).withColumn("confidence", F.round("confidence", 6))


@query("percentile_stretch", "D27", _SEARCH + ", p AS (SELECT quantile_cont(score, 0.05) AS lo, quantile_cont(score, 0.95) AS hi FROM s) SELECT vec_id, round(greatest(0, least(1, (score - lo) / greatest(hi - lo, 1e-9))), 6) AS t FROM s, p")
def percentile_stretch(t: Tables) -> DataFrame:
    scores = similarity.searched(t.embeddings.select("vec_id", F.col("embedding").alias("vector")), _query_vector(t), 64)
    return vectors.stretched(scores, "score").select("vec_id", F.round("t", 6).alias("t"))


@query("fitted_box", "D30", "WITH b AS (SELECT min(embedding[1]::DOUBLE) AS x0, max(embedding[1]::DOUBLE) AS x1, min(embedding[2]::DOUBLE) AS y0, max(embedding[2]::DOUBLE) AS y1 FROM embeddings), k AS (SELECT *, least(100 / greatest(x1 - x0, 1e-9), 100 / greatest(y1 - y0, 1e-9)) AS k FROM b) SELECT vec_id AS id, round((embedding[1]::DOUBLE - (x0 + x1) / 2) * k + 50, 6) AS px, round((embedding[2]::DOUBLE - (y0 + y1) / 2) * k + 50, 6) AS py FROM embeddings, k")
def fitted_box(t: Tables) -> DataFrame:
    points = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return vectors.fitted_box(points, 100.0, 100.0).select("id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


@query("vector_norms", "H19 A13", f"SELECT vec_id, round({_NORM.format(a='embedding')}, 6) AS n, round({_NORM.format(a='embedding[1:8]')}, 6) AS n8 FROM embeddings")
def vector_norms(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(norm(F.col("embedding")), 6).alias("n"), F.round(norm(F.slice("embedding", 1, 8)), 6).alias("n8"))


@query("unit_vectors", "H19", f"SELECT vec_id, round(embedding[1]::DOUBLE / {_NORM.format(a='embedding[1:8]')}, 6) AS x FROM embeddings")
def unit_vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(unit(F.slice("embedding", 1, 8))[0], 6).alias("x"))


@query("vector_lookup", "B17 B19", "SELECT o.o_orderkey, v.label, coalesce(v.embedding[1]::DOUBLE, 0) AS x FROM orders o LEFT JOIN embeddings v ON v.vec_id = o.o_orderkey")
def vector_lookup(t: Tables) -> DataFrame:
    """An item without a vector has zeros."""
    v = t.embeddings.select(F.col("vec_id").alias("o_orderkey"), "label", "embedding")
    vector = F.coalesce(F.col("embedding"), F.array_repeat(F.lit(0.0).cast("float"), 64))
    return t.orders.select("o_orderkey").join(v, "o_orderkey", "left").select("o_orderkey", "label", vector[0].cast("double").alias("x"))


@query("nearest_point", "C24", "SELECT vec_id AS id FROM embeddings WHERE pow(embedding[1]::DOUBLE - 0.05, 2) + pow(embedding[2]::DOUBLE + 0.02, 2) <= 0.25 ORDER BY pow(embedding[1]::DOUBLE - 0.05, 2) + pow(embedding[2]::DOUBLE + 0.02, 2), vec_id LIMIT 1")
def nearest_point(t: Tables) -> DataFrame:
    from nearfield.operators.intervals import nearest_point as nearest

    points = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return nearest(points, 0.05, -0.02, 0.5).select("id")


@query("vector_export", "A14 A13", "SELECT 'sample' AS kind, vec_id AS id, len(embedding) AS width FROM embeddings WHERE label < 5 UNION ALL SELECT 'segment', vec_id, len(embedding) FROM embeddings WHERE label >= 5")
def vector_export(t: Tables) -> DataFrame:
    kind = F.when(F.col("label") < 5, "sample").otherwise("segment")
    return t.embeddings.select(kind.alias("kind"), F.col("vec_id").alias("id"), F.size("embedding").cast("long").alias("width"))


@query("pair_cosine", "M9", f"SELECT a.vec_id, round({_COS.format(a='a.embedding', b='b.embedding')}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pair_cosine(t: Tables) -> DataFrame:
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e"))
    return t.embeddings.join(b, "vec_id").select("vec_id", F.round(dot(F.col("embedding"), F.col("e")), 6).alias("cosine"))


@query("pca_layout", "J8 J9")
def pca_layout(t: Tables) -> DataFrame:
    return vectors.principal_plane(t.embeddings, "vec_id", "embedding")[0]
