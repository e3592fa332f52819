"""Table functions for users of SQL text: a vector search, windows over a length, and what lies in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.io import Tables
from nearfield.plans._registry import query

#: Names and bodies; each is a plan like any other, so filters, columns and joins reach into it.
FUNCTIONS = {
    # cosine with a query that is normalised first; vectors of another width are absent
    "search_items(query ARRAY<DOUBLE>)": """TABLE (id BIGINT, score DOUBLE) RETURN
SELECT id, aggregate(zip_with(vector, search_items.query, (x, y) -> x * y), 0D, (s, x) -> s + x) / CASE WHEN length > 0 THEN length ELSE 1D END
FROM (SELECT id, vector, sqrt(aggregate(search_items.query, 0D, (s, x) -> s + x * x)) AS length FROM searched_items WHERE size(vector) = size(search_items.query))""",
    # one window up to `most` long, adjoining ones up to 24, beyond that 24 spread evenly; a tail below `least` goes if others stay
    "window_spans(n BIGINT, most BIGINT, least BIGINT)": """TABLE (start BIGINT, end BIGINT) RETURN
SELECT start, least(window_spans.n, start + window_spans.most) FROM (
  SELECT CASE WHEN window_spans.n <= window_spans.most THEN 0 WHEN ceil(window_spans.n / window_spans.most) <= 24 THEN i * window_spans.most
    WHEN i = 23 THEN window_spans.n - window_spans.most ELSE floor(i * ((window_spans.n - window_spans.most) / 23)) END AS start
  FROM explode(sequence(0L, least(24L, greatest(1L, ceil(window_spans.n / window_spans.most))) - 1)) AS e(i))
WHERE start = 0 OR least(window_spans.n, start + window_spans.most) - start >= window_spans.least""",
    # a folder's items: the path itself and all below it, whatever stands in it literally
    "items_under(folder STRING)": """TABLE (id BIGINT, path STRING) RETURN
SELECT id, path FROM listed_items WHERE path = rtrim('/', items_under.folder) OR startswith(path, rtrim('/', items_under.folder) || '/')""",
}


def registered(spark: SparkSession, *, vectors: DataFrame | None = None, paths: DataFrame | None = None) -> SparkSession:
    """The session with the functions over these tables: vectors (id, vector), paths (id, path)."""
    empty = {"searched_items": "id BIGINT, vector ARRAY<DOUBLE>", "listed_items": "id BIGINT, path STRING"}
    for view, given in (("searched_items", vectors), ("listed_items", paths)):
        (spark.createDataFrame([], empty[view]) if given is None else given).createOrReplaceTempView(view)
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {body}")
    return spark


_SCORE = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


@query("sql_search_items", "D14", f"WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, label, round({_SCORE.format(a='embedding', b='q.e')} / sqrt({_SCORE.format(a='q.e', b='q.e')}), 6) AS score FROM embeddings, q WHERE len(embedding) = len(q.e)")
def sql_search_items(t: Tables) -> DataFrame:
    """A search as SQL text, joined with what the items are."""
    spark = registered(t.spark, vectors=t.embeddings.selectExpr("vec_id AS id", "CAST(embedding AS ARRAY<DOUBLE>) AS vector"))
    q = [float(x) for x in t.embeddings.where("vec_id = 0").first()["embedding"]]
    t.embeddings.select("vec_id", "label").createOrReplaceTempView("item_labels")
    return spark.sql("SELECT s.id, l.label, round(s.score, 6) AS score FROM search_items(:q) s JOIN item_labels l ON l.vec_id = s.id", args={"q": q})


@query(
    "sql_window_spans",
    "E8",
    """WITH d AS (SELECT doc_id, n_chars AS n, CAST(ceil(n_chars / 300.0) AS BIGINT) AS c FROM documents),
s AS (SELECT doc_id, n, unnest(CASE WHEN n <= 300 THEN [0] WHEN c <= 24 THEN list_transform(range(0, c), lambda i: i * 300) ELSE list_transform(range(0, 24), lambda i: CASE WHEN i = 23 THEN n - 300 ELSE CAST(floor(i * ((n - 300) / 23)) AS BIGINT) END) END) AS start FROM d)
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(least(n, start + 300) AS BIGINT) AS "end" FROM s WHERE start = 0 OR least(n, start + 300) - start >= 40""",
)
def sql_window_spans(t: Tables) -> DataFrame:
    """Windows over every document, by a lateral join."""
    spark = registered(t.spark)
    t.documents.select("doc_id", "n_chars").createOrReplaceTempView("sized_documents")
    return spark.sql("SELECT doc_id, w.start, w.end FROM sized_documents, LATERAL window_spans(n_chars, 300L, 40L) w")


@query("sql_items_under", "B3 C15", "WITH p AS (SELECT p_partkey AS id, '/lib/' || replace(p_brand, '#', '_%') || '/' || p_type || '/' || CAST(p_partkey AS VARCHAR) AS path FROM part) SELECT f.folder, p.id FROM (VALUES ('/lib/Brand_%11'), ('/lib/Brand_%1'), ('/lib/Brand_%23/')) f(folder) JOIN p ON starts_with(p.path, rtrim(f.folder, '/') || '/')")
def sql_items_under(t: Tables) -> DataFrame:
    """Folders whose names hold the wildcards of LIKE."""
    path = "concat('/lib/', replace(p_brand, '#', '_%'), '/', p_type, '/', p_partkey)"
    spark = registered(t.spark, paths=t.part.selectExpr("p_partkey AS id", f"{path} AS path"))
    return spark.sql(" UNION ALL ".join(f"SELECT '{f}' AS folder, id FROM items_under('{f}')" for f in ("/lib/Brand_%11", "/lib/Brand_%1", "/lib/Brand_%23/")))
