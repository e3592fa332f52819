"""Listings, differences, moves and the cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.io import Tables
from nearfield.plans._registry import query
from nearfield.sources import ingest


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Documents as files: what is known, and what a later walk found."""
    path = F.concat(F.lit("/lib/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = t.documents.select(F.col("doc_id").alias("id"), path.alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") % 100).cast("double").alias("mtime"), F.md5("text").alias("hash"))
    known = rows.where("id % 10 <> 1")
    r = F.col("id") % 10
    found = rows.where("id % 10 <> 2").select(F.when(r == 3, F.concat("path", F.lit("x"))).otherwise(F.col("path")).alias("path"), F.when(r == 4, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(r.isin(4, 5), F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), F.when(r == 4, F.lit("other")).otherwise(F.col("hash")).alias("hash"))
    return found, known


_KIND = "CASE doc_id % 10 WHEN 1 THEN 'added' WHEN 2 THEN {gone} WHEN 4 THEN 'changed' WHEN 5 THEN 'identical' ELSE 'unchanged' END"
_GONE = "CASE WHEN source = 'src2' THEN 'protected' ELSE 'removed' END"


@query("scan_diff", "A2 C13 G2", f"WITH k AS (SELECT {_KIND.format(gone=_GONE)} AS change FROM documents WHERE doc_id % 10 <> 3 UNION ALL SELECT {_GONE} FROM documents WHERE doc_id % 10 = 3 UNION ALL SELECT 'added' FROM documents WHERE doc_id % 10 = 3) SELECT change, count(*) AS n FROM k GROUP BY change")
def scan_diff(t: Tables) -> DataFrame:
    found, known = _snapshots(t)
    return ingest.compared(found, known, unread=["/lib/src2"], root="/lib").groupBy("change").agg(F.count("*").alias("n"))


def _file(rows: DataFrame, *extra) -> DataFrame:
    return rows.select(*extra, "path", F.lit("n").alias("name"), "size", F.lit(1.0).alias("duration"), F.lit(44100).alias("rate"), F.lit(2).alias("channels"), "hash")


@query("move_reconcile", "C14 A2", "WITH o AS (SELECT doc_id, md5(text) AS h, n_chars AS s, row_number() OVER (PARTITION BY md5(text), n_chars ORDER BY '/lib/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt') AS n, '/lib/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS p FROM documents WHERE doc_id % 10 = 3) SELECT doc_id AS id, p AS old_path, p || 'x' AS new_path FROM o")
def move_reconcile(t: Tables) -> DataFrame:
    found, known = _snapshots(t)
    changes = ingest.compared(found, known, root="/lib")
    removed = _file(known.join(changes.where("change = 'removed'").select("path"), "path").where("id % 10 = 3"), "id")
    added = _file(found.where("path like '%x'"))
    return ingest.moved(removed, added)


@query("skip_counts", "A3 D28 H6", "WITH f AS (SELECT CASE WHEN page_id % 9 = 0 THEN '._x.wav' WHEN page_id % 9 = 1 THEN 'A.WAV' WHEN page_id % 9 = 2 THEN 'b.rx2' WHEN page_id % 9 = 3 THEN 'readme' ELSE 'c.Txt' END AS n FROM pages) SELECT CASE WHEN starts_with(n, '._') THEN '._*' WHEN n = 'readme' THEN '<no-ext>' ELSE lower(regexp_extract(n, '(\\.[^.]+)$', 1)) END AS kind, count(*) AS n FROM f GROUP BY 1")
def skip_counts(t: Tables) -> DataFrame:
    r = F.col("page_id") % 9
    name = F.when(r == 0, "._x.wav").when(r == 1, "A.WAV").when(r == 2, "b.rx2").when(r == 3, "readme").otherwise("c.Txt")
    return ingest.kinds_of(t.pages.select(name.alias("filename")))


def _cache(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 997 % 100000).alias("used"), (F.col("doc_id") % 13 != 0).alias("referenced"))


@query("evict_lru", "A18", "WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS path, n_chars AS size, doc_id * 997 % 100000 AS used, doc_id % 13 <> 0 AS r FROM documents), t AS (SELECT *, sum(size) OVER (ORDER BY used DESC, path DESC ROWS UNBOUNDED PRECEDING) AS total FROM f WHERE r) SELECT path, 'orphan' AS reason FROM f WHERE NOT r UNION ALL SELECT path, 'old' FROM t WHERE total > 500000")
def evict_lru(t: Tables) -> DataFrame:
    return ingest.evicted(_cache(t), 500000)


@query("cache_state", "A17", "SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) FILTER (doc_id % 13 = 0) AS orphans FROM documents")
def cache_state(t: Tables) -> DataFrame:
    return ingest.cache_state(_cache(t))


@query("spread_pick", "A23", "WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT label, vec_id FROM r WHERE n <= 5 OR i IN (round_even(0 * (n - 1) / 4.0, 0), round_even(1 * (n - 1) / 4.0, 0), round_even(2 * (n - 1) / 4.0, 0), round_even(3 * (n - 1) / 4.0, 0), n - 1)")
def spread_pick(t: Tables) -> DataFrame:
    return ingest.spread(t.embeddings.select("label", "vec_id"), "label", "vec_id", 5)


@query("preview_source", "A19", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus = 'O' THEN 'file' ELSE 'render' END || CAST(l_partkey AS VARCHAR) AS source FROM lineitem")
def preview_source(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.when(F.col("l_linestatus") == "O", "file").otherwise("render"), F.col("l_partkey").cast("string")).alias("source"))


@query("seed_folders", "G4 F9", "SELECT DISTINCT path FROM (SELECT n_name AS path FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT 'HINT')")
def seed_folders(t: Tables) -> DataFrame:
    return ingest.seeded_folders(t.nation.select(F.concat("n_name", F.lit("/")).alias("path")), t.region.select(F.col("r_name").alias("path")), "HINT")


@query("scan_roots", "G4", "SELECT DISTINCT '/lib/' || lang AS path FROM documents")
def scan_roots(t: Tables) -> DataFrame:
    name = F.col("doc_id").cast("string")
    folder = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    path = F.concat(F.lit("/lib/"), "lang", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/"), "source")).otherwise(""), F.lit("/"), name)
    return ingest.scan_roots(t.documents.select(path.alias("filepath"), folder.alias("folder"), name.alias("filename")))
