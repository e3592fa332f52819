"""Staleness, corrections, keyed writes and cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield import schema
from nearfield.io import Tables, insert_ignore, latest, upsert
from nearfield.operators import state
from nearfield.plans._registry import query


def _stamped(t: Tables) -> DataFrame:
    """Orders (id, changed) with the last ship date of their lines as stamp; orders of key divisible by 7 have none."""
    last = t.lineitem.where("l_orderkey % 7 <> 0").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").alias("stamp"))
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("changed")).join(last, "id", "left")


_STAMPED = "WITH s AS (SELECT o_orderkey AS id, o_orderdate AS changed, (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey AND l_orderkey % 7 <> 0) AS stamp FROM orders)"


@query("stale_worklist", "B20 B21 B23 B24 C8 K11", _STAMPED + " SELECT id, stamp IS NULL OR coalesce(changed > stamp, FALSE) AS analysis, coalesce(changed > stamp, FALSE) AS refresh FROM s WHERE stamp IS NULL OR changed > stamp")
def stale_worklist(t: Tables) -> DataFrame:
    rows = _stamped(t).select("id", state.analysis_due(F.col("stamp"), F.col("changed")).alias("analysis"), state.segments_stale(F.col("stamp"), F.col("changed")).alias("refresh"))
    return rows.where("analysis or refresh")


@query("stale_counts", "D7 D28", _STAMPED + " SELECT count(*) FILTER (stamp IS NULL) AS missing, count(*) FILTER (changed > stamp) AS stale, count(*) FILTER (changed <= stamp) AS fresh FROM s")
def stale_counts(t: Tables) -> DataFrame:
    return _stamped(t).agg(F.count_if(F.col("stamp").isNull()).alias("missing"), F.count_if(F.col("changed") > F.col("stamp")).alias("stale"), F.count_if(F.col("changed") <= F.col("stamp")).alias("fresh"))


@query("worklist_limited", "F4 C7", _STAMPED + " SELECT id FROM s WHERE stamp IS NULL ORDER BY id LIMIT 25")
def worklist_limited(t: Tables) -> DataFrame:
    return _stamped(t).where("stamp is null").orderBy("id").limit(25).select("id")


@query(
    "embeddings_due",
    "B22 C7 C9 C10",
    """WITH s AS (SELECT o_orderkey AS id, o_orderdate AS changed, o_totalprice > 150000 AS wanted FROM orders), v AS (SELECT vec_id AS id, TIMESTAMP '1996-01-01' AS e FROM embeddings),
g AS (SELECT l_orderkey * 100 + l_linenumber AS id, l_orderkey AS sample_id, l_linestatus = 'O' AS win FROM lineitem),
r AS (SELECT s.id, e IS NULL OR coalesce(changed > e, FALSE) AS stale, wanted AND NOT EXISTS (SELECT 1 FROM g WHERE g.sample_id = s.id AND win) AS lacks_windows, EXISTS (SELECT 1 FROM g WHERE g.sample_id = s.id AND g.id % 3 <> 0) AS has_orphans FROM s LEFT JOIN v ON v.id = s.id)
SELECT * FROM r WHERE stale OR lacks_windows OR has_orphans""",
)
def embeddings_due(t: Tables) -> DataFrame:
    samples = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("changed"), (F.col("o_totalprice") > 150000).alias("windows_wanted"))
    vectors = t.embeddings.select(F.col("vec_id").alias("sample_id"), F.lit("1996-01-01").cast("timestamp_ntz").alias("embedded_at"))
    segments = t.lineitem.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("sample_id"), F.when(F.col("l_linestatus") == "O", "window").otherwise("auto").alias("detection_method"))
    segment_vectors = segments.where("id % 3 = 0").select(F.col("id").alias("segment_id")).distinct()
    return state.embeddings_due(samples, vectors, segments, segment_vectors)


@query("orphan_children", "C9 C10 C11", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F')")
def orphan_children(t: Tables) -> DataFrame:
    return state.orphans(t.lineitem, t.orders.where("o_orderstatus <> 'F'"), "l_orderkey", "o_orderkey").select(F.col("l_orderkey").alias("id")).distinct()


@query("childless_parents", "C10", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def childless_parents(t: Tables) -> DataFrame:
    return state.orphans(t.orders, t.lineitem, "o_orderkey", "l_orderkey").select(F.col("o_orderkey").alias("id"))


@query("corrections_protect", "K1 K6 K7 INV2", "SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'user' ELSE d.lang END AS class, l.toxic = 1 AS confirmed FROM documents d JOIN labels l USING (doc_id)")
def corrections_protect(t: Tables) -> DataFrame:
    rows = t.labels.select("doc_id", F.lit("user").alias("class"), (F.col("toxic") == 1).alias("confirmed"))
    return state.corrected(rows, "doc_id", "class", t.documents.select("doc_id", F.col("lang").alias("class"))).select("doc_id", "class", "confirmed")


@query("set_by_user", "K7", "SELECT doc_id, CASE WHEN doc_id IN (1, 2, 3) THEN 'melodic' ELSE lang END AS class, doc_id IN (1, 2, 3) OR doc_id % 5 = 0 AS confirmed, CASE WHEN doc_id IN (1, 2, 3) THEN 'manual' ELSE 'machine' END AS provenance FROM documents")
def set_by_user(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.col("lang").alias("class"), (F.col("doc_id") % 5 == 0).alias("confirmed"), F.lit("machine").alias("provenance"))
    return state.set_by_user(rows, "doc_id", [1, 2, 3], "class", "melodic")


@query("reset_best_class", "D19 K7", "WITH s AS (SELECT user_id, event_type AS class, round(avg(value) / 100, 4) AS score FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, CASE class WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END) AS n FROM s WHERE class IN ('view', 'click', 'purchase')) SELECT user_id, CASE WHEN score >= 0.5 THEN class END AS class, score AS confidence FROM r WHERE n = 1")
def reset_best_class(t: Tables) -> DataFrame:
    s = t.events.groupBy("user_id", F.col("event_type").alias("class")).agg(F.round(F.avg("value") / 100, 4).alias("score"))
    return state.reset_class(s, "user_id", ["view", "click", "purchase"])


@query("child_class_follows", "C12 K6", "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, CASE WHEN l.l_returnflag = 'A' THEN 'kept' ELSE o.o_orderpriority END AS class FROM lineitem l JOIN orders o ON o_orderkey = l_orderkey")
def child_class_follows(t: Tables) -> DataFrame:
    parent = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return t.lineitem.join(parent, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "A", "kept").otherwise(F.col("o_orderpriority")).alias("class"))


@query("upsert_keep_latest", "G6 B16", "SELECT user_id, event_type, arg_max(value, (epoch_us(ts), event_id)) AS value, max(ts) AS ts FROM events GROUP BY 1, 2")
def upsert_keep_latest(t: Tables) -> DataFrame:
    return latest(t.events.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "value", "ts")


@query("upserted", "G6 K1", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -c_custkey, 'new' FROM customer WHERE c_custkey % 100 = 0")
def upserted(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    new = rows.where("c_custkey % 4 = 0").select("c_custkey", F.lit("new").alias("segment")).union(rows.where("c_custkey % 100 = 0").select(-F.col("c_custkey"), F.lit("new")))
    return upsert(rows, new, ["c_custkey"])


@query("inserted_ignoring", "G6", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def inserted_ignoring(t: Tables) -> DataFrame:
    """Rows of a key that is there are ignored; of new ones the least comes in."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return insert_ignore(rows.where("false"), rows, ["l_orderkey", "l_linenumber"])


@query("segments_replaced", "K2 K4", "WITH s AS (SELECT DISTINCT l_orderkey AS sample_id, l_linenumber * 100 AS a, l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS b, l_returnflag FROM lineitem) SELECT count(*) AS n FROM (SELECT DISTINCT sample_id, a, b, CASE WHEN l_returnflag = 'A' THEN 'manual' ELSE 'auto' END AS m FROM s WHERE l_returnflag = 'A' UNION ALL SELECT DISTINCT sample_id, a + 50, b + 50, 'auto' FROM s WHERE b > a)")
def segments_replaced(t: Tables) -> DataFrame:
    s = t.lineitem.select(F.col("l_orderkey").alias("sample_id"), (F.col("l_linenumber") * 100).cast("long").alias("start_ms"), (F.col("l_linenumber") * 100 + F.col("l_quantity").cast("long")).alias("end_ms"), F.when(F.col("l_returnflag") == "A", "manual").otherwise("auto").alias("detection_method")).distinct()
    stored = s.withColumn("id", F.xxhash64("sample_id", "start_ms", "end_ms", "detection_method")).withColumn("is_user_confirmed", F.lit(False))
    found = s.select("sample_id", (F.col("start_ms") + 50).alias("start_ms"), (F.col("end_ms") + 50).alias("end_ms"), F.lit("auto").alias("detection_method"), F.lit(False).alias("is_user_confirmed"))
    return state.replaced_segments(stored, found, None, 1).agg(F.count("*").alias("n"))


@query("segments_replaced_rows", "K2 K4", "WITH s AS (SELECT DISTINCT l_orderkey AS sample_id, l_linenumber * 100 AS a, CAST(l_quantity AS BIGINT) AS q, l_returnflag = 'A' AS manual FROM lineitem), n AS (SELECT DISTINCT sample_id, a + 50 AS a, a + q + 50 AS b FROM s WHERE q > 0) SELECT sample_id, a AS start_ms, a + q AS end_ms, 'manual' AS detection_method, -(sample_id * 1000000 + a * 100 + q) AS id FROM s WHERE manual UNION ALL SELECT sample_id, a, b, 'auto', row_number() OVER (ORDER BY sample_id, a, b) FROM n")
def segments_replaced_rows(t: Tables) -> DataFrame:
    """The segments of all orders after their replacement, with old and new ids; segments_replaced counts them."""
    start, length = F.col("l_linenumber").cast("long") * 100, F.col("l_quantity").cast("long")
    s = t.lineitem.select(F.col("l_orderkey").alias("sample_id"), start.alias("start_ms"), (start + length).alias("end_ms"), F.when(F.col("l_returnflag") == "A", "manual").otherwise("auto").alias("detection_method")).distinct()
    stored = s.withColumn("id", -(F.col("sample_id") * 1000000 + F.col("start_ms") * 100 + F.col("end_ms") - F.col("start_ms"))).withColumn("is_user_confirmed", F.lit(False))
    found = s.select("sample_id", (F.col("start_ms") + 50).alias("start_ms"), (F.col("end_ms") + 50).alias("end_ms"), F.lit("auto").alias("detection_method"), F.lit(False).alias("is_user_confirmed"))
    return state.replaced_segments(stored, found, None, 1).drop("is_user_confirmed")


@query("manual_refresh", "K3", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN l_linenumber * 1000 >= 3500 OR l_linenumber * 1000 + 700 > 3500 ELSE FALSE END AS needs_review FROM lineitem")
def manual_refresh(t: Tables) -> DataFrame:
    start = (F.col("l_linenumber") * 1000).cast("long")
    s = t.lineitem.select(F.col("l_orderkey").alias("sample_id"), "l_linenumber", "l_partkey", start.alias("start_ms"), (start + 700).alias("end_ms"), F.when(F.col("l_returnflag") == "A", "manual").otherwise("auto").alias("detection_method"), F.lit(False).alias("needs_review"), F.lit("x").alias("cache_path"))
    durations = t.orders.select(F.col("o_orderkey").alias("sample_id"), F.lit(3500).alias("duration_ms"))
    return state.refreshed_manual(s, durations).select(F.col("sample_id").alias("l_orderkey"), "l_linenumber", "l_partkey", "needs_review")


@query("cascade_delete", "K10", "SELECT (SELECT count(*) FROM orders WHERE o_totalprice < 100000) AS parents, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice < 100000)) AS children")
def cascade_delete(t: Tables) -> DataFrame:
    left = t.orders.where("o_totalprice < 100000")
    kids = schema.cascade(t.lineitem, left, "l_orderkey", "o_orderkey")
    return left.agg(F.count("*").alias("parents")).crossJoin(kids.agg(F.count("*").alias("children")))


@query("unique_violations", "A11", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(t: Tables) -> DataFrame:
    return schema.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("dangling_children", "A11", "SELECT count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)")
def dangling_children(t: Tables) -> DataFrame:
    return schema.dangling(t.lineitem, t.part, "l_partkey", "p_partkey").agg(F.count("*").alias("n"))


@query("migrated_flags", "A12", "SELECT doc_id, toxic = 1 AS content_class_confirmed, toxic = 1 AS structural_type_confirmed FROM labels")
def migrated_flags(t: Tables) -> DataFrame:
    old = t.labels.select("doc_id", (F.col("toxic") == 1).alias("is_user_confirmed"))
    return state.migrated("classification", old, 1, 3).select("doc_id", "content_class_confirmed", "structural_type_confirmed")


@query("tags_pruned", "C11 K8", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def tags_pruned(t: Tables) -> DataFrame:
    tags = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return state.pruned(tags, t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("tag_id")))


@query("facets", "K9", "SELECT d.doc_id, d.lang AS class, coalesce(l.toxic = 1, FALSE) AS confirmed FROM documents d LEFT JOIN labels l USING (doc_id)")
def facets(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.col("lang").alias("class"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("confirmed"))


@query("one_root", "K10", "SELECT r_regionkey, r_name = 'ASIA' AS is_root FROM region")
def one_root(t: Tables) -> DataFrame:
    return state.with_root(t.region.select("r_regionkey", F.col("r_name").alias("path")), "ASIA").select("r_regionkey", "is_root")


@query("current_layout", "J10", "SELECT id, id = -1 AS is_current FROM (SELECT s_suppkey AS id FROM supplier UNION ALL SELECT -1)")
def current_layout(t: Tables) -> DataFrame:
    old = t.supplier.select(F.col("s_suppkey").alias("id"), F.lit(True).alias("is_current"))
    return state.layout_added(old, t.spark.createDataFrame([(-1,)], "id long"))


@query("current_layout_whole", "J10", "SELECT s_suppkey AS id, FALSE AS is_current FROM supplier UNION ALL SELECT max(s_suppkey) + 1, TRUE FROM supplier")
def current_layout_whole(t: Tables) -> DataFrame:
    """As current_layout, with the next number for the new one."""
    old = t.supplier.select(F.col("s_suppkey").alias("id"), F.lit(True).alias("is_current"))
    return state.layout_added(old, t.supplier.agg((F.max("s_suppkey") + 1).alias("id")))


@query("manual_edits", "K5", "SELECT l_orderkey * 100 + l_linenumber AS id, CASE WHEN l_orderkey * 100 + l_linenumber = (SELECT min(l_orderkey * 100 + l_linenumber) FROM lineitem) THEN 'manual' ELSE 'auto' END AS detection_method, count(*) AS n FROM lineitem GROUP BY 1, 2 UNION ALL SELECT -1, 'manual', 1")
def manual_edits(t: Tables) -> DataFrame:
    """The first segment moved, one added, and one that was added taken away again."""
    s = t.lineitem.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("sample_id"), F.lit(0).cast("long").alias("start_ms"), F.lit(9).cast("long").alias("end_ms"), F.lit("auto").alias("detection_method"), F.lit(False).alias("is_user_confirmed"), F.lit(False).alias("needs_review"), F.lit("x").alias("cache_path"))
    vectors = s.select(F.col("id").alias("segment_id"))
    first = t.lineitem.agg(F.min(F.col("l_orderkey") * 100 + F.col("l_linenumber"))).first()[0]
    s, vectors = state.edited_segment(s, vectors, first, 3, 7)
    s = state.added_segment(state.added_segment(s, 1, 5, 6, -1), 1, 7, 8, -2)
    s, vectors = state.removed_segment(s, vectors, -2)
    return s.groupBy("id", "detection_method").agg(F.count("*").alias("n"))
