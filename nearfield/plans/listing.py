"""List, catalogue, filter and order queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.io import Tables
from nearfield.operators import catalog, filters, places
from nearfield.plans._registry import query

# Tags


def _event_scores(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 4).alias("score"))


_EV = "WITH e AS (SELECT user_id, event_type, round(avg(value), 4) AS score FROM events GROUP BY 1, 2)"


@query("topk_tags", "D1 B15", _EV + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS n FROM e) SELECT user_id, string_agg(event_type, ', ' ORDER BY n) AS tags FROM r WHERE n <= 3 GROUP BY user_id")
def topk_tags(t: Tables) -> DataFrame:
    return catalog.top_joined(_event_scores(t), "user_id", "event_type", "score", 3)


@query("tag_list", "B15 F7", _EV + " SELECT event_type, score, CAST(row_number() OVER (ORDER BY score DESC, event_type) AS INTEGER) AS place FROM e WHERE user_id = (SELECT min(user_id) FROM events) ORDER BY score DESC, event_type LIMIT 10")
def tag_list(t: Tables) -> DataFrame:
    first = t.events.agg(F.min("user_id")).first()[0]
    ranked = _event_scores(t).where(F.col("user_id") == first)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "event_type"))).orderBy("place").limit(10).select("event_type", "score", "place")


@query("user_tags_ci", "D2 K9", "WITH n AS (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS name FROM events) SELECT user_id, string_agg(name, ', ' ORDER BY lower(name), name) AS names FROM n GROUP BY user_id")
def user_tags_ci(t: Tables) -> DataFrame:
    names = t.events.select("user_id", F.when(F.col("user_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("name")).distinct()
    return catalog.names_joined(names, "user_id", "name")


@query("class_scores_map", "D3 H22", _EV + " SELECT user_id, max(score) FILTER (event_type = (SELECT min(event_type) FROM events)) AS first_score, count(*) AS n FROM e GROUP BY user_id")
def class_scores_map(t: Tables) -> DataFrame:
    first = t.events.agg(F.min("event_type")).first()[0]
    return catalog.score_map(_event_scores(t), "user_id", "event_type", "score").select("user_id", F.element_at("class_scores", F.lit(first)).alias("first_score"), F.size("class_scores").cast("long").alias("n"))


@query("tag_usage", "D6 C3 C4", "WITH n AS (SELECT DISTINCT p_type AS name FROM part), u AS (SELECT p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45 GROUP BY 1) SELECT name, coalesce(u.n, 0) AS n FROM n LEFT JOIN u ON u.p_type = n.name")
def tag_usage(t: Tables) -> DataFrame:
    uses = t.lineitem.where("l_quantity > 45").join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("p_type")
    return catalog.usage(t.part.select(F.col("p_type").alias("name")).distinct(), uses, "name", "p_type")


@query("suggested_tags", "F6 G3", _EV + ", used AS (SELECT DISTINCT user_id, lower(upper(event_type)) AS l FROM events WHERE value > 50), r AS (SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY score DESC, event_type) AS place FROM e WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.user_id = e.user_id AND u.l = lower(e.event_type))) SELECT user_id, event_type, score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 6")
def suggested_tags(t: Tables) -> DataFrame:
    curated = t.events.where("value > 50").select("user_id", F.upper("event_type").alias("event_type"))
    return catalog.suggestions(_event_scores(t), curated, "user_id", "event_type", "score").select("user_id", "event_type", "score", "place")


# The list


@query(
    "catalogue_list",
    "B1 C1 C2 D4 A10",
    """WITH tags AS (SELECT l_orderkey, string_agg(l_returnflag, ', ' ORDER BY n) AS tags FROM (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY sum(l_quantity) DESC, l_returnflag) AS n FROM lineitem GROUP BY 1, 2) WHERE n <= 3 GROUP BY 1),
counts AS (SELECT l_orderkey, count(*) FILTER (l_linestatus <> 'O') AS segment_count, count(*) FILTER (l_discount > 0.08) AS flagged FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, o_orderpriority AS folder, c_mktsegment AS content_class, n_name AS key, coalesce(tags, '') AS tags, coalesce(segment_count, 0) AS segment_count, coalesce(flagged, 0) AS flagged
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN tags ON tags.l_orderkey = o_orderkey LEFT JOIN counts ON counts.l_orderkey = o_orderkey""",
)
def catalogue_list(t: Tables) -> DataFrame:
    samples = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("folder"), "o_custkey")
    classes = samples.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("id", F.col("c_mktsegment").alias("content_class"), "c_nationkey")
    analysis = classes.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("id", F.col("n_name").alias("key"))
    lines = t.lineitem.withColumnRenamed("l_orderkey", "id")
    tags = catalog.top_joined(lines.groupBy("id", "l_returnflag").agg(F.sum("l_quantity").alias("q")), "id", "l_returnflag", "q", 3)
    counts = catalog.child_counts(lines, "id", F.col("l_linestatus") == "O", F.col("l_discount") > 0.08)
    return catalog.listed(samples, classes=classes.drop("c_nationkey"), analysis=analysis, tags=tags, counts=counts).select("id", "folder", "content_class", "key", "tags", "segment_count", "flagged")


@query("catalogue_row", "B2 B4", "SELECT o_orderkey AS id, o_orderpriority AS folder, c_mktsegment AS content_class, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus <> 'O') AS segment_count FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderkey IN (1, 2, 3)")
def catalogue_row(t: Tables) -> DataFrame:
    return catalogue_list(t).where(filters.in_ids(F.col("id"), [1, 2, 3])).select("id", "folder", "content_class", "segment_count")


@query("ids_empty", "B4", "SELECT o_orderkey AS id FROM orders WHERE FALSE")
def ids_empty(t: Tables) -> DataFrame:
    return t.orders.where(filters.in_ids(F.col("o_orderkey"), [])).select(F.col("o_orderkey").alias("id"))


@query("index_summary", "D5 D7", "SELECT (SELECT count(*) FROM orders) AS samples, (SELECT count(*) FROM lineitem WHERE l_linestatus <> 'O') AS segments, (SELECT count(*) FROM lineitem WHERE l_linestatus = 'O') AS windows, (SELECT count(*) FROM embeddings) AS indexed, (SELECT count(*) FROM labels WHERE toxic = 1) AS flagged, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS with_segments")
def index_summary(t: Tables) -> DataFrame:
    parts = [
        t.orders.agg(F.count("*").alias("samples")),
        t.lineitem.agg(F.count_if(F.col("l_linestatus") != "O").alias("segments"), F.count_if(F.col("l_linestatus") == "O").alias("windows"), F.countDistinct("l_orderkey").alias("with_segments")),
        t.embeddings.agg(F.count("*").alias("indexed")),
        t.labels.agg(F.count_if(F.col("toxic") == 1).alias("flagged")),
    ]
    out = parts[0]
    for p in parts[1:]:
        # each side is one row
        out = out.crossJoin(p)
    return out


@query("sections", "B13 C2", "SELECT conv_id, string_agg(CAST(turn AS VARCHAR) || ':' || role, ',' ORDER BY turn) AS sections FROM conversations GROUP BY conv_id")
def sections(t: Tables) -> DataFrame:
    s = catalog.sections(t.conversations, "conv_id", "turn", ["role"])
    return s.select("conv_id", F.array_join(F.transform("sections", lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["role"])), ",").alias("sections"))


@query("drill_down", "B14", "SELECT l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem) AND l_linestatus <> 'O'")
def drill_down(t: Tables) -> DataFrame:
    first = t.lineitem.agg(F.min("l_orderkey")).first()[0]
    return t.lineitem.where((F.col("l_orderkey") == first) & (F.col("l_linestatus") != "O")).orderBy("l_linenumber").select("l_linenumber", "l_partkey", "l_quantity")


@query("latest_caption", "B16", "SELECT conv_id, arg_max(text, turn) AS caption FROM conversations GROUP BY conv_id")
def latest_caption(t: Tables) -> DataFrame:
    return catalog.latest_by_id(t.conversations, "conv_id", "turn", "text", "caption")


def _item_labels(t: Tables, lines: DataFrame) -> DataFrame:
    samples = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("filename"))
    start = F.col("l_suppkey") * 100
    segments = lines.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("sample_id"), start.alias("start_ms"), (start + F.col("l_quantity").cast("long") * 10).alias("end_ms"), F.lit("auto").alias("detection_method"))
    return catalog.item_labels(samples, segments)


@query("item_labels", "B18 H3", "WITH s AS (SELECT p_partkey AS id, p_name AS filename FROM part), g AS (SELECT l_orderkey * 100 + l_linenumber AS id, l_partkey AS sample_id, l_suppkey * 100 AS a, l_suppkey * 100 + CAST(l_quantity AS BIGINT) * 10 AS b FROM lineitem) SELECT 'sample' AS kind, id, filename AS label FROM s UNION ALL SELECT 'segment', g.id, 'hit @ ' || CASE WHEN a < 60000 THEN CAST(a // 1000 AS VARCHAR) || '.' || lpad(CAST(a % 1000 AS VARCHAR), 3, '0') || ' s' ELSE CAST(a // 60000 AS VARCHAR) || ':' || lpad(CAST(a // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(a % 1000 AS VARCHAR), 3, '0') END || ' (' || CAST(b - a AS VARCHAR) || ' ms) in ' || filename FROM g JOIN s ON s.id = g.sample_id")
def item_labels(t: Tables) -> DataFrame:
    return _item_labels(t, t.lineitem)


@query("item_labels_whole", "B18 H3", "WITH g AS (SELECT l_orderkey * 100 + l_linenumber AS id, l_partkey AS sample_id, l_suppkey * 100 AS a, l_suppkey * 100 + CAST(l_quantity AS BIGINT) * 10 AS b FROM lineitem) SELECT 'sample' AS kind, p_partkey AS id, p_name AS label FROM part UNION ALL SELECT 'segment', g.id, 'hit @ ' || CASE WHEN a < 60000 THEN CAST(a // 1000 AS VARCHAR) || '.' || lpad(CAST(a % 1000 AS VARCHAR), 3, '0') || ' s' ELSE CAST(a // 60000 AS VARCHAR) || ':' || lpad(CAST(a // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(a % 1000 AS VARCHAR), 3, '0') END || ' (' || CAST(b - a AS VARCHAR) || ' ms) in ' || p_name FROM g JOIN part ON p_partkey = g.sample_id")
def item_labels_whole(t: Tables) -> DataFrame:
    """As item_labels, against SQL that is written another way."""
    return _item_labels(t, t.lineitem)


@query("child_rows", "B12", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus = 'O' THEN 'window' WHEN l_returnflag = 'A' THEN 'manual' ELSE 'hit' END AS type FROM lineitem")
def child_rows(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", catalog.child_type(F.col("l_linestatus") == "O", F.col("l_returnflag") == "A").alias("type"))


# Scopes and filters


@query("scope_prefix", "B3 B5", "SELECT page_id FROM pages WHERE starts_with(lower(url), 'https://m.') OR starts_with(lower(url), 'http://blog.')")
def scope_prefix(t: Tables) -> DataFrame:
    path = F.regexp_replace("url", "://(m|blog)\\.", "://$1/")
    return t.pages.where(filters.in_folders(path, ["HTTPS://m", "http://blog/"])).select("page_id")


@query("scope_empty", "B5", "SELECT doc_id FROM documents WHERE FALSE")
def scope_empty(t: Tables) -> DataFrame:
    return t.documents.where(filters.in_folders(F.col("source"), [])).select("doc_id")


@query("scope_none", "B5", "SELECT doc_id FROM documents")
def scope_none(t: Tables) -> DataFrame:
    return t.documents.where(filters.in_folders(F.col("source"), None)).select("doc_id")


_PATHS = "WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS path FROM pages UNION SELECT DISTINCT regexp_extract(url, '^[^/]*//[^/]*/[a-z]*', 0) FROM pages WHERE page_id % 3 = 0)"


def _paths(t: Tables) -> DataFrame:
    whole = t.pages.select(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", "").alias("path"))
    return whole.union(t.pages.where("page_id % 3 = 0").select(F.regexp_extract("url", "^[^/]*//[^/]*/[a-z]*", 0))).distinct()


@query("outermost_prefixes", "C16", _PATHS + " SELECT a.path FROM p a WHERE a.path <> '' AND NOT EXISTS (SELECT 1 FROM p b WHERE b.path <> '' AND a.path <> b.path AND starts_with(a.path, b.path || '/'))")
def outermost_prefixes(t: Tables) -> DataFrame:
    return filters.outermost(_paths(t).where("path <> ''"))


@query("folder_counts", "C15 F9", "WITH f AS (SELECT DISTINCT regexp_extract(url, '^[^/]*//[^/]*', 0) AS path FROM pages) SELECT path, (SELECT count(*) FROM pages WHERE starts_with(url, path || '/')) AS n FROM f")
def folder_counts(t: Tables) -> DataFrame:
    folders = t.pages.select(F.regexp_extract("url", "^[^/]*//[^/]*", 0).alias("path")).distinct()
    return filters.counts_under(folders, t.pages, path="url")


@query("inside_root", "B27 H5", "SELECT page_id, starts_with(url, 'https://m.') AS inside FROM pages")
def inside_root(t: Tables) -> DataFrame:
    path = F.regexp_replace("url", "://m\\.", "://m/")
    return t.pages.select("page_id", filters.inside(path, "https://m").alias("inside"))


@query("criteria_rows", "B6 B10", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_retailprice >= 950 AND p_size <= 30")
def criteria_rows(t: Tables) -> DataFrame:
    c = filters.criteria_of(types={"Brand#11", "Brand#12", "Brand#13"}, all_types=set(), ranges={"p_retailprice": (950.0, 0.0), "p_size": (0, 30)})
    return t.part.where(c.column(type_col="p_brand")).select("p_partkey")


@query("class_minimum", "B6 H22", _EV + " SELECT user_id FROM e WHERE event_type = 'click' AND score >= 0.5")
def class_minimum(t: Tables) -> DataFrame:
    rows = catalog.score_map(_event_scores(t), "user_id", "event_type", "score")
    return rows.where(filters.criteria_of(minima_percent={"click": 50}).column()).select("user_id")


@query("column_filter_text", "B7", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 're')")
def column_filter_text(t: Tables) -> DataFrame:
    return t.part.where(filters.ColumnFilter(text="RE").column(F.col("p_name"), F.lit(0))).select("p_partkey")


@query("column_filter_values", "B7", "SELECT p_partkey FROM part WHERE CAST(p_size AS VARCHAR) IN ('1', '7', '12')")
def column_filter_values(t: Tables) -> DataFrame:
    return t.part.where(filters.ColumnFilter(values=frozenset({"1", "7", "12"})).column(F.col("p_size"), F.col("p_size"))).select("p_partkey")


@query("column_filter_range", "B7", "SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_acctbal <= 5000")
def column_filter_range(t: Tables) -> DataFrame:
    """A raw value below 0 is no value, so it never lies in a range, not even one that is open below."""
    return t.customer.where(filters.ColumnFilter(high=5000.0).column(F.col("c_acctbal"), F.col("c_acctbal"))).select("c_custkey")


@query("any_column_contains", "B9 B8", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '1') OR contains(lower(c_mktsegment), '1') OR contains(lower(CAST(c_nationkey AS VARCHAR)), '1')")
def any_column_contains(t: Tables) -> DataFrame:
    return t.customer.where(filters.any_contains([F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")], "1")).select("c_custkey")


@query("distinct_values", "B30", "SELECT DISTINCT coalesce(p_brand, '') AS value FROM part")
def distinct_values(t: Tables) -> DataFrame:
    return filters.distinct_values(t.part, F.col("p_brand"))


@query("filtered_children", "B8 C23", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)")
def filtered_children(t: Tables) -> DataFrame:
    _, kids = filters.filtered(t.orders, t.lineitem.withColumnRenamed("l_orderkey", "parent"), F.col("o_totalprice") > 200000, key="o_orderkey")
    return kids.select(F.col("parent").alias("l_orderkey"), "l_linenumber", "l_partkey")


@query("visible_ids", "B29 B28", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity >= 49")
def visible_ids(t: Tables) -> DataFrame:
    return t.lineitem.where("l_quantity >= 49").select(F.col("l_orderkey").alias("id")).distinct()


@query("selection_parents", "B28 M2", "SELECT l_orderkey AS id, min(l_linenumber) AS position FROM lineitem WHERE l_tax > 0.05 GROUP BY 1")
def selection_parents(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_tax > 0.05").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("position"))
    return catalog.first_positions(rows, ["id"], "position")


# Order


@query("sorted_list", "F1 F4", "SELECT p_partkey, p_name FROM part ORDER BY lower(p_brand), coalesce(p_size, -1) DESC, p_name, p_partkey LIMIT 100")
def sorted_list(t: Tables) -> DataFrame:
    return t.part.orderBy(F.lower("p_brand"), F.coalesce("p_size", F.lit(-1)).desc(), "p_name", "p_partkey").limit(100).select("p_partkey", "p_name")


@query("anchor_first", "F2", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY (c_custkey = 7) DESC, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, -1) DESC, c_custkey) AS INTEGER) AS place FROM customer ORDER BY place LIMIT 50")
def anchor_first(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("score", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    top = rows.orderBy(*catalog.list_order(anchor=F.col("c_custkey") == 7, ties=["c_custkey"])).limit(50)
    place = F.row_number().over(Window.orderBy(*catalog.list_order(anchor=F.col("c_custkey") == 7, ties=["c_custkey"])))
    return top.select("c_custkey", place.alias("place"))


@query("worklist_in_order", "F5 C21", "WITH o AS (SELECT s_suppkey, s_nationkey AS position FROM supplier WHERE s_acctbal > 5000) SELECT s.s_suppkey, coalesce(o.position, 2147483647) AS position FROM supplier s LEFT JOIN o USING (s_suppkey)")
def worklist_in_order(t: Tables) -> DataFrame:
    order = t.supplier.where("s_acctbal > 5000").select("s_suppkey", F.col("s_nationkey").alias("position"))
    return catalog.worklist_order(t.supplier.select("s_suppkey"), order, "s_suppkey").orderBy("position", "s_suppkey").select("s_suppkey", "position")


@query("overlay_rows", "M3 C26", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'X' ELSE c_mktsegment END AS segment FROM customer")
def overlay_rows(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    changed = rows.where("c_custkey % 10 = 0").withColumn("segment", F.lit("X")).unionByName(t.spark.createDataFrame([(-5, "X")], "c_custkey long, segment string"))
    return catalog.overlaid(rows, changed, "c_custkey")


@query("staged_edits", "M5", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS start, CAST(100 AS INTEGER) AS \"end\", s_suppkey % 3 = 0 AS edited FROM supplier UNION ALL SELECT -1, 5, 9, TRUE")
def staged_edits(t: Tables) -> DataFrame:
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("start"), F.lit(100).alias("end"))
    edits = rows.where("id % 3 < 2").withColumn("start", F.when(F.col("id") % 3 == 0, F.col("start") + 1).otherwise(F.col("start")))
    return catalog.staged(rows, edits, t.spark.createDataFrame([(-1, 5, 9)], "id long, start int, end int"))


@query("positions_in_scope", "C22", "SELECT v.vec_id, round(v.embedding[1]::DOUBLE, 6) AS x FROM embeddings v JOIN orders o ON o.o_orderkey = v.vec_id WHERE o.o_orderstatus = 'O'")
def positions_in_scope(t: Tables) -> DataFrame:
    scope = t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("vec_id"))
    return t.embeddings.join(scope, "vec_id").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))


@query("list_positions", "F1", "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_name, p_partkey) AS place FROM part")
def list_positions(t: Tables) -> DataFrame:
    """Every part with its place in the whole list."""
    return places.in_order(t.part.select("p_partkey", "p_retailprice", "p_name"), [F.desc("p_retailprice"), F.col("p_name"), F.col("p_partkey")]).select("p_partkey", "place")
