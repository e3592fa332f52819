"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import bpe, chat, fingerprint, jaccard, linededup, merkle, mixing, quality, runs, sharding, simhash, topk, urlfilter
from nearfield.llm._io import table


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as chosen, against itself with its neighbour's last answer as rejected."""
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "pair_id")
    swapped = chat.with_swapped_answer(turns.withColumnRenamed("pair_id", "conv_id")).withColumnRenamed("conv_id", "pair_id")
    return chat.formatted(turns, swapped)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 3-word shingle sets are similar by 0.9 at least."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=90)


def op3_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    out = sharding.sharded(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, and digests of its ids and of what they decode to."""
    return bpe.encode(table(spark, sf_dir, "documents"), tokens=False, digests=True)


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are."""
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op7_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list entries that were active at its fetch time."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = urlfilter.judged(urlfilter.dated_captures(pages), urlfilter.sample_entries(pages), day="fetched_at", entry_time="at")
    return out.withColumn("fetched_at", F.unix_seconds("fetched_at"))


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade and tail probability, and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_rated(docs, quality.grades(table(spark, sf_dir, "labels")), n_grades=quality.N_GRADES)
    out = quality.scored(docs, model)
    return out.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= quality.MIN_TAIL).alias("keep"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of repeated line runs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.without_later_copies(docs, counts=True)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mixture of half of all tokens takes, at most twice each, by domain, language and source weights."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    levels = {"domain": mixing.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    weights = {"domain": mixing.DOMAIN_WEIGHTS, "lang": mixing.LANG_WEIGHTS}
    out = mixing.mixed(docs, levels, weights, percent=50, max_epochs=2, copies="copies", tokens="n_tokens")
    return out.select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and root, and whether it still proves after some texts were tampered with."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    text = F.when(tampered, F.translate("text", ascii_uppercase, ascii_lowercase)).otherwise(F.col("text"))
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    return merkle.verified(docs, merkle.leaf_of(*fields, F.col("text")), merkle.leaf_of(*fields, text))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every text (one in ten made periodic), the longest one, and what is left without repeats."""
    return runs.described(table(spark, sf_dir, "documents"), periodic=True)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose SimHash fingerprints differ in 4 bits at most."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, radius=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_preference_format, op2_jaccard_join, op3_slot_sharding, op4_exact_topk, op5_bpe_round_trip, op6_order_minhash, op7_temporal_url_filter, op8_ordinal_quality, op9_line_dedup, op10_mix_sources, op11_merkle_manifest, op12_periodic_runs, op13_simhash)
}

_OP1 = """
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
last AS (SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS answer FROM turns WHERE role = 'assistant' GROUP BY conv_id),
swapped AS (
  SELECT t.conv_id, t.turn, t.role, CASE WHEN t.role = 'assistant' AND t.turn = l.last_turn AND o.answer IS NOT NULL THEN o.answer ELSE t.text END AS text
  FROM turns t LEFT JOIN last l ON l.conv_id = t.conv_id LEFT JOIN last o ON o.conv_id = xor(t.conv_id, 1)),
sides AS (
  SELECT conv_id, 0 AS side, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM turns
  UNION ALL
  SELECT conv_id, 1, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) FROM swapped),
differ AS (
  SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, min(coalesce(a.pos, b.pos)) AS pos
  FROM (SELECT * FROM sides WHERE side = 0) a FULL JOIN (SELECT * FROM sides WHERE side = 1) b ON a.conv_id = b.conv_id AND a.pos = b.pos
  WHERE a.text IS NULL OR b.text IS NULL OR a.role <> b.role OR a.text <> b.text GROUP BY 1),
sizes AS (SELECT conv_id, count(*) AS n FROM sides WHERE side = 0 GROUP BY conv_id),
prefix AS (SELECT s.conv_id, coalesce(d.pos - 1, s.n) AS n, d.pos IS NULL AS tie FROM sizes s LEFT JOIN differ d USING (conv_id)),
shown AS (
  SELECT s.*, p.n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS whole, length('<|im_start|>' || role || chr(10)) AS head
  FROM sides s JOIN prefix p USING (conv_id)),
ends AS (SELECT *, sum(length(whole)) OVER (PARTITION BY conv_id, side ORDER BY pos) AS upto FROM shown WHERE pos > n)
SELECT p.conv_id AS pair_id, CAST(p.n AS INTEGER) AS prompt_turns,
  coalesce((SELECT string_agg(whole, '' ORDER BY pos) FROM shown s WHERE s.conv_id = p.conv_id AND side = 0 AND pos <= s.n), '') AS prompt,
  coalesce(e.chosen, '') AS chosen, coalesce(e.rejected, '') AS rejected, coalesce(e.chosen_mask, '') AS chosen_mask, coalesce(e.rejected_mask, '') AS rejected_mask, p.tie
FROM prefix p LEFT JOIN (
  SELECT conv_id,
    string_agg(whole, '' ORDER BY pos) FILTER (side = 0) AS chosen, string_agg(whole, '' ORDER BY pos) FILTER (side = 1) AS rejected,
    string_agg(CAST(upto - length(whole) + head AS VARCHAR) || '-' || CAST(upto AS VARCHAR), ',' ORDER BY pos) FILTER (side = 0 AND role = 'assistant') AS chosen_mask,
    string_agg(CAST(upto - length(whole) + head AS VARCHAR) || '-' || CAST(upto AS VARCHAR), ',' ORDER BY pos) FILTER (side = 1 AND role = 'assistant') AS rejected_mask
  FROM ends GROUP BY conv_id) e USING (conv_id)
"""

_OP2 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
classes AS MATERIALIZED (SELECT md5(array_to_string(list_sort(s), chr(10))) AS c, min(doc_id) AS rep, any_value(len(s)) AS n, any_value(s) AS s FROM sets WHERE len(s) > 0 GROUP BY 1),
grams AS MATERIALIZED (SELECT rep, n, unnest(s) AS g FROM classes),
pairs AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT rep AS node, rep AS other FROM classes UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.component, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON len(s.s) > 0 AND md5(array_to_string(list_sort(s.s), chr(10))) = c.c
LEFT JOIN (SELECT node, min(other) AS component FROM reach GROUP BY node) m ON m.node = c.rep
"""

_OP4 = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
scores AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, v.e), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0) AS BIGINT) AS score FROM q JOIN v ON q.vec_id <> v.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

_OP7 = r"""
WITH parts AS (
  SELECT page_id, url, CAST(1672531200 + (page_id * 37) % 730 * 86400 + (page_id * 7919) % 86400 AS BIGINT) AS fetched_at,
    lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')) AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS segs
  FROM pages),
named AS (
  SELECT DISTINCT *, md5(list || '|' || pattern) AS m FROM (
    SELECT 'unsafe' AS list, 'domain' AS kind, host AS pattern FROM parts WHERE host <> ''
    UNION ALL SELECT 'parked', 'domain', array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') FROM parts WHERE len(string_split(host, '.')) > 2
    UNION ALL SELECT 'spam', 'prefix', host || '/' || segs[1] FROM parts WHERE host <> '' AND len(segs) > 0)),
listed AS (SELECT *, 1672531200 + CAST('0x' || substr(m, 2, 3) AS BIGINT) % 600 * 86400 + CAST('0x' || substr(m, 9, 4) AS BIGINT) AS sec FROM named WHERE CAST('0x' || substr(m, 1, 1) AS INTEGER) < 6),
entries AS (
  SELECT list, kind, pattern, 'add' AS action, sec FROM listed
  UNION SELECT list, kind, pattern, 'remove', sec + 86400 * CAST('0x' || substr(m, 6, 2) AS BIGINT) FROM listed WHERE CAST('0x' || substr(m, 5, 1) AS INTEGER) < 8
  UNION SELECT list, kind, pattern, 'add', sec + 86400 * (CAST('0x' || substr(m, 6, 2) AS BIGINT) + 90) FROM listed WHERE CAST('0x' || substr(m, 5, 1) AS INTEGER) < 3),
hits AS (
  SELECT DISTINCT p.page_id, e.list
  FROM parts p JOIN entries e ON (e.kind = 'domain' AND ('.' || p.host) LIKE ('%.' || e.pattern)) OR (e.kind = 'prefix' AND starts_with(p.host || '/' || array_to_string(p.segs, '/') || '/', e.pattern || '/'))
  WHERE e.sec <= p.fetched_at AND p.host <> ''
  GROUP BY p.page_id, e.list, e.kind, e.pattern
  HAVING arg_max(e.action, CAST(e.sec AS VARCHAR) || e.action) = 'add')
SELECT p.page_id, p.url, p.fetched_at, count(h.list) > 0 AS blocked, coalesce(string_agg(h.list, ',' ORDER BY h.list), '') AS lists
FROM parts p LEFT JOIN hits h USING (page_id) GROUP BY p.page_id, p.url, p.fetched_at
"""

_OP9 = r"""
WITH split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL),
lines AS MATERIALIZED (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY line) AS upto, count(*) OVER (PARTITION BY doc_id) AS n
  FROM (SELECT *, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS w FROM split)),
runs AS MATERIALIZED (
  SELECT a.doc_id, a.line AS s, min(b.line) AS e FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.line >= a.line AND b.upto - a.upto + a.w >= 50 GROUP BY 1, 2
  UNION
  SELECT b.doc_id, max(a.line), b.line FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.line >= a.line AND b.upto - a.upto + a.w >= 50 GROUP BY b.doc_id, b.line),
texts AS (SELECT r.doc_id, r.s, r.e, md5(string_agg(l.l, chr(10) ORDER BY l.line)) AS t FROM runs r JOIN lines l ON l.doc_id = r.doc_id AND l.line BETWEEN r.s AND r.e GROUP BY 1, 2, 3),
later AS (SELECT *, row_number() OVER (PARTITION BY t, e - s ORDER BY doc_id, s) AS nth FROM texts),
gone AS (SELECT DISTINCT l.doc_id, l.line FROM lines l JOIN later r ON r.doc_id = l.doc_id AND l.line BETWEEN r.s AND r.e WHERE r.nth > 1)
SELECT l.doc_id, coalesce(string_agg(l.l, chr(10) ORDER BY l.line) FILTER (g.line IS NULL), '') AS text, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(g.line) AS INTEGER) AS n_removed
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""

_OP10 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(coalesce(TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1), '') AS BIGINT), 0) % 4 AS VARCHAR) AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS supply FROM d GROUP BY ALL),
b0 AS (SELECT floor(sum(supply) * 50 / 100) AS budget FROM leaf),
n1 AS (SELECT domain, CAST(sum(supply) * 2 AS DOUBLE) AS cap, CASE domain WHEN '0' THEN 4.0 WHEN '1' THEN 3.0 WHEN '2' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM leaf GROUP BY domain),
f1 AS (SELECT *, (b.budget - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM n1, b0 b),
b1 AS (SELECT domain, CASE WHEN lv < cap / w THEN greatest(0, w * max(CASE WHEN lv < cap / w THEN lv END) OVER ()) ELSE cap END AS budget FROM f1),
n2 AS (SELECT l.domain, lang, CAST(sum(supply) * 2 AS DOUBLE) AS cap, CASE lang WHEN 'en' THEN 5.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 ELSE 1.0 END::DOUBLE AS w, any_value(budget) AS budget FROM leaf l JOIN b1 USING (domain) GROUP BY l.domain, lang),
f2 AS (SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM n2),
b2 AS (SELECT domain, lang, CASE WHEN lv < cap / w THEN greatest(0, w * max(CASE WHEN lv < cap / w THEN lv END) OVER (PARTITION BY domain)) ELSE cap END AS budget FROM f2),
n3 AS (SELECT l.domain, l.lang, source, CAST(supply * 2 AS DOUBLE) AS cap, 1.0::DOUBLE AS w, budget, supply FROM leaf l JOIN b2 ON l.domain = b2.domain AND l.lang = b2.lang),
f3 AS (SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM n3),
b3 AS (SELECT domain, lang, source, supply, CAST(round(CASE WHEN lv < cap / w THEN greatest(0, w * max(CASE WHEN lv < cap / w THEN lv END) OVER (PARTITION BY domain, lang)) ELSE cap END) AS BIGINT) AS own FROM f3),
plan AS (SELECT *, CASE WHEN supply > 0 THEN own // supply ELSE 0 END AS full_epochs FROM b3),
ordered AS (
  SELECT d.*, p.full_epochs, p.own - p.full_epochs * p.supply AS rest,
    coalesce(sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('7:' || CAST(p.full_epochs AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN plan p ON d.domain = p.domain AND d.lang = p.lang AND d.source = p.source)
SELECT doc_id, domain, lang, source, n_tokens, CAST(full_epochs + CASE WHEN rest > 0 AND before < rest THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM ordered WHERE full_epochs > 0 OR (rest > 0 AND before < rest)
"""

#: CRC-32 of the decimal digits of doc_id, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_concat([xor(a, b)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))))"""


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"


_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))

_OP11 = f"""
WITH RECURSIVE seen AS (SELECT *, CASE WHEN {_CRC} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS shown FROM documents),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, sha256({_HEAD} || {_field("text")}) AS leaf, sha256({_HEAD} || {_field("shown")}) AS claimed FROM seen)),
nodes AS (
  SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM leaves
  UNION ALL SELECT tree, any_value(lvl) + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, pos // 8),
kept AS MATERIALIZED (SELECT * FROM nodes),
upper_ AS (
  SELECT 0 AS lvl, tree AS pos, count(*) OVER () AS n, h FROM kept WHERE n = 1
  UNION ALL SELECT any_value(lvl) + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY pos)) FROM upper_ WHERE n > 1 GROUP BY pos // 8),
over AS MATERIALIZED (SELECT * FROM upper_),
low AS (
  SELECT tree, pos AS own, 0 AS lvl, pos, n, claimed AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT f.tree, f.own, any_value(f.lvl) + 1, any_value(f.pos // 8), any_value((f.n + 7) // 8), sha256(string_agg(CASE WHEN s.pos = f.pos THEN f.h ELSE s.h END, '' ORDER BY s.pos)),
    any_value(f.proof) || coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos <> f.pos), '')
  FROM low f JOIN kept s ON s.tree = f.tree AND s.lvl = f.lvl AND s.pos // 8 = f.pos // 8 WHERE f.n > 1 GROUP BY f.tree, f.own),
high AS (
  SELECT tree, own, 0 AS lvl, tree AS pos, (SELECT any_value(n) FROM over WHERE lvl = 0) AS n, h, proof FROM low WHERE n = 1
  UNION ALL
  SELECT f.tree, f.own, any_value(f.lvl) + 1, any_value(f.pos // 8), any_value((f.n + 7) // 8), sha256(string_agg(CASE WHEN s.pos = f.pos THEN f.h ELSE s.h END, '' ORDER BY s.pos)),
    any_value(f.proof) || coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos <> f.pos), '')
  FROM high f JOIN over s ON s.lvl = f.lvl AND s.pos // 8 = f.pos // 8 WHERE f.n > 1 GROUP BY f.tree, f.own)
SELECT l.doc_id, l.leaf, k.h AS subroot, o.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root, g.h = o.h AS verified
FROM leaves l JOIN kept k ON k.tree = l.tree AND k.n = 1 JOIN over o ON o.n = 1 JOIN high g ON g.tree = l.tree AND g.own = l.pos AND g.n = 1
"""

_OP12 = rf"""
WITH split AS (SELECT doc_id, {_CRC} AS h, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
ruled AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM split),
made AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE w END AS w FROM ruled),
words AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM made),
pairs AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.word = b.word AND a.i < b.i),
enough AS (SELECT * FROM pairs QUALIFY count(*) OVER (PARTITION BY doc_id, q) >= greatest(q, 12 - q)),
streaks AS (SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM enough) GROUP BY doc_id, q, g HAVING count(*) >= greatest(q, 12 - q)),
runs AS MATERIALIZED (SELECT doc_id, s, e - s AS len, min(q) AS q FROM streaks GROUP BY doc_id, s, e),
listed AS (SELECT doc_id, count(*) AS n_runs, arg_max(struct_pack(s := s, len := len, q := q), (len, -s, -q)) AS best, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS shown FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS rest FROM words w WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = w.doc_id AND w.i >= r.s + r.q AND w.i < r.s + r.len) GROUP BY doc_id)
SELECT d.doc_id, coalesce(l.n_runs, 0) AS n_runs, CAST(l.best.s AS BIGINT) AS start, CAST(l.best.len AS BIGINT) AS length, CAST(l.best.q AS BIGINT) AS period, CAST(1000 * l.best.len // l.best.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(l.shown, '')) AS runs_sha256, sha256(coalesce(k.rest, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op1_preference_format": _OP1, "op2_jaccard_join": _OP2, "op4_exact_topk": _OP4, "op7_temporal_url_filter": _OP7, "op9_line_dedup": _OP9, "op10_mix_sources": _OP10, "op11_merkle_manifest": _OP11, "op12_periodic_runs": _OP12}
