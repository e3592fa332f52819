"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import arrays
from nearfield.functions import scalars as S
from nearfield.io import Tables
from nearfield.plans._registry import query


@query("tag_names", "H1", "SELECT c_custkey, nullif(trim(regexp_replace(' ' || c_mktsegment || '   ' || CAST(c_nationkey AS VARCHAR) || ' ', '\\s+', ' ', 'g')), '') AS tag FROM customer")
def tag_names(t: Tables) -> DataFrame:
    text = F.concat(F.lit(" "), "c_mktsegment", F.lit("   "), F.col("c_nationkey").cast("string"), F.lit(" "))
    return t.customer.select("c_custkey", S.normalised_tag(text).alias("tag"))


_BPM = "CASE WHEN TRY_CAST(nullif(regexp_extract(lower({n}), '(?:^|[^0-9])([0-9]{{2,3}})\\s*[-_ ]?\\s*bpm', 1), '') AS DOUBLE) BETWEEN 40 AND 240 THEN TRY_CAST(nullif(regexp_extract(lower({n}), '(?:^|[^0-9])([0-9]{{2,3}})\\s*[-_ ]?\\s*bpm', 1), '') AS DOUBLE) END"
_NAME = "p_name || '_' || CAST(p_size * 7 AS VARCHAR) || CASE p_partkey % 3 WHEN 0 THEN ' - BPM' WHEN 1 THEN '_bpm' ELSE '' END"


def _named(t: Tables) -> DataFrame:
    end = F.when(F.col("p_partkey") % 3 == 0, " - BPM").when(F.col("p_partkey") % 3 == 1, "_bpm").otherwise("")
    return t.part.withColumn("name", F.concat("p_name", F.lit("_"), (F.col("p_size") * 7).cast("string"), end))


@query("bpm_token", "H2", f"SELECT p_partkey, {_BPM.format(n='(' + _NAME + ')')} AS bpm FROM part")
def bpm_token(t: Tables) -> DataFrame:
    return _named(t).select("p_partkey", S.bpm_in_name(F.col("name")).alias("bpm"))


@query("labels_clock", "H3", "WITH e AS (SELECT event_id, event_id * 137 AS ms FROM events) SELECT event_id, CASE WHEN ms < 60000 THEN CAST(ms // 1000 AS VARCHAR) || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || ' s' ELSE CAST(ms // 60000 AS VARCHAR) || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') END AS label FROM e")
def labels_clock(t: Tables) -> DataFrame:
    return t.events.select("event_id", S.clock(F.col("event_id") * 137).alias("label"))


_DUR = "CASE WHEN {s} < 90 THEN CAST(CAST(round_even({s}, 0) AS BIGINT) AS VARCHAR) || ' s' WHEN {s} < 5400 THEN CAST(CAST(round_even({s} / 60, 0) AS BIGINT) AS VARCHAR) || ' min' ELSE CAST(CAST(floor({s} / 60) AS BIGINT) // 60 AS VARCHAR) || ' h ' || lpad(CAST(CAST(floor({s} / 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ' min' END"


@query("eta_text", "H4", "WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 30 AS elapsed, l_linenumber AS done, CAST(l_quantity AS BIGINT) AS total FROM lineitem), x AS (SELECT *, elapsed / done * (total - done) AS s FROM e) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN done <= 0 OR total <= done OR elapsed <= 0 THEN '' ELSE 'ETA ' || " + _DUR.format(s="s") + " END AS eta FROM x")
def eta_text(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.eta_text(F.col("l_quantity") * 30, F.col("l_linenumber"), F.col("l_quantity").cast("long")).alias("eta"))


@query("duration_text", "H4", "SELECT l_orderkey, l_linenumber, l_partkey, " + _DUR.format(s="(l_extendedprice / 10)") + " AS text FROM lineitem")
def duration_text(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.duration_text(F.col("l_extendedprice") / 10).alias("text"))


@query("path_parts", "H6", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, coalesce(nullif(lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '[^.](\\.[^.]+)$', 1)), ''), '<no-ext>') AS ext FROM pages")
def path_parts(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages.select("page_id", S.base_name(url).alias("name"), S.folder_of(url).alias("folder"), S.extension(url).alias("ext"))


@query("stamps", "H7", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, ts > TIMESTAMP '2024-01-15 00:00:00' AS late FROM events")
def stamps(t: Tables) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", F.date_format(ts, "yyyy-MM-dd HH:mm").alias("minute"), (ts > F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("late"))


@query("decibels", "H8 D22", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount <= 0 THEN -120 ELSE greatest(-120, 20 * log10(l_discount)) END, 6)::DOUBLE AS db FROM lineitem")
def decibels(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(S.decibels(F.col("l_discount")), 6).alias("db"))


@query("gated_logs", "H9 H10", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount > 0 THEN ln(l_discount) END, 6) AS a, round(CASE WHEN l_tax > 0 THEN log2(l_tax) END, 6) AS b, round(CASE WHEN l_quantity - 5 >= 0 THEN ln(1 + l_quantity - 5) END, 6) AS c FROM lineitem")
def gated_logs(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(S.ln_positive(F.col("l_discount")), 6).alias("a"), F.round(S.log2_positive(F.col("l_tax")), 6).alias("b"), F.round(S.log1p_nonnegative(F.col("l_quantity") - 5), 6).alias("c"))


@query("clip_and_ramp", "H11", "SELECT c_custkey, CASE WHEN c_nationkey > 3 THEN greatest(0, least(1000, c_acctbal)) END AS clipped, round(greatest(0, least(1, c_acctbal / 10000)) * 40 + 10, 6) AS ramp FROM customer")
def clip_and_ramp(t: Tables) -> DataFrame:
    x = F.when(F.col("c_nationkey") > 3, F.col("c_acctbal"))
    return t.customer.select("c_custkey", S.clip(x, 0.0, 1000.0).alias("clipped"), F.round(S.along(F.col("c_acctbal") / 10000, 10.0, 50.0), 6).alias("ramp"))


@query("unit_lengths", "H12", "SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice * p_size / 100 ELSE p_size END, 6)::DOUBLE AS length FROM part")
def unit_lengths(t: Tables) -> DataFrame:
    unit = F.when(F.col("p_partkey") % 2 == 0, "%").otherwise("s")
    return t.part.select("p_partkey", F.round(S.resolved(F.col("p_size").cast("double"), unit, F.col("p_retailprice")), 6).alias("length"))


_ALIGNED = "CASE WHEN {b} > 0 AND {d} > 0 AND round_even({d} * {b} / 60, 0) >= 4 AND abs({d} * {b} / 60 - round_even({d} * {b} / 60, 0)) <= {tol} AND round_even({d} * {b} / 60, 0) * 60 / {d} BETWEEN 40 AND 240 THEN round_even({d} * {b} / 60, 0) * 60 / {d} END"


@query("whole_beats", "H13", "SELECT p_partkey, round(" + _ALIGNED.format(b="(60 + p_size)", d="(p_retailprice / 100)", tol="0.15") + ", 6) AS tempo FROM part")
def whole_beats(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(S.beat_aligned(F.col("p_retailprice") / 100, F.col("p_size") + 60), 6).alias("tempo"))


@query("beat_tempo", "H14", "SELECT p_partkey, round(CASE WHEN p_partkey % 4 <> 0 AND p_size > 0 AND p_size / (p_retailprice / 100) * 60 BETWEEN 40 AND 240 THEN p_size / (p_retailprice / 100) * 60 END, 6) AS tempo FROM part")
def beat_tempo(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(S.tempo_of_beats(F.col("p_size"), F.col("p_retailprice") / 100, F.col("p_partkey") % 4 == 0), 6).alias("tempo"))


_D = "(p_retailprice / 100)"
_COUNTED = f"CASE WHEN p_partkey % 5 = 0 AND p_size > 0 AND p_size / {_D} * 60 BETWEEN 40 AND 240 THEN p_size / {_D} * 60 END"
_NAMED = f"CASE WHEN p_size % 4 >= 1 THEN {_ALIGNED.format(b='(' + _BPM.format(n='(' + _NAME + ')') + ')', d=_D, tol='0.10')} END"


@query(
    "loop_verdict",
    "H15 H16",
    f"WITH v AS (SELECT p_partkey, p_size, {_D} AS d, p_partkey % 11 = 0 AS one_shot, p_partkey % 7 = 0 AS flagged, coalesce({_COUNTED}, {_NAMED}) AS tempo FROM part), l AS (SELECT *, NOT one_shot AND (tempo IS NOT NULL OR flagged) AS is_loop FROM v) SELECT p_partkey, is_loop, round(CASE WHEN NOT one_shot THEN tempo END, 6) AS tempo, CASE WHEN is_loop THEN 'loop' WHEN p_size % 4 <= 1 AND d <= 12 THEN 'one-shot' ELSE 'multi-hit' END AS kind FROM l",
)
def loop_verdict(t: Tables) -> DataFrame:
    onsets, duration = F.col("p_size") % 4, F.col("p_retailprice") / 100
    none = F.lit(None).cast("double")
    v = S.loop_verdict(one_shot=F.col("p_partkey") % 11 == 0, beats=F.when(F.col("p_partkey") % 5 == 0, F.col("p_size")), flagged=F.col("p_partkey") % 7 == 0, duration=duration, name=F.col("name"), onset_count=onsets, acoustic=none)
    rows = _named(t).withColumn("v", v)
    return rows.select("p_partkey", F.col("v.is_loop").alias("is_loop"), F.round("v.tempo", 6).alias("tempo"), S.structural_type(F.col("v.is_loop"), onsets, duration, 12.0).alias("kind"))


@query("structural_type", "H16", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus = 'O' THEN 'loop' WHEN l_linenumber <= 1 AND l_tax <= 0.04 THEN 'one-shot' ELSE 'multi-hit' END AS kind, CASE WHEN l_linestatus = 'O' THEN 'loop' WHEN l_linenumber <= 1 THEN 'one-shot' ELSE 'multi-hit' END AS uncapped FROM lineitem")
def structural_type(t: Tables) -> DataFrame:
    loop, n, d = F.col("l_linestatus") == "O", F.col("l_linenumber"), F.col("l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.structural_type(loop, n, d, 0.04).alias("kind"), S.structural_type(loop, n, d, None).alias("uncapped"))


@query("detection_profile", "H17", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'loose' WHEN p_size % 3 = 1 AND (p_partkey % 2 = 0 OR p_brand = 'Brand#13') THEN 'tight' WHEN p_size % 3 = 1 THEN 'loose' WHEN p_partkey % 2 = 0 OR p_brand = 'Brand#13' THEN 'tight' ELSE 'loose' END AS profile FROM part")
def detection_profile(t: Tables) -> DataFrame:
    chosen = F.when(F.col("p_size") % 3 == 0, "loose").otherwise("auto")
    kind = F.when(F.col("p_partkey") % 2 == 0, "loop").otherwise("multi-hit")
    content = F.when(F.col("p_brand") == "Brand#13", "rhythmic")
    return t.part.select("p_partkey", S.detection_profile(chosen, kind, content).alias("profile"))


@query("root_keys", "H18", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size * 3 < 128 THEN (['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'])[(p_size * 3) % 12 + 1] END AS key FROM part")
def root_keys(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.key_of_root(F.col("p_partkey") % 2 == 0, F.col("p_size") * 3).alias("key"))


@query("json_lists", "H20 H23", "WITH j AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[1.5, 2, 3]' WHEN 1 THEN '[1, 2]' WHEN 2 THEN 'broken' ELSE '[' || CAST(event_id AS VARCHAR) || ', 0, 1]' END AS t FROM events) SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1.5 WHEN 3 THEN event_id END::DOUBLE AS first FROM j")
def json_lists(t: Tables) -> DataFrame:
    r = F.col("event_id") % 4
    text = F.when(r == 0, "[1.5, 2, 3]").when(r == 1, "[1, 2]").when(r == 2, "broken").otherwise(F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(", 0, 1]")))
    return t.events.select("event_id", arrays.from_json_list(text, 3)[0].alias("first"))


@query("json_props", "H23", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("crops", "H21", "SELECT vec_id, len(embedding[1:greatest(0, least(64, label * 10))]) AS n FROM embeddings")
def crops(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.size(arrays.cropped(F.col("embedding"), F.least(F.lit(64), F.col("label") * 10))).cast("long").alias("n"))


@query("softmax", "H24", "WITH s AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE) * 5) AS s FROM embeddings) SELECT vec_id, round(exp(s[1] - list_max(s)) / list_sum(list_transform(s, lambda x: exp(x - list_max(s)))), 6) AS p FROM s")
def softmax(t: Tables) -> DataFrame:
    s = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 5)
    return t.embeddings.select("vec_id", F.round(arrays.softmax(s)[0], 6).alias("p"))


@query("shown_cells", "B11", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'unreadable' ELSE p_brand END AS type, CASE WHEN p_size > 40 THEN '' ELSE printf('%.2f s', p_size / 4.0) END AS length, CASE WHEN p_size % 2 = 0 THEN '' ELSE CAST(CAST(round_even(p_size / 2.0, 0) AS BIGINT) AS VARCHAR) END AS bpm, CASE WHEN p_size % 5 = 0 THEN '' ELSE CAST(p_size % 5 AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN '!' ELSE '' END END AS hits FROM part")
def shown_cells(t: Tables) -> DataFrame:
    seconds = F.when(F.col("p_size") <= 40, F.col("p_size") / 4.0)
    tempo = F.when(F.col("p_size") % 2 != 0, F.col("p_size") / 2.0)
    hits = F.col("p_size") % 5
    cell = F.when(hits == 0, "").otherwise(F.concat(hits.cast("string"), F.when(F.col("p_partkey") % 2 == 0, "!").otherwise("")))
    return t.part.select("p_partkey", F.when(seconds.isNull(), "unreadable").otherwise(F.col("p_brand")).alias("type"), S.seconds_text(seconds).alias("length"), S.whole_text(tempo).alias("bpm"), cell.alias("hits"))


@query("segment_table", "M1", "SELECT event_id, CAST(event_id * 250 // 1000 AS VARCHAR) || '.' || lpad(CAST(event_id * 250 % 1000 AS VARCHAR), 3, '0') || ' s' AS start, CAST(user_id AS VARCHAR) || ' ms' AS length, CASE WHEN event_id % 3 = 0 THEN -1 ELSE value END::DOUBLE AS strength FROM events")
def segment_table(t: Tables) -> DataFrame:
    strength = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return t.events.select("event_id", S.seconds_text(F.col("event_id") * 250 / 1000, 3).alias("start"), F.concat(F.col("user_id").cast("string"), F.lit(" ms")).alias("length"), F.coalesce(strength, F.lit(-1.0)).alias("strength"))


@query("tick_steps", "E14", "SELECT p_partkey, CASE WHEN 800 * 0.1 / p_size >= 70 THEN 0.1 WHEN 800 * 1.0 / p_size >= 70 THEN 1 WHEN 800 * 5.0 / p_size >= 70 THEN 5 ELSE 30 END::DOUBLE AS step FROM part")
def tick_steps(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.tick_step(F.col("p_size").cast("double"), F.lit(800.0), [0.1, 1, 5, 30]).alias("step"))


@query("content_hashes", "A6", "SELECT page_id, sha256(html) AS digest FROM pages")
def content_hashes(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha2("html", 256).alias("digest"))


@query("fades", "A16", "SELECT vec_id, round((embedding[1] * 0)::DOUBLE, 6) + 0.0 AS first, round(embedding[2]::DOUBLE * 1, 6) AS second, round(embedding[64]::DOUBLE * 0, 6) + 0.0 AS last FROM embeddings")
def fades(t: Tables) -> DataFrame:
    """At 1000 Hz the rise takes two values and the fall twenty."""
    y = arrays.faded(F.col("embedding").cast("array<double>"), 1000)
    return t.embeddings.select("vec_id", *((F.round(y[i], 6) + 0.0).alias(n) for i, n in ((0, "first"), (1, "second"), (63, "last"))))


@query("fade_ramps", "A16", "SELECT vec_id, round(embedding[4]::DOUBLE * (3 / 9.0::DOUBLE), 7) AS rising, round(embedding[21]::DOUBLE, 7) AS whole, round(embedding[41]::DOUBLE * (1 - 8 / 31.0::DOUBLE), 7) AS falling, round(embedding[63]::DOUBLE * (1 - 30 / 31.0::DOUBLE), 7) AS last FROM embeddings")
def fade_ramps(t: Tables) -> DataFrame:
    """At 5000 Hz the rise takes ten values and the fall half the signal."""
    y = arrays.faded(F.col("embedding").cast("array<double>"), 5000)
    return t.embeddings.select("vec_id", *(F.round(y[i], 7).alias(n) for i, n in ((3, "rising"), (20, "whole"), (40, "falling"), (62, "last"))))


@query("uneven_grid", "D25", "WITH o AS (SELECT vec_id, unnest(range(0, 8)) AS i FROM embeddings), p AS (SELECT vec_id, (i * 0.5 + CASE WHEN i < vec_id % 5 THEN 0.05 ELSE 0 END) / 0.125 % 1.0 AS p FROM o), m AS (SELECT vec_id, atan2(avg(sin(p * 2 * pi())), avg(cos(p * 2 * pi()))) / (2 * pi()) AS m FROM p GROUP BY vec_id) SELECT p.vec_id, round(avg((abs((p - m + 1.5) % 1.0 - 0.5) <= 0.15)::INT), 6) AS fit FROM p JOIN m USING (vec_id) GROUP BY p.vec_id")
def uneven_grid(t: Tables) -> DataFrame:
    """Eight clicks of which some come late: the share on the grid of best phase."""
    onsets = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i * 0.5 + F.when(i < F.col("vec_id") % 5, 0.05).otherwise(0.0))
    return t.embeddings.select("vec_id", F.round(S.grid_fit(onsets, F.lit(120.0)), 6).alias("fit"))


@query("beat_grid", "D25 H15", "WITH o AS (SELECT vec_id, list_transform(range(0, 8), lambda i: i * 0.5 + 0.01 * (vec_id % 5)) AS o FROM embeddings) SELECT vec_id, 1.0::DOUBLE AS fit, round(120.0, 6)::DOUBLE AS tempo FROM o")
def beat_grid(t: Tables) -> DataFrame:
    """Clicks of even distance lie on their grid whatever their phase; four seconds of them are 120 beats a minute."""
    onsets = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i * 0.5 + F.col("vec_id") % 5 * 0.01)
    n = F.lit(None).cast("double")
    tempo = S.acoustic_tempo(F.lit(4.0), F.lit(8), F.lit(0.9), onsets, F.lit(121.0), n)
    return t.embeddings.select("vec_id", F.round(S.grid_fit(onsets, F.lit(120.0)), 6).alias("fit"), F.round(tempo, 6).alias("tempo"))
