"""Events of a user in order of time, cut, merged and measured."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.io import Tables
from nearfield.operators import intervals as I  # noqa: E741
from nearfield.plans._registry import query

_US = "epoch_us(ts)"


def _events(t: Tables) -> DataFrame:
    """user_id, us (microseconds), frame (0, 1, .. in order), value."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("user_id", us.alias("us"), "value", (F.row_number().over(w) - 1).alias("frame"))


_FRAMES = f"WITH f AS (SELECT user_id, {_US} AS us, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events)"
_STRONG = _FRAMES + ", m AS (SELECT *, max(value) OVER (PARTITION BY user_id) AS top FROM f), s AS (SELECT user_id, us, value / top AS strength FROM m WHERE top > 0 AND value >= top * 0.15)"
_HOUR = 3_600_000_000


def _cut(end: str, least: int, most: int) -> str:
    return _STRONG + f""", b AS (SELECT *, {end} AS e0 FROM s), c AS (SELECT user_id, us, strength, CASE WHEN least(e0, us + {_HOUR * 1000}) - us > {most} THEN us + {most} ELSE least(e0, us + {_HOUR * 1000}) END AS e FROM b),
k AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS found, row_number() OVER (PARTITION BY user_id ORDER BY strength DESC, us) AS r FROM c WHERE e - us >= {least}),
o AS (SELECT *, found > 5 AS capped FROM k WHERE r <= 5)
SELECT user_id, us AS start, e AS "end", round(strength, 6) AS strength, found, capped, round(CASE WHEN capped THEN min(strength) OVER (PARTITION BY user_id) END, 6) AS effective FROM o"""


def _boundaries(t: Tables, mode: str, least: int, most: int) -> DataFrame:
    rows = I.strong(_events(t).drop("frame"), "user_id", "value", 0.15)
    rules = I.Segmentation(boundary=mode, min_length=float(least), max_length=float(most))
    whole = F.col("us") + _HOUR * 1000
    out = I.boundaries(rows, "user_id", "us", "value", whole, rules)
    return out.select("user_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.round("strength", 6).alias("strength"), "found", "capped", F.round("effective", 6).alias("effective"))


@query("segments_boundaries", "E1 E3 D20", _cut(f"coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY us), us + {_HOUR * 1000})", _HOUR, 48 * _HOUR))
def segments_boundaries(t: Tables) -> DataFrame:
    return _boundaries(t, "transient", _HOUR, 48 * _HOUR)


@query("segments_fixed_length", "E1 D20", _cut(f"us + {6 * _HOUR}", _HOUR, 6 * _HOUR))
def segments_fixed_length(t: Tables) -> DataFrame:
    return _boundaries(t, "fixed", _HOUR, 6 * _HOUR)


@query("strong_events", "E3", _STRONG + " SELECT user_id, us, round(strength, 6) AS strength FROM s")
def strong_events(t: Tables) -> DataFrame:
    return I.strong(_events(t).drop("frame"), "user_id", "value", 0.15).select("user_id", "us", F.round("value", 6).alias("strength"))


@query(
    "merge_close",
    "E2",
    f"WITH a AS (SELECT user_id, list({{'t': CAST({_US} AS DOUBLE), 's': value}} ORDER BY {_US}) AS l FROM events GROUP BY user_id), r AS (SELECT user_id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, e: CASE WHEN e[1].t - acc[len(acc)].t < 36000000000 THEN list_concat(acc[1:len(acc) - 1], [{{'t': acc[len(acc)].t, 's': greatest(acc[len(acc)].s, e[1].s)}}]) ELSE list_concat(acc, e) END) AS m FROM a) SELECT user_id, CAST(len(m) AS BIGINT) AS n, round(list_sum(list_transform(m, lambda x: x.s)), 4) AS total, CAST(m[len(m)].t AS BIGINT) AS last FROM r",
)
def merge_close(t: Tables) -> DataFrame:
    m = I.merged_close(_events(t), "user_id", "us", "value", 36000000000.0)
    return m.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("s"), 4).alias("total"), F.max("t").cast("long").alias("last"))


@query("dominant_onsets", "E4", _FRAMES + ", m AS (SELECT *, max(value) OVER (PARTITION BY user_id) AS top, max(value) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM f) SELECT user_id, us FROM m WHERE value >= top * 0.3 AND (top <= 0 OR near >= top * 0.2)")
def dominant_onsets(t: Tables) -> DataFrame:
    return I.dominant(_events(t), "user_id", "frame", "value", "value").select("user_id", "us")


@query(
    "loud_onsets",
    "E4",
    f"WITH e AS (SELECT user_id, {_US} / 1000000.0::DOUBLE AS t, event_type, value FROM events), o AS (SELECT *, max(value) OVER (PARTITION BY user_id) AS top FROM e WHERE event_type = 'click'), l AS (SELECT user_id, t, value AS level FROM e WHERE event_type <> 'click'), m AS (SELECT user_id, max(level) AS loudest FROM l GROUP BY user_id), "
    "n AS (SELECT o.user_id, o.t, o.value, any_value(loudest) AS loudest, max(level) AS near FROM o LEFT JOIN m ON m.user_id = o.user_id LEFT JOIN l ON l.user_id = o.user_id AND l.t BETWEEN o.t - 43200 AND o.t + 43200 WHERE o.value >= o.top * 0.3 GROUP BY o.user_id, o.t, o.value) "
    "SELECT user_id, t, value FROM n WHERE coalesce(loudest, 0) <= 0 OR near >= loudest * 0.2",
)
def loud_onsets(t: Tables) -> DataFrame:
    """Clicks as onsets, all other events as a series of levels: half a day round each click counts."""
    e = t.events.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"), "event_type", "value")
    levels = e.where("event_type <> 'click'").select("user_id", "t", F.col("value").alias("level"))
    return I.loud_near(e.where("event_type = 'click'").select("user_id", "t", "value").distinct(), levels, "user_id", "t", "value", "level", within=43200.0)


@query(
    "attack_decay_of_onset",
    "E5",
    _FRAMES + ", m AS (SELECT *, max(value) OVER (PARTITION BY user_id) AS top FROM f), o AS (SELECT user_id, min(frame) AS first FROM m WHERE value >= top * 0.6 GROUP BY user_id), j AS (SELECT f.user_id, frame, value, frame BETWEEN first - 1 AND first + 20 AS near FROM f LEFT JOIN o USING (user_id)), p AS (SELECT user_id, coalesce(max(value) FILTER (near), max(value)) AS v FROM j GROUP BY user_id), q AS (SELECT j.user_id, min(frame) AS peak, any_value(v) AS v FROM j JOIN p USING (user_id) WHERE value = v AND (near OR NOT EXISTS (SELECT 1 FROM j k WHERE k.user_id = j.user_id AND k.near)) GROUP BY j.user_id HAVING any_value(v) > 0) "
    "SELECT f.user_id, peak, peak - coalesce(max(CASE WHEN frame < peak AND value < v * 0.1 THEN frame END) + 1, min(frame)) AS attack, min(CASE WHEN frame >= peak AND value <= v * 0.1 THEN frame END) - peak AS decay FROM f JOIN q USING (user_id) GROUP BY f.user_id, peak",
)
def attack_decay_of_onset(t: Tables) -> DataFrame:
    """Round the first strong event, not the loudest of all."""
    f = _events(t).withColumn("frame", F.col("frame").cast("long"))
    top = f.withColumn("top", F.max("value").over(Window.partitionBy("user_id"))).where(F.col("value") >= F.col("top") * 0.6)
    first = top.groupBy("user_id").agg(F.min("frame").alias("first"))
    return I.attack_decay(f, "user_id", "frame", "value", first=first, before=1, after=20).select("user_id", "peak", "attack", "decay")


@query("framed_levels", "I2", _FRAMES + ", n AS (SELECT user_id, count(*) AS n FROM f GROUP BY user_id), g AS (SELECT user_id, unnest(range(0, 1 + n // 2)) AS frame FROM n) SELECT g.user_id, g.frame, round(sqrt(coalesce(sum(value * value), 0) / 8), 6) AS rms FROM g LEFT JOIN f ON f.user_id = g.user_id AND f.frame >= g.frame * 2 - 4 AND f.frame < g.frame * 2 + 4 GROUP BY g.user_id, g.frame")
def framed_levels(t: Tables) -> DataFrame:
    """Frames of eight values every two."""
    return I.framed_rms(_events(t), "user_id", "frame", "value", frame=8, hop=2).select("user_id", "frame", F.round("rms", 6).alias("rms"))


@query(
    "attack_decay",
    "E5",
    _FRAMES + ", p AS (SELECT user_id, arg_max(frame, value) AS peak, max(value) AS v FROM f GROUP BY user_id HAVING max(value) > 0), j AS (SELECT f.*, peak, v * 0.1 AS th FROM f JOIN p USING (user_id)) SELECT user_id, peak - coalesce(max(CASE WHEN frame < peak AND value < th THEN frame END) + 1, min(frame)) AS attack, min(CASE WHEN frame >= peak AND value <= th THEN frame END) - peak AS decay FROM j GROUP BY user_id, peak",
)
def attack_decay(t: Tables) -> DataFrame:
    return I.attack_decay(_events(t).withColumn("frame", F.col("frame").cast("long")), "user_id", "frame", "value").select("user_id", "attack", "decay")


@query("rises", "E7", _FRAMES + " SELECT user_id, frame, round(coalesce(greatest(0, value - lag(value) OVER (PARTITION BY user_id ORDER BY frame)), 0), 6)::DOUBLE AS rise FROM (SELECT user_id, CAST(frame AS INTEGER) AS frame, value FROM f)")
def rises(t: Tables) -> DataFrame:
    return I.rises(_events(t), "user_id", "frame", "value").select("user_id", "frame", F.round("rise", 6).alias("rise"))


_AC = _FRAMES + ", x AS (SELECT user_id, frame, value - avg(value) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS x FROM f), z AS (SELECT user_id, sum(x * x) AS z FROM x GROUP BY user_id HAVING sum(x * x) > 0), r AS (SELECT a.user_id, b.frame - a.frame AS lag, round(sum(a.x * b.x) / any_value(z), 9) AS r FROM x a JOIN x b ON a.user_id = b.user_id AND b.frame - a.frame BETWEEN 2 AND 12 JOIN z ON z.user_id = a.user_id GROUP BY 1, 2)"


@query("detrend_local_peaks", "E6", _AC + ", p AS (SELECT *, lag(r) OVER w AS a, lead(r) OVER w AS b FROM r WINDOW w AS (PARTITION BY user_id ORDER BY lag)), q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC, lag) AS n FROM p WHERE r > a AND r > b AND r >= 0) SELECT user_id, CAST(lag AS INTEGER) AS lag, round(greatest(0, least(1, r)), 6)::DOUBLE AS confidence FROM q WHERE n = 1")
def detrend_local_peaks(t: Tables) -> DataFrame:
    x = I.detrended(_events(t), "user_id", "frame", "value", 3)
    r = I.autocorrelation(x, "user_id", "frame", "x", (2, 12)).withColumn("r", F.round("r", 9))
    return I.best_local_peak(r, "user_id").select("user_id", "lag", F.round("confidence", 6).alias("confidence"))


@query("refined_periods", "E6", _AC + ", p AS (SELECT *, lag(r) OVER w AS a, lead(r) OVER w AS b FROM r WINDOW w AS (PARTITION BY user_id ORDER BY lag)), q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC, lag) AS n FROM p WHERE r > a AND r > b AND r >= 0) SELECT user_id, CAST(lag AS INTEGER) AS lag, round(lag + greatest(-0.5, least(0.5, 0.5 * (a - b) / (a - 2 * r + b))), 5)::DOUBLE AS refined FROM q WHERE n = 1")
def refined_periods(t: Tables) -> DataFrame:
    """Periods between whole lags, where the parabola through a peak and its neighbours is highest."""
    x = I.detrended(_events(t), "user_id", "frame", "value", 3)
    r = I.autocorrelation(x, "user_id", "frame", "x", (2, 12)).withColumn("r", F.round("r", 9))
    return I.best_local_peak(r, "user_id").select("user_id", "lag", F.round("refined", 5).alias("refined"))


@query("envelope_buckets", "A21 D26", _FRAMES + ", n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM f) SELECT user_id, CAST(least(frame * 4 // n, 3) AS INTEGER) AS bucket, min(value) AS low, max(value) AS high, round(sqrt(avg(value * value)), 6) AS rms FROM n GROUP BY 1, 2")
def envelope_buckets(t: Tables) -> DataFrame:
    rows = _events(t).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    return I.envelope(rows, ["user_id"], F.col("frame"), "value", F.col("n"), 4).select("user_id", "bucket", "low", "high", F.round("rms", 6).alias("rms"))


@query(
    "window_spans",
    "E8",
    """WITH d AS (SELECT doc_id, n_chars AS n, CAST(ceil(n_chars / 500.0) AS BIGINT) AS c FROM documents),
s AS (SELECT doc_id, n, c, CASE WHEN n <= 500 THEN [0] WHEN c <= 24 THEN list_transform(range(0, c), lambda i: i * 500) ELSE list_transform(range(0, 24), lambda i: CASE WHEN i = 23 THEN n - 500 ELSE CAST(floor(i * ((n - 500) / 23)) AS BIGINT) END) END AS st FROM d),
u AS (SELECT doc_id, n, c, unnest(st) AS start FROM s)
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(least(n, start + 500) AS BIGINT) AS "end" FROM u WHERE n <= 500 OR least(n, start + 500) - start >= 50""",
)
def window_spans(t: Tables) -> DataFrame:
    spans = t.documents.select("doc_id", F.explode(I.window_spans(F.col("n_chars"), 500, 50)).alias("s"))
    return spans.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


_SPANS = _FRAMES + f", p AS (SELECT user_id, frame * 7919 + user_id * 1000003 AS id, us // 1000000 AS a, us // 1000000 + CAST(floor(value) AS BIGINT) * 3600 AS b FROM f)"


def _segments_at(events: DataFrame) -> DataFrame:
    e = events.withColumn("s", F.floor(F.col("us") / 1000000))
    spans = e.select("user_id", (F.col("frame").cast("long") * 7919 + F.col("user_id") * 1000003).alias("id"), F.col("s").alias("start"), (F.col("s") + F.floor("value") * 3600).alias("end"))
    points = e.select("user_id", (F.col("s") + 1800).alias("t"))
    return I.at_point(points, spans, "user_id", "t")


@query("segment_at", "B25", _SPANS + ", q AS (SELECT user_id, us // 1000000 + 1800 AS t FROM f), j AS (SELECT q.user_id, t, id, row_number() OVER (PARTITION BY q.user_id, t ORDER BY b - a, id) AS n FROM q JOIN p ON p.user_id = q.user_id AND t BETWEEN a AND b) SELECT user_id, t, id FROM j WHERE n = 1")
def segment_at(t: Tables) -> DataFrame:
    return _segments_at(_events(t))


@query("segment_at_every_event", "B25", _SPANS + ", q AS (SELECT DISTINCT user_id, us // 1000000 + 1800 AS t FROM f), j AS (SELECT q.user_id, t, id, row_number() OVER (PARTITION BY q.user_id, t ORDER BY b - a, id) AS n FROM q JOIN p ON p.user_id = q.user_id AND t BETWEEN a AND b) SELECT user_id, t, id FROM j WHERE n = 1")
def segment_at_every_event(t: Tables) -> DataFrame:
    """As segment_at, against SQL that takes each point once first."""
    return _segments_at(_events(t))


@query("segment_at_wide", "B25", _FRAMES + ", p AS (SELECT user_id, frame * 7919 + user_id * 1000003 AS id, us AS a, us + (CAST(floor(value) AS BIGINT) % 7) * 5184000000000 AS b FROM f), q AS (SELECT DISTINCT user_id, us + 1800000000 AS t FROM f), j AS (SELECT q.user_id, t, id, row_number() OVER (PARTITION BY q.user_id, t ORDER BY b - a, id) AS n FROM q JOIN p ON p.user_id = q.user_id AND t BETWEEN a AND b) SELECT user_id, t, id FROM j WHERE n = 1")
def segment_at_wide(t: Tables) -> DataFrame:
    """Spans of up to a year, in microseconds: a few dozen nodes each."""
    e = _events(t)
    spans = e.select("user_id", (F.col("frame").cast("long") * 7919 + F.col("user_id") * 1000003).alias("id"), F.col("us").alias("start"), (F.col("us") + F.floor("value") % 7 * 5184000000000).alias("end"))
    return I.at_point(e.select("user_id", (F.col("us") + 1800000000).alias("t")), spans, "user_id", "t")


@query("ordered_bounds", "B26", "WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) * 100 - 500 AS a, l_suppkey * 20 AS b FROM lineitem), o AS (SELECT *, greatest(0, least(a, b)) AS lo, greatest(greatest(0, least(a, b)) + 1, greatest(a, b)) AS hi FROM b) SELECT l_orderkey, l_linenumber, l_partkey, least(lo, least(hi, 3000) - 1) AS low, least(hi, 3000) AS high FROM o")
def ordered_bounds(t: Tables) -> DataFrame:
    low, high = I.ordered_bounds(F.col("l_quantity").cast("long") * 100 - 500, F.col("l_suppkey") * 20, F.lit(3000).cast("long"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", low.alias("low"), high.alias("high"))


@query("nearest_edge", "M6", "WITH e AS (SELECT s_suppkey AS id, 'start' AS edge, 0 AS n, s_acctbal AS pos FROM supplier UNION ALL SELECT s_suppkey, 'end', 1, s_acctbal + 500 FROM supplier) SELECT id, edge FROM e WHERE abs(pos - 4321) <= 800 ORDER BY abs(pos - 4321), id, n LIMIT 1")
def nearest_edge(t: Tables) -> DataFrame:
    spans = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("start"), (F.col("s_acctbal") + 500).alias("end"))
    return I.nearest_edge(spans, 4321.0, 800.0)


@query("level_stats", "D22", "SELECT user_id, round(CASE WHEN max(value) <= 0 THEN -120 ELSE greatest(-120, 20 * log10(max(value))) END, 6)::DOUBLE AS peak_db, round(max(value) / nullif(sqrt(avg(value * value)), 0), 6) AS crest FROM events GROUP BY user_id")
def level_stats(t: Tables) -> DataFrame:
    from nearfield.functions.scalars import decibels

    g = t.events.groupBy("user_id").agg(F.max(F.abs("value")).alias("p"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("r"))
    return g.select("user_id", F.round(decibels(F.col("p")), 6).alias("peak_db"), F.round(F.when(F.col("r") > 0, F.col("p") / F.col("r")), 6).alias("crest"))


@query("energy_share", "D23", "SELECT user_id, round(sum(CASE WHEN event_type = 'click' THEN value * value ELSE 0 END) / nullif(sum(value * value), 0), 6) AS share FROM events GROUP BY user_id")
def energy_share(t: Tables) -> DataFrame:
    e = F.col("value") * F.col("value")
    total = F.sum(e)
    return t.events.groupBy("user_id").agg(F.round(F.when(total > 0, F.sum(F.when(F.col("event_type") == "click", e).otherwise(0.0)) / total), 6).alias("share"))


_GRID = _FRAMES + ", n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM f), w AS (SELECT user_id, frame AS id, n, frame * 16 + 5 AS a, frame * 16 + 5 + CAST(floor(value * 7) AS BIGINT) AS b FROM n), g AS (SELECT *, a // 16 AS first, greatest(a // 16 + 1, least(n, CAST(ceil(b / 16.0) AS BIGINT))) AS past FROM w)"


@query("span_moments", "E12 D21", _GRID + " SELECT g.user_id, g.id, count(f.value) AS frames, round(avg(f.value) + 1e-9, 6) AS mean_value, round(var_pop(f.value) + 1e-8, 5) AS variance_value FROM g LEFT JOIN f ON f.user_id = g.user_id AND g.b > g.a AND f.frame >= g.first AND f.frame < g.past GROUP BY g.user_id, g.id")
def span_moments(t: Tables) -> DataFrame:
    """A window from within every event's frame, as long as its value says, measured on the frames of its user."""
    f = _events(t)
    start = F.col("frame").cast("long") * 16 + 5
    spans = f.select("user_id", F.col("frame").cast("long").alias("id"), start.alias("start"), (start + F.floor(F.col("value") * 7)).alias("end"))
    out = I.span_moments(f, spans, "user_id", "frame", ["value"], hop=16)
    return out.select("user_id", "id", "frames", F.round(F.col("mean_value") + 1e-9, 6).alias("mean_value"), F.round(F.col("variance_value") + 1e-8, 5).alias("variance_value"))


@query("frame_moments", "D21", "SELECT user_id, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance FROM events GROUP BY user_id")
def frame_moments(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_pop("value"), 6).alias("variance"))


@query("median_agreement", "D24", "WITH v AS (SELECT user_id, value * 20 AS f FROM events WHERE value * 20 BETWEEN 40 AND 2000), m AS (SELECT user_id, median(f) AS m FROM v GROUP BY user_id) SELECT v.user_id, round(any_value(m), 6) AS median, round(avg((f BETWEEN m * pow(2, -1 / 12.0::DOUBLE) AND m * pow(2, 1 / 12.0::DOUBLE))::INT), 6) AS agreement FROM v JOIN m USING (user_id) GROUP BY v.user_id")
def median_agreement(t: Tables) -> DataFrame:
    v = t.events.select("user_id", (F.col("value") * 20).alias("f")).where("f between 40 and 2000")
    m = v.groupBy("user_id").agg(F.median("f").alias("m"))
    near = F.col("f").between(F.col("m") * 2 ** (-1 / 12), F.col("m") * 2 ** (1 / 12))
    return v.join(m, "user_id").groupBy("user_id").agg(F.round(F.max("m"), 6).alias("median"), F.round(F.avg(near.cast("double")), 6).alias("agreement"))


@query("circular_phase", "D25", "WITH p AS (SELECT user_id, (epoch_us(ts) // 1000000 % 3600) / 3600.0::DOUBLE AS p FROM events), m AS (SELECT user_id, atan2(avg(sin(p * 2 * pi())), avg(cos(p * 2 * pi()))) / (2 * pi()) AS m FROM p GROUP BY user_id) SELECT user_id, round(CASE WHEN m < 0 THEN m + 1 ELSE m END, 6) AS phase FROM m")
def circular_phase(t: Tables) -> DataFrame:
    p = F.pmod(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000), F.lit(3600)) / 3600.0
    mean = lambda f: F.avg(f(p * 2 * F.pi()))
    m = F.atan2(mean(F.sin), mean(F.cos)) / (2 * F.pi())
    return t.events.groupBy("user_id").agg(F.round(F.when(m < 0, m + 1).otherwise(m), 6).alias("phase"))


@query("backtracked_onsets", "C25", _FRAMES + ", m AS (SELECT *, CASE WHEN value <= coalesce(lag(value) OVER w, value) AND value <= coalesce(lead(value) OVER w, value) THEN frame END AS m FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame)) SELECT user_id, CAST(frame AS INTEGER) AS frame, CAST(coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), frame) AS INTEGER) AS onset FROM m")
def backtracked_onsets(t: Tables) -> DataFrame:
    return I.backtracked(_events(t), "user_id", "frame", "value").select("user_id", "frame", "onset")
