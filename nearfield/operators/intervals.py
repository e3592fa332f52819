"""Events to intervals: thresholds, merging, boundaries, caps, windows, containment, envelopes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.scalars import resolved
from nearfield.working import dropped, stored


@dataclass(frozen=True)
class Segmentation:
    """Rules for cutting; lengths in the unit of the times, or per cent of the whole."""

    profile: str = "auto"
    sensitivity: float = 0.15
    boundary: str = "transient"
    min_length: float = 0.05
    min_unit: str = "s"
    max_length: float = 2.0
    max_unit: str = "s"
    most: int = 5

    def __post_init__(self) -> None:
        if self.profile not in ("auto", "tight", "loose"):
            raise ValueError("unknown profile")
        if self.boundary not in ("transient", "fixed"):
            raise ValueError("unknown boundary")
        if {self.min_unit, self.max_unit} - {"s", "%"}:
            raise ValueError("unknown unit")
        if not 0 <= self.sensitivity <= 1:
            raise ValueError("sensitivity is a share")
        if self.most < 1 or self.min_length <= 0 or self.max_length <= 0:
            raise ValueError("lengths and the cap must be positive")
        if self.min_unit == self.max_unit and self.min_length >= self.max_length:
            raise ValueError("the least length must be below the greatest")


def strong(events: DataFrame, key: str, strength: str, sensitivity: float) -> DataFrame:
    """Events whose strength is at least `sensitivity` of the key's greatest; strength becomes that share."""
    top = F.max(strength).over(Window.partitionBy(key))
    return events.withColumn("_top", top).where((F.col("_top") > 0) & (F.col(strength) >= F.col("_top") * sensitivity)).withColumn(strength, F.col(strength) / F.col("_top")).drop("_top")


def boundaries(events: DataFrame, key: str, start: str, strength: str, whole: Column, rules: Segmentation) -> DataFrame:
    """(key, start, end, strength, found, capped, effective): intervals from event to event.

    An interval ends at the next event, whether that one is kept or not; the last
    one ends with the whole.  Longer ones are cut, shorter ones dropped, and the
    strongest `most` stay (the earlier of equals); `effective` is their least
    strength where the cap binds.
    """
    least, most = resolved(F.lit(rules.min_length), F.lit(rules.min_unit), F.col("_whole")), resolved(F.lit(rules.max_length), F.lit(rules.max_unit), F.col("_whole"))
    by = Window.partitionBy(key).orderBy(start)
    rows = events.withColumn("_whole", whole).where("_whole > 0")
    end = F.col(start) + most if rules.boundary == "fixed" else F.coalesce(F.lead(start).over(by), F.col("_whole"))
    rows = rows.withColumn("end", end).withColumn("end", F.least("end", "_whole"))
    rows = rows.withColumn("end", F.when(F.col("end") - F.col(start) > most, F.col(start) + most).otherwise(F.col("end"))).where(F.col("end") - F.col(start) >= least)
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(strength), start))).withColumn("found", F.count("*").over(Window.partitionBy(key)))
    kept = rows.where(F.col("_r") <= rules.most).withColumn("capped", F.col("found") > rules.most)
    kept = kept.withColumn("effective", F.when(F.col("capped"), F.min(strength).over(Window.partitionBy(key))))
    return kept.select(key, F.col(start).alias("start"), "end", F.col(strength).alias("strength"), "found", "capped", "effective")


#: Numbers of a time axis in a part: parts deal a key that holds much of the events over tasks.
PART = 1 << 16


def _stretches(events: DataFrame, key: str, time: str, gap: float) -> DataFrame:
    """events with `_from`, the time of the last event at or before each that no earlier one is nearer to than `gap`.

    Times are cut into parts of many gaps.  Only the last event of each part goes
    over the parts' order, so that a key's events are sorted within parts alone.
    """
    rows = events.withColumn("_part", F.floor(F.col(time) / F.lit(float(gap) * 256)))
    by, parts = Window.partitionBy(key, "_part").orderBy(time), Window.partitionBy(key).orderBy("_part")
    last = rows.groupBy(key, "_part").agg(F.max(time).alias("_end")).withColumn("_before", F.lag("_end").over(parts)).drop("_end")
    rows = rows.join(last, [key, "_part"])
    before = F.coalesce(F.lag(time).over(by), F.col("_before"))
    rows = rows.withColumn("_begin", F.when(before.isNull() | (F.col(time) - before >= gap), F.col(time)))
    begun = rows.groupBy(key, "_part").agg(F.max("_begin").alias("_latest"))
    begun = begun.withColumn("_open", F.last("_latest", ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, -1))).drop("_latest")
    rows = rows.join(begun, [key, "_part"])
    return rows.withColumn("_from", F.coalesce(F.last("_begin", ignorenulls=True).over(by), F.col("_open"))).drop("_part", "_before", "_begin", "_open")


def _carried(rows: DataFrame, key: str, time: str, part: str, mark: str, out: str) -> DataFrame:
    """Rows with `out`, the last `mark` at or before each of its key, carried over parts; a key's rows are sorted within parts alone."""
    by, parts = Window.partitionBy(key, part).orderBy(time), Window.partitionBy(key).orderBy(part)
    latest = rows.groupBy(key, part).agg(F.max(mark).alias("_latest"))
    latest = latest.withColumn("_open", F.max("_latest").over(parts.rowsBetween(Window.unboundedPreceding, -1))).drop("_latest")
    return rows.join(latest, [key, part]).withColumn(out, F.coalesce(F.last(mark, ignorenulls=True).over(by), F.col("_open"))).drop("_open")


def following(events: DataFrame, key: str, time: str, gap: float) -> DataFrame:
    """(key, time, next): by event the first one at least `gap` later, missing if there is none.

    An as-of step without a join by inequality: each event also asks at its own
    time plus the gap; events and questions are sorted together within parts of
    many gaps, and a question without an event after it in its part takes the
    first one of the next part.
    """
    size = F.lit(float(gap) * 256)
    both = events.select(key, F.col(time).alias("_at"), F.col(time).alias("_event"), F.lit(None).cast("double").alias("_asks"))
    both = both.unionByName(events.select(key, (F.col(time) + gap).alias("_at"), F.lit(None).cast("double").alias("_event"), F.col(time).alias("_asks")))
    both = both.withColumn("_part", F.floor(F.col("_at") / size))
    # at one time events stand after questions, so that a question finds the event at its own time
    by = Window.partitionBy(key, "_part").orderBy("_at", F.col("_event").isNotNull()).rowsBetween(1, Window.unboundedFollowing)
    parts = Window.partitionBy(key).orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    later = both.groupBy(key, "_part").agg(F.min("_event").alias("_first")).withColumn("_later", F.min("_first").over(parts)).drop("_first")
    found = both.withColumn("_own", F.first("_event", ignorenulls=True).over(by)).where("_asks is not null")
    return found.join(later, [key, "_part"]).select(key, F.col("_asks").alias(time), F.coalesce("_own", "_later").alias("next"))


def merged_close(events: DataFrame, key: str, time: str, strength: str, gap: float) -> DataFrame:
    """(key, t, s): events nearer than `gap` to the *first* of a run become one: its time, the run's greatest strength.

    A pause of `gap` begins a run whatever came before.  Inside the stretches
    between pauses, each event points to the one that would begin the next run if
    it began one itself; these jumps are composed to 2, 4, 8 .. of them, and the
    events that a stretch's first one reaches begin runs.  So a stretch of n runs
    takes log2(n) rounds, each a join by equality, and a key that holds all events
    is dealt over tasks like any other.  Events without key or time (or with NaN)
    are left out; a strength that is missing counts for nothing.
    """
    own = events.where(F.col(key).isNotNull()).select(F.col(key), F.col(time).cast("double").alias("t"), F.col(strength).cast("double").alias("s")).where("t is not null and not isnan(t)")
    own = own.groupBy(key, "t").agg(F.max("s").alias("s"))
    rows = stored(_stretches(own, key, "t", gap))
    # only stretches longer than the gap hold a second run
    long = rows.groupBy(key, "_from").agg(F.max("t").alias("_to")).where(F.col("_to") - F.col("_from") >= gap).drop("_to")
    inside = rows.join(long, [key, "_from"], "left_semi")
    jumps = following(inside.select(key, "t"), key, "t", gap).join(inside.select(key, "t", "_from"), [key, "t"])
    # a jump that leaves its stretch ends there
    ends = inside.select(key, F.col("t").alias("next"), F.col("_from").alias("_of"))
    jumps = stored(jumps.join(ends, [key, "next"]).where(F.col("_from") == F.col("_of")).select(key, "t", "next"))
    none = F.lit(None).cast("double")
    begins = rows.where(F.col("t") == F.col("_from")).select(key, "t")
    used = [rows, jumps]
    while jumps.limit(1).count():
        reached = begins.join(jumps, [key, "t"]).select(key, F.col("next").alias("t"))
        twice = jumps.select(key, "t", F.col("next").alias("_via")).join(jumps.select(key, F.col("t").alias("_via"), "next"), [key, "_via"]).select(key, "t", "next")
        # one table a round: run starts so far, and the jumps that are left
        state = stored(begins.unionByName(reached).withColumn("next", none).unionByName(twice))
        begins, jumps = state.where("next is null").select(key, "t"), state.where("next is not null")
        used.append(state)
    marked = rows.join(begins.withColumn("_begin", F.col("t")), [key, "t"], "left")
    marked = marked.withColumn("_part", F.floor(F.col("t") / F.lit(float(gap) * 256)))
    runs = _carried(marked, key, "t", "_part", "_begin", "_run").groupBy(key, F.col("_run")).agg(F.max("s").alias("s"))
    out = stored(runs.select(key, F.col("_run").alias("t"), "s"))
    dropped(*used)
    return out


def prefix_sums(frames: DataFrame, key: str, frame: str, values: list[str]) -> DataFrame:
    """(key, frame, part, n, count_<v>, sum_<v>, squares_<v>, and each of them again as carry_..): sums from the part's begin up to each frame, and those of the parts before.

    Frames are cut into parts of PART numbers, so that a key's frames are sorted
    within parts alone; only the parts' totals go over the parts' order.
    """
    given = {v: F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in values}
    sums = {"n": F.lit(1).cast("double")}
    for v, x in given.items():
        sums |= {f"count_{v}": F.col(v).isNotNull().cast("double"), f"sum_{v}": x, f"squares_{v}": x * x}
    rows = frames.select(key, F.col(frame).cast("long").alias(frame), F.floor(F.col(frame) / PART).alias("part"), *(c.alias(n) for n, c in sums.items()))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(key, "part").agg(*(F.sum(n).alias(n) for n in sums)).select(key, "part", *(F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias(f"carry_{n}") for n in sums))
    upto = Window.partitionBy(key, "part").orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({n: F.sum(n).over(upto) for n in sums}).join(carry, [key, "part"])


def span_moments(frames: DataFrame, spans: DataFrame, key: str, frame: str, values: list[str], *, hop: int) -> DataFrame:
    """(key, id, frames, mean_<v>, variance_<v>) of the frames that each span covers on its key's own grid.

    spans: key, id, start, end, in units of which a frame has `hop`.  A span has
    the frames from that of its start to the last one that begins before its end,
    within the key's frames and one at least; spans that end before they begin,
    begin after the last frame or have no frames at all have 0 and no moments.
    A key's frames are numbered 0, 1, .. without gaps.  Sums up to a frame are made
    once (see prefix_sums); a span is two lookups by equality, one before its first
    frame and one at its last, and their difference, whatever its length.  Missing values count
    as 0.
    """
    names = ["n", *(f"{x}_{v}" for v in values for x in ("count", "sum", "squares"))]
    sums = prefix_sums(frames, key, frame, values)
    counts = frames.groupBy(key).agg((F.max(F.col(frame).cast("long")) + 1).alias("_n"))
    asked = spans.select(key, "id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).join(counts, key, "left")
    first = F.floor(F.greatest(F.lit(0), F.col("start")) / hop)
    past = F.greatest(first + 1, F.least(F.col("_n"), F.ceil(F.col("end") / hop)))
    sound = F.col("start").isNotNull() & (F.col("end") > F.greatest(F.lit(0), F.col("start"))) & (first < F.col("_n"))
    asked = asked.select(key, "id", F.when(sound, first).alias("_first"), F.when(sound, past).alias("_past"))
    ends = F.array(F.struct((F.col("_first") - 1).alias("at"), F.lit(-1.0).alias("sign")), F.struct((F.col("_past") - 1).alias("at"), F.lit(1.0).alias("sign")))
    looked = asked.select(key, "id", F.explode(ends).alias("_e")).select(key, "id", F.col("_e.at").alias(frame), F.col("_e.sign").alias("_sign"))
    met = looked.join(sums, [key, frame], "left")
    # sums within a part and those carried are added up apart: of a span inside one part the latter cancel exactly
    total = lambda n: F.coalesce(F.sum(F.col("_sign") * F.col(n)), F.lit(0.0)) + F.coalesce(F.sum(F.col("_sign") * F.col(f"carry_{n}")), F.lit(0.0))
    by = met.groupBy(key, "id").agg(*(total(n).alias(n) for n in names))
    out = []
    for v in values:
        count = F.col(f"count_{v}")
        mean = F.when(count > 0, F.col(f"sum_{v}") / count)
        out += [mean.alias(f"mean_{v}"), F.when(count > 0, F.greatest(F.lit(0.0), F.col(f"squares_{v}") / count - mean * mean)).alias(f"variance_{v}")]
    return by.select(key, "id", F.col("n").cast("long").alias("frames"), *out)


def dominant(rows: DataFrame, key: str, order: str, strength: str, loudness: str, *, share: float = 0.3, loud_share: float = 0.2, reach: int = 2) -> DataFrame:
    """Events of at least `share` of the greatest strength whose loudest neighbour, `reach` rows away at most, has `loud_share` of the greatest loudness."""
    all_, near = Window.partitionBy(key), Window.partitionBy(key).orderBy(order).rowsBetween(-reach, reach)
    out = rows.withColumns({"_s": F.max(strength).over(all_), "_l": F.max(loudness).over(all_), "_n": F.max(loudness).over(near)})
    return out.where((F.col(strength) >= F.col("_s") * share) & ((F.col("_l") <= 0) | (F.col("_n") >= F.col("_l") * loud_share))).drop("_s", "_l", "_n")


def loud_near(onsets: DataFrame, levels: DataFrame, key: str, time: str, strength: str, level: str, *, within: float, share: float = 0.3, loud_share: float = 0.2) -> DataFrame:
    """Onsets of at least `share` of their key's greatest strength near which, at most `within` before or after, a level of at least `loud_share` of the key's greatest was measured.

    Levels are a series of their own, with their own times.  A key without levels,
    or without one above 0, asks for strength alone.  Time is cut into parts of many
    windows; a level is also in the parts that its window reaches, so that each part
    is sorted for itself and no key is one task.  Onsets without key, time or
    strength are left out.
    """
    size = float(within) * 256 or 1.0
    part = lambda c: F.floor(c / size)
    tops = onsets.groupBy(key).agg(F.max(strength).alias("_s"))
    loudest = levels.groupBy(key).agg(F.max(level).alias("_l"))
    own = onsets.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(strength).isNotNull()).join(tops, key).join(loudest, key, "left").where(F.col(strength) >= F.col("_s") * share)
    asked = own.withColumns({"_part": part(F.col(time)), "_at": F.col(time).cast("double"), "_v": F.lit(None).cast("double"), "_asks": F.lit(True)})
    heard = levels.select(key, F.col(time).cast("double").alias("_at"), F.col(level).cast("double").alias("_v")).where("_at is not null and _v is not null")
    heard = heard.select(key, F.explode(F.sequence(part(F.col("_at") - within), part(F.col("_at") + within))).alias("_part"), "_at", "_v", F.lit(False).alias("_asks"))
    reach = f"CAST({float(within)!r} AS DOUBLE)"
    near = F.expr(f"max(_v) OVER (PARTITION BY `{key}`, _part ORDER BY _at RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)")
    met = asked.unionByName(heard, allowMissingColumns=True).withColumn("_near", near).where("_asks")
    quiet = F.coalesce(F.col("_l"), F.lit(0.0)) <= 0
    return met.where(quiet | (F.col("_near") >= F.col("_l") * loud_share)).select(*onsets.columns)


def attack_decay(rows: DataFrame, key: str, frame: str, level: str, threshold: float = 0.1, *, first: DataFrame | None = None, before: int = 0, after: int = 0) -> DataFrame:
    """(key, peak, attack, decay) in frames: from the last frame below the threshold before the peak, and to the first at or below it after; decay is missing if there is none, both if nothing sounds.

    The peak is the greatest level, the earlier of equals.  first: (key, first), the
    frame of each key's first onset; then it is the greatest from `before` frames before it
    to `after` frames after it, and only keys without an onset, or without a frame
    in that window, take the greatest of all.
    """
    best = lambda where: F.max_by(F.struct(F.col(frame).alias("f"), F.col(level).alias("v")), F.when(where, F.struct(level, -F.col(frame))))
    if first is None:
        peak = rows.groupBy(key).agg(best(F.lit(True)).alias("p"))
    else:
        near = F.col(frame).between(F.col("first") - before, F.col("first") + after)
        peak = rows.join(first.select(key, "first"), key, "left").groupBy(key).agg(F.coalesce(best(near), best(F.lit(True))).alias("p"))
    peak = peak.where("p.v > 0").select(key, F.col("p.f").alias("peak"), (F.col("p.v") * threshold).alias("_t"))
    both = rows.join(peak, key)
    below = F.max(F.when((F.col(frame) < F.col("peak")) & (F.col(level) < F.col("_t")), F.col(frame)))
    under = F.min(F.when((F.col(frame) >= F.col("peak")) & (F.col(level) <= F.col("_t")), F.col(frame)))
    return both.groupBy(key, "peak").agg((F.col("peak") - F.coalesce(below + 1, F.min(frame))).alias("attack"), (under - F.col("peak")).alias("decay"))


def framed_rms(rows: DataFrame, key: str, index: str, value: str, *, frame: int, hop: int) -> DataFrame:
    """(key, frame, rms): the root mean square of `frame` values round every hop-th one, from 0 to the last; what lies outside counts as 0.

    Values are summed by hop first; each sum then goes to the frames that hold it.
    So nothing is sorted, and frames that overlap cost a row for each hop and frame.
    """
    half = frame // (2 * hop)
    if frame != 2 * half * hop:
        raise ValueError("a frame must have an even number of hops")
    hops = rows.where(F.col(key).isNotNull() & F.col(index).isNotNull()).groupBy(key, F.floor(F.col(index) / hop).alias("_b")).agg(F.sum(F.col(value).cast("double") * F.col(value)).alias("_s"), F.max(index).alias("_i"))
    last = hops.groupBy(key).agg(F.floor((F.max("_i") + 1) / hop).alias("_last"))
    at = F.explode(F.sequence(F.greatest(F.lit(0), F.col("_b") - half + 1), F.least(F.col("_last"), F.col("_b") + half)))
    held = hops.join(last, key).where(F.col("_last") >= F.greatest(F.lit(0), F.col("_b") - half + 1))
    return held.select(key, at.alias("frame"), "_s").groupBy(key, "frame").agg(F.sqrt(F.coalesce(F.sum("_s"), F.lit(0.0)) / frame).alias("rms"))


def rises(rows: DataFrame, key: str, order: str, value: str, out: str = "rise") -> DataFrame:
    """Half-wave rectified first difference; the first is 0."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn(out, F.greatest(F.lit(0.0), F.col(value) - F.lag(value).over(w) - F.lit(0.0))).withColumn(out, F.coalesce(out, F.lit(0.0)))


def detrended(rows: DataFrame, key: str, order: str, value: str, reach: int, out: str = "x") -> DataFrame:
    """A value less its moving mean over `reach` rows on each side."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-reach, reach)
    return rows.withColumn(out, F.col(value) - F.avg(value).over(w))


def autocorrelation(rows: DataFrame, key: str, index: str, value: str, lags: tuple[int, int]) -> DataFrame:
    """(key, lag, r): sums of products at each lag over that at 0; lags without any pair are absent.

    Overlap-add: a key's places are cut into parts of PART, to which the last
    places before them, as many as the longest lag, are added; each part gives its
    sums for all lags at once, by a product of Fourier transforms, and these are
    added up.  A key's parts are dealt over tasks.  Of the rows that repeat a place
    the values are added up.
    """
    low, high = lags
    kind = rows.schema[key].dataType.simpleString()
    own = rows.select(F.col(key).alias("k"), F.col(index).cast("long").alias("i"), F.col(value).cast("double").alias("x")).where("k is not null and i is not null and x is not null")
    own = own.groupBy("k", "i").agg(F.sum("x").alias("x"))
    part = F.floor(F.col("i") / PART)
    also = F.floor((F.col("i") + high) / PART)
    dealt = own.select("k", "i", "x", F.explode(F.sequence(part, also)).alias("p"))

    def products(late: np.ndarray, all_: np.ndarray) -> np.ndarray:
        """By lag from 0 to high, the sum of late[i] * all[i - lag]."""
        size = 1 << int(len(late) + high).bit_length()
        return np.fft.irfft(np.fft.rfft(late, size) * np.conj(np.fft.rfft(all_, size)), size)[: high + 1]

    def meet(keys: tuple, group: pa.Table) -> pa.Table:
        i, x = group.column("i").to_numpy(), group.column("x").to_numpy()
        begin = keys[1].as_py() * PART
        base = min(int(i.min()), begin)
        there, value = np.zeros((2, int(i.max()) - base + 1))
        there[i - base], value[i - base] = 1.0, x
        new = np.arange(len(there)) >= begin - base
        total, pairs = products(np.where(new, value, 0.0), value), np.rint(products(np.where(new, there, 0.0), there))
        total[0] = (x[i >= begin] ** 2).sum()
        lag = np.concatenate([[0], np.arange(low, high + 1)])
        lag = lag[(pairs[lag] > 0) | (lag == 0)]
        return pa.table({"k": pa.array([keys[0].as_py()] * len(lag), group.schema.field("k").type), "lag": pa.array(lag, pa.int32()), "s": pa.array(total[lag]), "n": pa.array(pairs[lag].astype(np.int64))})

    r = dealt.groupBy("k", "p").applyInArrow(meet, f"k {kind}, lag int, s double, n long").groupBy("k", "lag").agg(F.sum("s").alias("s"))
    zero = r.where("lag = 0 and s > 0").select("k", F.col("s").alias("z"))
    return r.where("lag > 0").join(zero, "k").select(F.col("k").alias(key), "lag", (F.col("s") / F.col("z")).alias("r"))


def best_local_peak(correlation: DataFrame, key: str) -> DataFrame:
    """(key, lag, confidence, refined): the highest lag that stands above both neighbours; a window's edge never counts.  refined: where the parabola through the three has its top, half a lag away at most."""
    w = Window.partitionBy(key).orderBy("lag")
    peaks = correlation.withColumns({"_p": F.lag("r").over(w), "_n": F.lead("r").over(w)}).where((F.col("r") > F.col("_p")) & (F.col("r") > F.col("_n")) & (F.col("r") >= 0))
    best = peaks.groupBy(key).agg(F.max(F.struct("r", (-F.col("lag")).alias("l"), "_p", "_n")).alias("m"))
    # above both neighbours, so the bend is never 0
    bend = F.col("m._p") - 2 * F.col("m.r") + F.col("m._n")
    shift = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), (F.col("m._p") - F.col("m._n")) / 2 / bend))
    return best.select(key, (-F.col("m.l")).alias("lag"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("m.r"))).alias("confidence"), (shift - F.col("m.l")).alias("refined"))


def backtracked(rows: DataFrame, key: str, order: str, value: str, reach: int = 2) -> DataFrame:
    """Rows with `onset`: the last local minimum at or before each, `reach` rows back at most, else the row itself; an as-of lookup by window."""
    w = Window.partitionBy(key).orderBy(order)
    low = (F.col(value) <= F.coalesce(F.lag(value).over(w), F.col(value))) & (F.col(value) <= F.coalesce(F.lead(value).over(w), F.col(value)))
    marked = rows.withColumn("_m", F.when(low, F.col(order)))
    near = F.last("_m", ignorenulls=True).over(w.rowsBetween(-reach, 0))
    return marked.withColumn("onset", F.coalesce(near, F.col(order))).drop("_m")


def window_spans(n: Column, limit: int, least: int, most: int = 24) -> Column:
    """Array of (start, end): one window up to `limit`, adjoining ones up to `most`, beyond that `most` spread evenly; a tail below `least` goes if others stay."""
    count = F.ceil(n / limit).cast("int")
    # position i of `most` evenly spread starts, cut to a whole number
    spread = lambda i: F.floor(i * ((n - limit) / (most - 1)))
    starts = F.when(n <= limit, F.array(F.lit(0).cast("long"))).when(count <= most, F.transform(F.sequence(F.lit(0), count - 1), lambda i: (i * limit).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.when(i == most - 1, n - limit).otherwise(spread(i)).cast("long")))
    spans = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(n, s + limit).cast("long").alias("end")))
    kept = F.filter(spans, lambda s: s["end"] - s["start"] >= least)
    return F.when(n <= limit, spans).when(F.size(kept) > 0, kept).otherwise(F.slice(spans, 1, 1))


def _up(c: Column, levels: Column) -> Column:
    """The place of a whole number at a level of the tree: an arithmetic shift, so that negative ones round down too."""
    return F.call_function("shiftright", c, levels)


def tree_nodes(start: Column, end: Column) -> Column:
    """The nodes (level, place) of a binary tree over whole numbers that make up a closed span: two by level at most, whatever its length.

    Level i has a node for each 2^i numbers.  Seen from below, the left end gives a
    node if it is a right child and the right end if it is a left child, as long
    as they haven't met.
    """
    start, past = start.cast("long"), end.cast("long") + 1

    def at(i: Column) -> Column:
        left = _up(start + F.call_function("shiftleft", F.lit(1).cast("long"), i) - 1, i)
        right = _up(past, i)
        apart, odd = left < right, lambda c: c.bitwiseAND(F.lit(1)) == 1
        nodes = F.array(F.when(apart & odd(left), left), F.when(apart & odd(right), right - 1))
        return F.transform(F.filter(nodes, lambda p: p.isNotNull()), lambda p: F.struct(i.alias("level"), p.alias("place")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.log2((past - start).cast("double")).cast("int") + 1), at))


def _numbered(points: DataFrame, spans: DataFrame, key: str, t: str, most: int) -> DataFrame:
    """A stored table of both: points (key, t) with `first`, their number in their key, from 1; spans (key, id, length) with the numbers of the first and the last point in them, those without any left out.

    Equal points have numbers of their own, that lie in the same spans.  Rows are
    sorted by key; where a key has more than `most` rows, times are cut into parts
    that hold about so many of the most crowded key's, rows are sorted within parts
    alone, and only the parts' counts go over the parts' order.
    """
    none = F.lit(None).cast
    rows = points.where(F.col(key).isNotNull() & F.col(t).isNotNull()).select(key, F.col(t).cast("long").alias("_start"), F.col(t).cast("long").alias("_end"), F.lit(1).alias("_point"), none(spans.schema["id"].dataType).alias("id"), F.col(t).alias(t))
    rows = rows.unionByName(spans.where(F.col(key).isNotNull() & (F.col("start") <= F.col("end"))).select(key, F.col("start").cast("long").alias("_start"), F.col("end").cast("long").alias("_end"), F.lit(0).alias("_point"), "id", none(points.schema[t].dataType).alias(t)))
    crowded = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("_start").alias("low"), F.max("_end").alias("high")).where(F.col("n") > most)
    width = crowded.agg(F.min((F.col("high").cast("double") - F.col("low") + 1) * most / F.col("n"))).first()[0]

    def counted(rows: DataFrame, at: str, order: Column, out: str) -> DataFrame:
        """Rows with `out`, the points up to each in order of (at, order)."""
        if width is None:
            return rows.withColumn(out, F.sum("_point").over(Window.partitionBy(key).orderBy(at, order).rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.withColumn("_part", F.floor(F.col(at) / max(1.0, width))).repartition(key, "_part")
        before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        carry = rows.groupBy(key, "_part").agg(F.sum("_point").alias("_n")).select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
        own = F.sum("_point").over(Window.partitionBy(key, "_part").orderBy(at, order).rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn(out, own).join(carry, [key, "_part"]).withColumn(out, F.col(out) + F.col("_carry")).drop("_part", "_carry")

    # at one time spans begin before its points and end after them
    rows = counted(counted(rows, "_start", F.col("_point").asc(), "first"), "_end", F.col("_point").desc(), "last")
    first = F.when(F.col("_point") == 1, F.col("first")).otherwise(F.col("first") + 1)
    rows = rows.select(key, "_point", t, "id", (F.col("_end") - F.col("_start")).alias("length"), first.alias("first"), "last")
    return stored(rows.where((F.col("_point") == 1) | (F.col("first") <= F.col("last"))))


def at_point(points: DataFrame, spans: DataFrame, key: str, t: str, *, most: int = PART) -> DataFrame:
    """For each point the shortest closed span of its key that holds it (of equals the least id).

    Bounds and points are whole numbers.  A key's points are numbered in order, and
    a span is the range of numbers that it holds.  It is listed at the nodes of a
    segment tree over the numbers that it is made of, two by level at most, so that
    its rows grow with the logarithm of the points in it, whatever its length; of each
    node the shortest span alone counts.  A point looks up the nodes that hold it,
    at those levels that any span of its key has, so the join is by equality.  Both
    sides are many times as large as a plan takes them for, and neither is
    broadcast.  Spans without a bound, or that end before they begin, hold nothing.
    """
    numbered = _numbered(points, spans, key, t, most)
    held = numbered.where("_point = 0")
    nodes = held.select(key, "id", "length", F.explode(tree_nodes(F.col("first"), F.col("last"))).alias("_n"))
    best = nodes.groupBy(key, F.col("_n.level").alias("level"), F.col("_n.place").alias("place")).agg(F.min(F.struct("length", "id")).alias("m"))
    levels = held.groupBy(key).agg(F.max(F.log2((F.col("last") - F.col("first") + 1).cast("double")).cast("int")).alias("_top"))
    asked = numbered.where("_point = 1").select(key, t, "first").hint("merge").join(levels, key)
    asked = asked.select(key, t, "first", F.explode(F.sequence(F.lit(0), "_top")).alias("level")).select(key, t, "level", _up(F.col("first"), F.col("level")).alias("place"))
    both = asked.hint("merge").join(best, [key, "level", "place"])
    return both.groupBy(key, t).agg(F.min("m").alias("m")).select(key, t, F.col("m.id").alias("id"))


def ordered_bounds(a: Column, b: Column, limit: Column | None = None, least: int = 1) -> tuple[Column, Column]:
    """Bounds in order, not below 0, `least` apart, and within the file where its end is known."""
    low = F.greatest(F.lit(0), F.least(a, b))
    high = F.greatest(low + least, F.greatest(a, b))
    if limit is None:
        return low, high
    capped = F.when(limit > 0, F.least(high, F.greatest(limit, F.lit(least)))).otherwise(high)
    return F.when(limit > 0, F.least(low, capped - least)).otherwise(low), capped


def nearest_edge(spans: DataFrame, x: float, within: float) -> DataFrame:
    """The edge nearest to x within a tolerance: (id, edge); of equals the first id, its start first."""
    edges = spans.select("id", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit("start").alias("edge"), F.col("start").alias("at")), F.struct(F.lit(1).alias("n"), F.lit("end").alias("edge"), F.col("end").alias("at")))).alias("e")).select("id", "e.*")
    near = edges.withColumn("d", F.abs(F.col("at") - x)).where(F.col("d") <= within)
    return near.orderBy("d", "id", "n").limit(1).select("id", "edge")


def envelope(rows: DataFrame, key: list[str], index: Column, value: str, count: Column, buckets: int) -> DataFrame:
    """(key, bucket, low, high, rms) over equal index ranges."""
    b = F.least(F.floor(index * buckets / count), F.lit(buckets - 1)).cast("int")
    return rows.withColumn("bucket", b).groupBy(*key, "bucket").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def nearest_point(points: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """The point nearest to (x, y), not farther than the radius; of equals the least id."""
    d = F.pow(F.col("x") - x, F.lit(2)) + F.pow(F.col("y") - y, F.lit(2))
    return points.withColumn("d2", d).where(F.col("d2") <= radius * radius).orderBy("d2", "id").limit(1)
