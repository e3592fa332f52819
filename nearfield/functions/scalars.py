"""Scalar expressions: missing-safe maths, texts, tempo and type rules.

Missing is NULL everywhere; NaN is turned into NULL at the boundary, because
Spark sorts it above all numbers and sums it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules.
TEMPO_MIN, TEMPO_MAX = 40.0, 240.0
MIN_BEATS = 4
BEAT_TOLERANCE, BEAT_TOLERANCE_NAMED = 0.15, 0.10
GRID_TOLERANCE, GRID_PARTS, GRID_FIT = 0.15, 4, 0.6
LOOP_SECONDS, LOOP_ONSETS, LOOP_PERIODICITY, LOOP_COVERAGE = 1.0, 4, 0.30, 0.5
ONE_SHOT_SECONDS = 2.0
PITCH_CLASSES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
SILENCE_DB = -120.0


def known(x: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    """x within [low, high]; NULL stays NULL, which greatest and least alone would lose."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(x.isNull(), None).otherwise(F.greatest(low, F.least(high, x)))


def ln_positive(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log2_positive(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


def log1p_nonnegative(x: Column) -> Column:
    return F.when(x >= 0, F.log1p(x))


def decibels(x: Column) -> Column:
    """20 log10 of an amplitude, not below the floor of silence."""
    return F.when(x.isNull(), None).when(x <= 0, F.lit(SILENCE_DB)).otherwise(F.greatest(F.lit(SILENCE_DB), 20 * F.log10(x)))


def resolved(value: Column, unit: Column, whole: Column) -> Column:
    """A length given in seconds, or in per cent of the whole."""
    return F.when(unit == "%", whole * value / 100).otherwise(value)


def along(t: Column, low: float, high: float) -> Column:
    """low..high by t in 0..1; t beyond stays at the ends."""
    return clip(t, 0.0, 1.0) * (high - low) + low


# Texts


def normalised_tag(x: Column) -> Column:
    """White space collapsed; a tag of none is NULL."""
    return F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def folder_of(path: Column) -> Column:
    """What stands before the last slash, '' for none."""
    return F.regexp_extract(F.regexp_replace(path, r"\\", "/"), "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; '<no-ext>' without one, also for names that begin with their only dot."""
    ext = F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))
    return F.when(ext == "", F.lit("<no-ext>")).otherwise(ext)


def bpm_in_name(name: Column) -> Column:
    """A number of 2 or 3 digits before 'bpm' in a name, if it is a tempo; one of '-', '_' and white space may stand between."""
    number = F.regexp_extract(F.lower(name), r"(?<![0-9])([0-9]{2,3})\s*[-_ ]?\s*bpm", 1)
    value = F.nullif(number, F.lit("")).cast("double")
    return F.when(value.between(TEMPO_MIN, TEMPO_MAX), value)


def clock(ms: Column) -> Column:
    """'12.345 s' below a minute, '7:10.250' from there on; whole numbers only, so nothing is rounded."""
    ms = ms.cast("long")
    part = F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0")
    seconds = F.floor(ms / 1000)
    short = F.concat(seconds.cast("string"), F.lit("."), part, F.lit(" s"))
    long = F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad(F.pmod(seconds, F.lit(60)).cast("string"), 2, "0"), F.lit("."), part)
    return F.when(ms < 60000, short).otherwise(long)


def hit_label(start: Column, end: Column, window: Column) -> Column:
    length = (end - start).cast("long")
    return F.when(window, F.concat(F.lit("window @ "), clock(start), F.lit(" ("), F.bround(length / 1000).cast("long").cast("string"), F.lit(" s)"))).otherwise(
        F.concat(F.lit("hit @ "), clock(start), F.lit(" ("), length.cast("string"), F.lit(" ms)"))
    )


def duration_text(seconds: Column) -> Column:
    """'45 s', '12 min', '1 h 20 min'; halves round to even."""
    minutes = F.floor(seconds / 60)
    hours = F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h "), F.lpad(F.pmod(minutes, F.lit(60)).cast("string"), 2, "0"), F.lit(" min"))
    whole = lambda x, unit: F.concat(F.bround(x).cast("long").cast("string"), F.lit(unit))
    return F.when(seconds < 90, whole(seconds, " s")).when(seconds < 5400, whole(seconds / 60, " min")).otherwise(hours)


def eta_text(elapsed: Column, done: Column, total: Column) -> Column:
    """The time left at the rate so far; '' before anything and after everything is done."""
    left = elapsed / done * (total - done)
    return F.when((done <= 0) | (total <= done) | (elapsed <= 0), F.lit("")).otherwise(F.concat(F.lit("ETA "), duration_text(left)))


def seconds_text(x: Column, places: int = 2) -> Column:
    return F.when(x.isNull(), F.lit("")).otherwise(F.format_string(f"%.{places}f s", F.bround(x, places)))


def whole_text(x: Column) -> Column:
    """A number without places, halves to even; '' for none."""
    return F.when(x.isNull(), F.lit("")).otherwise(F.bround(x).cast("long").cast("string"))


# Tempo, loop and type rules


def beat_aligned(duration: Column, bpm: Column, tolerance: float = BEAT_TOLERANCE) -> Column:
    """The tempo at which a length is a whole number of beats, if it is nearly so at `bpm`."""
    beats = duration * bpm / 60
    n = F.bround(beats)
    tempo = n * 60.0 / duration
    return F.when((bpm > 0) & (duration > 0) & (n >= MIN_BEATS) & (F.abs(beats - n) <= tolerance) & tempo.between(TEMPO_MIN, TEMPO_MAX), tempo)


def tempo_of_beats(beats: Column, duration: Column, one_shot: Column) -> Column:
    tempo = beats / duration * 60.0
    return F.when(~F.coalesce(one_shot, F.lit(False)) & (F.coalesce(beats, F.lit(0)) > 0) & (duration > 0) & tempo.between(TEMPO_MIN, TEMPO_MAX), tempo)


def grid_fit(onsets: Column, bpm: Column) -> Column:
    """The share of onsets near the best-phased grid of sixteenths: the circular mean of their phases is the grid's."""
    step = 60.0 / bpm / GRID_PARTS
    phases = F.transform(onsets, lambda t: F.pmod(t / step, F.lit(1.0)))
    total = lambda f: F.aggregate(phases, F.lit(0.0), lambda s, p: s + f(p * 2 * F.pi()))
    count = F.size(onsets)
    mean = F.pmod(F.atan2(total(F.sin) / count, total(F.cos) / count) / (2 * F.pi()), F.lit(1.0))
    near = F.filter(phases, lambda p: F.abs(F.pmod(p - mean + 0.5, F.lit(1.0)) - 0.5) <= GRID_TOLERANCE)
    return F.when((count < 2) | (bpm <= 0), F.lit(0.0)).otherwise(F.size(near) / count)


def acoustic_tempo(duration: Column, onset_count: Column, periodicity: Column, onsets: Column, peak_bpm: Column, tracked_bpm: Column) -> Column:
    """The whole-beat tempo that onsets speak for, or NULL.

    Tried are the periodicity peak, its octaves and the tracker's tempo; of those
    that fit, the one nearest to the tracker's (else the peak's) by ratio, the
    first on ties.
    """
    enough = (duration >= LOOP_SECONDS) & (onset_count >= LOOP_ONSETS) & (F.coalesce(periodicity, F.lit(0.0)) >= LOOP_PERIODICITY) & (F.size(onsets) > 0) & (F.element_at(onsets, -1) / duration >= LOOP_COVERAGE) & peak_bpm.isNotNull()
    reference = F.coalesce(tracked_bpm, peak_bpm)
    tried = F.array(peak_bpm, peak_bpm * 2, peak_bpm / 2, tracked_bpm)
    inside = F.filter(tried, lambda b: b.isNotNull() & b.between(TEMPO_MIN, TEMPO_MAX))
    aligned = F.filter(F.transform(inside, lambda b: beat_aligned(duration, b)), lambda t: t.isNotNull())
    fits = F.filter(aligned, lambda t: grid_fit(onsets, t) >= GRID_FIT)
    ranked = F.transform(fits, lambda t, i: F.struct(F.abs(F.ln(t / reference)).alias("d"), i.alias("i"), t.alias("t")))
    return F.when(enough, F.array_min(ranked)["t"])


def loop_verdict(*, one_shot: Column, beats: Column, flagged: Column, duration: Column, name: Column, onset_count: Column, acoustic: Column) -> Column:
    """STRUCT(is_loop, tempo): a one-shot flag, a beat count, a tempo in the name, what is heard, a loop flag, in this order."""
    counted = tempo_of_beats(beats, duration, one_shot)
    named = F.when(onset_count >= 1, beat_aligned(duration, bpm_in_name(name), BEAT_TOLERANCE_NAMED))
    tempo = F.coalesce(counted, named, acoustic)
    single = F.coalesce(one_shot, F.lit(False))
    return F.struct((~single & (tempo.isNotNull() | F.coalesce(flagged, F.lit(False)))).alias("is_loop"), F.when(~single, tempo).alias("tempo"))


def structural_type(is_loop: Column, onset_count: Column, duration: Column, cap: float | None = ONE_SHOT_SECONDS) -> Column:
    single = onset_count <= 1
    if cap is not None:
        single = single & (duration <= cap)
    return F.when(is_loop, F.lit("loop")).when(single, F.lit("one-shot")).otherwise(F.lit("multi-hit"))


def detection_profile(chosen: Column, kind: Column, content: Column) -> Column:
    """An explicit profile; else tight for loops and rhythmic content, loose for the rest."""
    tight = (kind == "loop") | F.coalesce(content == "rhythmic", F.lit(False))
    return F.when(chosen != "auto", chosen).when(tight, F.lit("tight")).otherwise(F.lit("loose"))


def key_of_root(root_set: Column, note: Column) -> Column:
    names = F.array(*map(F.lit, PITCH_CLASSES))
    return F.when(root_set & (note >= 0) & (note < 128), F.element_at(names, (F.pmod(note, F.lit(12)) + 1).cast("int")))


def tick_step(duration: Column, width: Column, steps: list[float], least: float = 70.0) -> Column:
    """The first step that stands `least` apart at least, else the last."""
    options = F.array(*(F.lit(float(s)) for s in steps))
    fits = F.filter(options, lambda s: (duration <= 0) | (width * s / duration >= least))
    return F.when(F.size(fits) > 0, F.element_at(fits, 1)).otherwise(F.lit(float(steps[-1])))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
