"""Scalar rules and arrays on small values, missing ones included."""

import math

import pytest
from pyspark.sql import functions as F

from nearfield.functions import arrays
from nearfield.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


lit = F.lit
none = lambda kind="double": F.lit(None).cast(kind)


@pytest.mark.parametrize(("ms", "text"), [(0, "0.000 s"), (1234, "1.234 s"), (59999, "59.999 s"), (60000, "1:00.000"), (430250, "7:10.250")])
def test_clock(spark, ms, text):
    assert one(spark, S.clock(lit(ms))) == text


def test_hit_labels(spark):
    assert one(spark, S.hit_label(lit(1234), lit(1484), lit(False))) == "hit @ 1.234 s (250 ms)"
    assert one(spark, S.hit_label(lit(10000), lit(12500), lit(True))) == "window @ 10.000 s (2 s)"


@pytest.mark.parametrize(("seconds", "text"), [(44.5, "44 s"), (45.5, "46 s"), (89.9, "90 s"), (90.0, "2 min"), (720.0, "12 min"), (4800.0, "80 min"), (5400.0, "1 h 30 min")])
def test_durations(spark, seconds, text):
    assert one(spark, S.duration_text(lit(seconds))) == text


def test_eta(spark):
    assert one(spark, S.eta_text(lit(10.0), lit(1), lit(10))) == "ETA 2 min"
    assert one(spark, S.eta_text(lit(10.0), lit(0), lit(10))) == "" == one(spark, S.eta_text(lit(10.0), lit(10), lit(10)))


@pytest.mark.parametrize(("duration", "bpm", "tempo"), [(4.0, 121.0, 120.0), (2.7586, 174.0, 174.0), (3.13, 143.6, None), (1.0, 120.0, None), (0.0, 120.0, None)])
def test_whole_beats(spark, duration, bpm, tempo):
    got = one(spark, S.beat_aligned(lit(duration), lit(bpm)))
    assert got is None if tempo is None else math.isclose(got, tempo, abs_tol=0.05)


def test_clip_keeps_missing(spark):
    assert one(spark, S.clip(none(), -4.0, 4.0)) is None
    assert one(spark, S.clip(lit(9.0), -4.0, 4.0)) == 4.0
    assert one(spark, S.known(lit(float("nan")))) is None


def test_gated_logs(spark):
    assert one(spark, S.ln_positive(lit(0.0))) is None and one(spark, S.log1p_nonnegative(lit(-0.1))) is None
    assert one(spark, S.decibels(lit(0.0))) == -120.0 and one(spark, S.decibels(lit(0.1))) == pytest.approx(-20)


@pytest.mark.parametrize(("name", "bpm"), [("loop 120 BPM.wav", 120.0), ("x_95bpm", 95.0), ("x1200bpm", None), ("30 bpm", None), ("bpm 120", None), ("120_bpm_2", 120.0), ("120  bpm", 120.0), ("a 120 - bpm", 120.0), ("120 -- bpm", None)])
def test_tempo_in_names(spark, name, bpm):
    assert one(spark, S.bpm_in_name(lit(name))) == bpm


def test_loop_verdict_precedence(spark):
    base = dict(one_shot=none("boolean"), beats=none("int"), flagged=lit(False), duration=lit(4.0), name=lit("x"), onset_count=lit(4), acoustic=none())
    verdict = lambda **kw: tuple(one(spark, S.loop_verdict(**(base | kw))))
    assert verdict() == (False, None)
    assert verdict(beats=lit(8), name=lit("100bpm")) == (True, 120.0)
    assert verdict(one_shot=lit(True), beats=lit(8)) == (False, None)
    assert verdict(name=lit("a 120 bpm"), acoustic=lit(90.0)) == (True, 120.0)
    assert verdict(name=lit("a 120 bpm"), onset_count=lit(0)) == (False, None)
    assert verdict(acoustic=lit(90.0)) == (True, 90.0)
    assert verdict(flagged=lit(True)) == (True, None)


def test_acoustic_tempo(spark):
    clicks = F.array(*(lit(0.5 * i) for i in range(8)))
    tempo = lambda **kw: one(spark, S.acoustic_tempo(**(dict(duration=lit(4.0), onset_count=lit(8), periodicity=lit(0.9), onsets=clicks, peak_bpm=lit(60.0), tracked_bpm=lit(121.0)) | kw)))
    assert tempo() == pytest.approx(120.0)
    assert tempo(tracked_bpm=none()) == pytest.approx(60.0)
    assert tempo(periodicity=none()) is None and tempo(onset_count=lit(3)) is None and tempo(peak_bpm=none()) is None


def test_types_keys_profiles(spark):
    assert one(spark, S.structural_type(lit(False), lit(1), lit(0.4))) == "one-shot"
    assert one(spark, S.structural_type(lit(False), lit(1), lit(2.5))) == "multi-hit"
    assert one(spark, S.structural_type(lit(False), lit(1), lit(2.5), None)) == "one-shot"
    assert one(spark, S.key_of_root(lit(True), lit(69))) == "A" and one(spark, S.key_of_root(lit(False), lit(69))) is None
    assert one(spark, S.detection_profile(lit("auto"), lit("multi-hit"), none("string"))) == "loose"


def test_names(spark):
    assert one(spark, S.normalised_tag(lit("  Kick \t Drum "))) == "Kick Drum" and one(spark, S.normalised_tag(lit("  "))) is None
    assert one(spark, S.extension(lit("a/b/c.WAV"))) == ".wav" and one(spark, S.extension(lit("a.b/readme"))) == "<no-ext>"
    assert one(spark, S.base_name(lit("a\\b/c.wav"))) == "c.wav" and one(spark, S.folder_of(lit("c.wav"))) == ""


def test_arrays(spark):
    v = F.array(lit(3.0), lit(4.0))
    assert one(spark, arrays.unit(v)) == [0.6, 0.8] and one(spark, arrays.unit(F.array(lit(0.0), lit(0.0)))) == [0.0, 0.0]
    assert one(spark, arrays.dot(v, F.array(lit(1.0)))) is None
    assert one(spark, arrays.from_json_list(lit("[1,2]"), 3)) is None and one(spark, arrays.from_json_list(lit("x"), 1)) is None
    assert sum(one(spark, arrays.softmax(v))) == pytest.approx(1.0)
    assert one(spark, arrays.faded(F.array_repeat(lit(1.0), 4), 1000)) == [0.0, 1.0, 1.0, 0.0]
