"""Spans and points of time against plain versions: moments by prefix sums, next events, interval trees."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from nearfield.operators import intervals


@pytest.mark.parametrize("part", [1 << 16, 16, 3])
def test_span_moments_equal_slices(spark, monkeypatch, part):
    monkeypatch.setattr(intervals, "PART", part)
    rng = random.Random(1)
    grid = {k: [(rng.choice([None, rng.gauss(50, 9), rng.gauss(50, 9)]), rng.random()) for _ in range(n)] for k, n in (("a", 200), ("b", 1), ("c", 0))}
    frames = spark.createDataFrame([(k, i, *v) for k, vs in grid.items() for i, v in enumerate(vs)], "k string, f int, x double, y double")
    spans = [(k, 1000 * n + i, a, a + rng.choice([-3, 0, 1, 5, 16, 200, 5000])) for n, k in enumerate("abc") for i in range(60) for a in [rng.randrange(-20, 2200)]]
    spans += [("a", 9000, None, 5), ("a", 9001, 5, None), ("none", 9002, 0, 5)]
    got = {r.id: r for r in intervals.span_moments(frames, spark.createDataFrame(spans, "k string, id long, start long, end long"), "k", "f", ["x", "y"], hop=10).collect()}
    assert len(got) == len(spans)
    for k, i, a, b in spans:
        rows = []
        if a is not None and b is not None and b > max(0, a) and k in grid:
            first = max(0, a) // 10
            rows = grid[k][first : max(first + 1, min(len(grid[k]), -(-b // 10)))]
        assert got[i].frames == len(rows)
        for c, name in ((0, "x"), (1, "y")):
            values = [r[c] for r in rows if r[c] is not None]
            mean, variance = (statistics.fmean(values), statistics.pvariance(values)) if values else (None, None)
            assert got[i][f"mean_{name}"] == (pytest.approx(mean) if values else None)
            assert got[i][f"variance_{name}"] == (pytest.approx(variance, abs=1e-6) if values else None)


def test_following_events(spark):
    rng = random.Random(2)
    rows = [(k, float(rng.choice([rng.randrange(40), rng.randrange(100_000)]))) for k in (1, 2) for _ in range(300)] + [(1, 5.0), (1, 8.0)]
    got = intervals.following(spark.createDataFrame(sorted(set(rows)), "k long, t double"), "k", "t", 3.0).collect()
    want = {(k, t): min((u for j, u in rows if j == k and u >= t + 3.0), default=None) for k, t in rows}
    assert {(r.k, r.t): r.next for r in got} == want and len(got) == len(want)


def test_one_hot_key_with_long_runs(spark):
    """Ten thousand events of one key, nearer to each other than the gap: one stretch of some thousand runs."""
    df = spark.range(10_000).select(F.lit(7).alias("k"), (F.col("id") * 0.7 + F.col("id") % 3 * 0.01).alias("t"), (F.col("id") % 11).cast("double").alias("s"))
    rows, want = sorted((r.t, r.s) for r in df.collect()), []
    for t, s in rows:
        if want and t - want[-1][0] < 2.0:
            want[-1][1] = max(want[-1][1], s)
        else:
            want.append([t, s])
    got = sorted((r.t, r.s) for r in intervals.merged_close(df, "k", "t", "s", 2.0).collect())
    assert got == [tuple(x) for x in want] and len(got) > 2000


def test_spans_of_any_length_are_a_few_nodes(spark):
    year = 31_536_000
    for a, b in ((0, 0), (-5, 7), (1_700_000_000, 1_700_000_000 + year), (1, year * 1_000_000), (-(2**40) + 3, 2**41 - 5), (7, 8)):
        nodes = [(n.level, n.place) for n in spark.range(1).select(intervals.tree_nodes(F.lit(a), F.lit(b)).alias("n")).first().n]
        covered = sorted((p << i, (p + 1 << i) - 1) for i, p in nodes)
        assert covered[0][0] == a and covered[-1][1] == b and all(x[1] + 1 == y[0] for x, y in zip(covered, covered[1:]))
        assert len(nodes) <= 2 * (b - a + 2).bit_length() and (b - a > year or len(nodes) < 50)


def test_points_in_spans_by_definition(spark):
    rng = random.Random(3)
    spans = [(rng.choice("ab"), i, s, s + rng.choice([-1, 0, 1, 9, 100, 5000])) for i in range(300) for s in [rng.randrange(-500, 500)]] + [("a", 900, None, 5), ("b", 901, 5, None)]
    points = [(rng.choice("abc"), rng.randrange(-700, 900)) for _ in range(400)] + [("a", None), (None, 5)]
    held = {}
    for k, t in points:
        inside = [(e - s, i) for j, i, s, e in spans if j == k and t is not None and s is not None and e is not None and s <= t <= e]
        if inside:
            held[k, t] = min(inside)[1]
    got = intervals.at_point(spark.createDataFrame(points, "k string, t long"), spark.createDataFrame(spans, "k string, id long, start long, end long"), "k", "t").collect()
    assert {(r.k, r.t): r.id for r in got} == held and len(got) == len(held)


@pytest.mark.parametrize("most", [7, 1 << 16])
def test_points_in_spans_of_a_key_that_is_cut_into_parts(spark, most):
    rng = random.Random(8)
    spans = [("ab"[i % 9 == 0], i, s, s + rng.choice([0, 3, 90, 10**6, 10**13])) for i in range(300) for s in [rng.choice([rng.randrange(-60, 60), rng.randrange(10**6), 10**12 + rng.randrange(50)])]]
    points = [("ab"[i % 9 == 0], rng.choice([rng.randrange(-60, 90), rng.randrange(10**6), 10**12 + rng.randrange(60)])) for i in range(400)]
    held = {}
    for k, t in points:
        inside = [(e - s, i) for j, i, s, e in spans if j == k and s <= t <= e]
        if inside:
            held[k, t] = min(inside)[1]
    got = intervals.at_point(spark.createDataFrame(points, "k string, t long"), spark.createDataFrame(spans, "k string, id long, start long, end long"), "k", "t", most=most).collect()
    assert {(r.k, r.t): r.id for r in got} == held and len(got) == len(held)


def test_a_span_costs_nodes_by_the_points_in_it(spark):
    """Not by its length: three points are two nodes at most of each of two levels, whatever lies between them."""
    year = 31_536_000_000_000
    points = spark.createDataFrame([("a", i * year) for i in range(3)], "k string, t long")
    spans = spark.createDataFrame([("a", 1, -5 * year, 9 * year), ("a", 2, year - 1, 2 * year), ("a", 3, 5, 6)], "k string, id long, start long, end long")
    rows = intervals._numbered(points, spans, "k", "t", 1 << 16).where("_point = 0").collect()
    assert sorted((r.id, r.first, r.last) for r in rows) == [(1, 1, 3), (2, 2, 3)]
    assert sorted(tuple(r) for r in intervals.at_point(points, spans, "k", "t").collect()) == [("a", 0, 1), ("a", year, 2), ("a", 2 * year, 2)]


def test_loudness_near_onsets_by_time(spark):
    rng = random.Random(4)
    onsets = [(k, rng.uniform(0, 500), rng.random()) for k in "ab" for _ in range(80)] + [("c", 1.0, 0.5), ("c", 2.0, 0.1), (None, 1.0, 1.0), ("a", None, 1.0), ("d", 1.0, 0.4)]
    levels = [(k, rng.uniform(-5, 505), rng.random() ** 6) for k in "ab" for _ in range(120)] + [("d", 0.0, 0.0), ("a", None, 9.0), ("b", 3.0, None)]
    levels += [("b", t, 5.0) for k, t, s in onsets[80:90]]
    o, v = spark.createDataFrame(onsets, "k string, t double, s double"), spark.createDataFrame(levels, "k string, t double, level double")
    for within in (0.5, 300.0):
        want = []
        for k, t, s in onsets:
            if k is None or t is None:
                continue
            own = [x for x in levels if x[0] == k and x[2] is not None]
            loudest = max((x[2] for x in own), default=0)
            near = max((x[2] for x in own if x[1] is not None and abs(x[1] - t) <= within), default=None)
            if s >= 0.3 * max(x[2] for x in onsets if x[0] == k) and (loudest <= 0 or (near is not None and near >= 0.2 * loudest)):
                want.append((k, t, s))
        got = intervals.loud_near(o, v, "k", "t", "s", "level", within=within)
        assert sorted(map(tuple, got.collect())) == sorted(want) and got.columns == ["k", "t", "s"]


def test_frames_that_overlap(spark):
    rng = random.Random(5)
    series = {"a": [rng.gauss(0, 1) for _ in range(203)], "b": [2.0], "c": [1.0] * 16}
    df = spark.createDataFrame([(k, i, x) for k, xs in series.items() for i, x in enumerate(xs)], "k string, i long, x double")
    want = {}
    for k, xs in series.items():
        for f in range(1 + len(xs) // 4):
            own = xs[max(0, 4 * f - 8) : 4 * f + 8]
            want[k, f] = (sum(x * x for x in own) / 16) ** 0.5
    got = {(r.k, r.frame): r.rms for r in intervals.framed_rms(df, "k", "i", "x", frame=16, hop=4).collect()}
    assert got == pytest.approx(want)
    with pytest.raises(ValueError):
        intervals.framed_rms(df, "k", "i", "x", frame=10, hop=4)


def test_decay_round_the_first_onset(spark):
    levels = [0.0, 0.3, 0.5, 0.04, 0.0, 0.0, 0.2, 1.0, 0.9, 0.05]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(levels)] + [("b", i, x) for i, x in enumerate(levels)] + [("z", 0, 0.0)], "k string, f long, x double")
    first = spark.createDataFrame([("a", 1), ("z", 0)], "k string, first long")
    got = {r.k: (r.peak, r.attack, r.decay) for r in intervals.attack_decay(df, "k", "f", "x", first=first, before=1, after=3).collect()}
    assert got == {"a": (2, 1, 1), "b": (7, 1, 2)}
    far = spark.createDataFrame([("a", 50)], "k string, first long")
    assert {r.k: r.peak for r in intervals.attack_decay(df, "k", "f", "x", first=far, before=1, after=3).collect()} == {"a": 7, "b": 7}


@pytest.mark.parametrize("part", [1 << 16, 64])
def test_periods_between_whole_lags(spark, monkeypatch, part):
    import math

    monkeypatch.setattr(intervals, "PART", part)
    period = 17.3
    xs = [math.cos(2 * math.pi * i / period) for i in range(2000)]
    df = spark.createDataFrame(list(enumerate(xs)), "i long, x double").withColumn("k", F.lit("a"))
    r = intervals.autocorrelation(df, "k", "i", "x", (8, 30))
    zero = sum(x * x for x in xs)
    want = {lag: sum(xs[i] * xs[i - lag] for i in range(lag, len(xs))) / zero for lag in range(8, 31)}
    assert {x.lag: x.r for x in r.collect()} == pytest.approx(want, abs=1e-10)
    found = intervals.best_local_peak(r, "k").first()
    a, b, c = (want[lag] for lag in (16, 17, 18))
    assert found.lag == 17 and found.refined == pytest.approx(17 + 0.5 * (a - c) / (a - 2 * b + c), abs=1e-6) and abs(found.refined - period) < 0.05
