"""Operators on inline tables: ranking, filters, intervals, vectors, state, ingestion."""

import random

import pytest
from pyspark.sql import functions as F

from nearfield import io, schema
from nearfield.operators import catalog, filters, intervals, similarity, state, vectors
from nearfield.sources import ingest


def frame(spark, rows, spec):
    return spark.createDataFrame(rows, spec)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Ranking


def blend(spark, d, weights):
    df = frame(spark, [tuple(d)], ", ".join(f"d_{a} double" for a in "abcde"))
    return df.select(similarity.blend(dict(zip("abcde", weights, strict=True))).alias("x")).first()["x"]


def test_blend(spark):
    d = (0.2, None, 0.4, 0.6, 0.0)
    assert blend(spark, d, [1] * 5) == pytest.approx(0.3)
    assert blend(spark, [None] * 5, [1] * 5) is None
    assert blend(spark, d, [0, 1, 0, 0, 0]) is None and blend(spark, d, [0] * 5) is None
    assert blend(spark, d, [1, 0, 0, -3, 0]) == pytest.approx(0.2)


def test_fold_prefers_the_parent_on_ties_and_the_least_child(spark):
    s = frame(
        spark,
        [("sample", 1, 1, None, None, False, 0.5), ("segment", 11, 1, 0, 1, False, 0.5), ("sample", 2, 2, None, None, False, 0.2), ("segment", 22, 2, 5, 6, False, 0.9), ("segment", 21, 2, 0, 1, False, 0.9), ("segment", 31, 3, 0, 1, True, 0.1), ("sample", 4, 4, None, None, False, None)],
        "kind string, id long, parent long, start long, end long, window boolean, score double",
    )
    assert rows_of(similarity.fold(s).select("sample_id", "score", "hit_id", "hit_window")) == [(1, 0.5, None, None), (2, 0.9, 21, False), (3, 0.1, 31, True)]


def test_statistics_ignore_missing_and_nan(spark):
    p = frame(spark, [(i, float(x) if x is not None else None, 1.0) for i, x in enumerate([1, 2, 3, 100, None, float("nan")])], "id long, x double, y double")
    c = frame(spark, [], "id long, parent long, start long, end long, window boolean, x double, y double")
    axes = similarity.Axes({"x": ["x"], "y": ["y"]}).fitted(similarity.population(p, c, ["x", "y"]))
    assert axes.centre == {"x": 2.5, "y": 1.0} and axes.spread["y"] == 1.0 and axes.spread["x"] == pytest.approx(1.4826)
    z = {r.id: r.x for r in axes.standardised(p).collect()}
    assert z[3] == 4.0 and z[4] is None and z[5] is None


def test_scale_of_nothing_leaves_distances(spark):
    d = frame(spark, [(0.0, None), (0.0, 2.0), (0.0, 4.0)], "d_a double, d_b double")
    assert rows_of(similarity.scaled(d, ["a", "b"]))[0][0] == 0.0
    assert [r.d_b for r in similarity.scaled(d, ["a", "b"]).orderBy("d_b").collect()] == [None, pytest.approx(2 / 3.9), 1.0]


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_quantiles_of_many_values_are_exact(spark, share):
    import numpy as np

    from nearfield.operators.quantiles import quantiles

    df = spark.range(40_000).selectExpr("id", "cast(hash(id) as double) x", "case when id % 3 > 0 then 7.0D else id * 1.0D end y", "cast(null as double) z", "case when id < 9 then sqrt(id) end w")
    for held in (20_000, 20, 3):
        got = quantiles(df, {c: F.col(c) for c in "xyzw"}, share, held=held)
        assert got.pop("z") is None
        for c, value in got.items():
            assert value == pytest.approx(np.quantile(df.select(c).dropna().toPandas()[c], share))
    assert quantiles(df.where("false"), {"x": F.col("x")}, share) == {"x": None}


def test_search_normalises_the_query_alone(spark):
    items = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0])], "id long, vector array<double>")
    assert rows_of(similarity.searched(items, [0.0, 5.0], 2).select("id", "score")) == [(1, 0.0), (2, 2.0)]
    assert rows_of(similarity.searched(items, [0.0, 0.0], 2).select("score")) == [(0.0,), (0.0,)]


def test_zero_weights_are_refused(spark):
    with pytest.raises(ValueError):
        similarity.weighted_matrix(similarity.Axes({"x": ["x"]}), {"x": 0.0})


# Filters

LIST = [(1, "kick.wav", "one-shot", 0.4, None, None, "kick drum, percussion", 0), (2, "loop.wav", "loop", 4.0, 120.0, "Am", "drum loop, percussion", 6), (3, "pad.wav", "multi-hit", 12.0, None, "C", "synth pad, strings", 3)]


def test_column_filters(spark):
    df = frame(spark, LIST, "id long, file string, type string, seconds double, bpm double, key string, tags string, hits int")
    ids = lambda c: sorted(r.id for r in df.where(c).collect())
    perc = filters.ColumnFilter(text="PERCUSSION").column(F.col("tags"), F.lit(-1))
    assert ids(perc) == [1, 2]
    assert ids(perc & filters.ColumnFilter(low=1).column(F.col("hits"), F.col("hits"))) == [2]
    assert ids(filters.ColumnFilter(low=100).column(F.col("bpm"), F.coalesce("bpm", F.lit(-1.0)))) == [2]
    assert ids(filters.ColumnFilter(high=999).column(F.col("bpm"), F.coalesce("bpm", F.lit(-1.0)))) == [2]
    assert ids(filters.ColumnFilter(values=frozenset({""})).column(F.col("key"), F.lit(0))) == [1]
    assert ids(filters.Criteria(types=frozenset({"loop"})).column(type_col="type")) == [2]
    assert ids(filters.Criteria(ranges={"bpm": (None, 200.0)}).column()) == [2]


def test_scope_is_not_a_pattern(spark):
    df = frame(spark, [("A/x",), ("B_x/y",), ("Bax/y",), ("b_X/z",)], "p string")
    of = lambda folders: sorted(r.p for r in df.where(filters.in_folders(F.col("p"), folders)).collect())
    assert of(["B_x"]) == ["B_x/y", "b_X/z"] and of([]) == [] and len(of(None)) == 4


def test_requests(spark):
    assert filters.criteria_of(types={"a", "b"}, all_types={"a", "b"}, ranges={"x": (0, 0)}, axes_percent={"k": (0, 100)}) == filters.Criteria()
    assert filters.criteria_of(axes_percent={"k": (10, 100)}).axis_ranges == {"k": (0.1, 1.0)}


def test_outermost_and_counts(spark):
    df = frame(spark, [("/a",), ("/a/b/",), ("/ab",), ("/c/d",)], "path string")
    assert rows_of(filters.outermost(df)) == [("/a",), ("/ab",), ("/c/d",)]
    files = frame(spark, [("/a/x",), ("/a/b/y",), ("/abc",)], "filepath string")
    assert rows_of(filters.counts_under(df, files)) == [("/a", 2), ("/a/b/", 1), ("/ab", 0), ("/c/d", 0)]


# Intervals


def cut(spark, events, whole, **rules):
    df = frame(spark, [(1, float(t), float(s)) for t, s in events], "k int, t double, s double")
    out = intervals.boundaries(df, "k", "t", "s", F.lit(float(whole)), intervals.Segmentation(**rules))
    return [(round(r.start, 6), round(r.end, 6), r.found, r.capped, r.effective) for r in sorted(out.collect(), key=lambda r: r.start)]


def test_boundaries(spark):
    assert [x[:2] for x in cut(spark, [(0, 1), (1, 0.9), (2, 0.8)], 3, max_length=5.0)] == [(0, 1), (1, 2), (2, 3)]
    assert [x[:2] for x in cut(spark, [(0, 1), (0.2, 0.9)], 4, boundary="fixed", max_length=0.5)] == [(0, 0.5), (0.2, 0.7)]
    assert [x[:2] for x in cut(spark, [(0, 1), (0.01, 0.9), (2, 0.8)], 5, min_length=0.05, max_length=0.5)] == [(0.01, 0.51), (2, 2.5)]
    capped = cut(spark, list(enumerate([0.2, 1, 0.4, 0.9, 0.3])), 5, most=2, max_length=5.0)
    assert [x[0] for x in capped] == [1, 3] and capped[0][2:] == (5, True, 0.9)
    assert cut(spark, [(0, 1)], 0) == []


def test_bad_rules():
    for bad in ({"sensitivity": 2}, {"most": 0}, {"min_length": 3.0}, {"profile": "x"}, {"min_unit": "m"}, {"boundary": "x"}):
        with pytest.raises(ValueError):
            intervals.Segmentation(**bad)


def test_merging_compares_with_the_first_of_a_run(spark):
    rows = [("a", t, s) for t, s in [(0.0, 0.5), (0.06, 0.9), (0.1, 0.2), (0.12, 0.7)]] + [("b", 5.0, None), ("b", 5.0, 0.1), ("b", 5.1, 0.3), (None, 1.0, 1.0), ("b", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, at double, w double")
    assert rows_of(intervals.merged_close(df, "k", "at", "w", 0.08)) == [("a", 0.0, 0.9), ("a", 0.1, 0.7), ("b", 5.0, 0.1), ("b", 5.1, 0.3)]
    assert intervals.merged_close(df.where("false"), "k", "at", "w", 0.08).count() == 0


@pytest.mark.parametrize("dense", [0.3, 3.0, 300.0])
def test_merging_over_many_parts_as_in_one_pass(spark, dense):
    rng = random.Random(1)
    times = sorted(rng.uniform(0, 3000 * dense) for _ in range(3000))
    df = spark.createDataFrame([(rng.choice([1, 1, 1, 2]), t, rng.random()) for t in times], "k long, t double, s double")
    want, held = [], {}
    for k, t, s in sorted(map(tuple, df.collect())):
        if k in held and t - held[k][1] < 2.0:
            held[k][2] = max(held[k][2], s)
        else:
            held[k] = [k, t, s]
            want.append(held[k])
    assert sorted(map(tuple, intervals.merged_close(df, "k", "t", "s", 2.0).collect())) == sorted(map(tuple, want))


def test_autocorrelation_over_parts(spark, monkeypatch):
    rng = random.Random(2)
    series = {k: {i: rng.random() for i in range(200) if rng.random() < 0.9} for k in "ab"} | {"z": {0: 0.0, 2: 0.0}}
    df = spark.createDataFrame([(k, i, x) for k, s in series.items() for i, x in s.items()], "k string, i long, x double")
    want = {(k, lag): sum(x * s[i + lag] for i, x in s.items() if i + lag in s) / sum(x * x for x in s.values()) for k, s in series.items() if k != "z" for lag in range(2, 7)}
    for part in (1 << 16, 10, 3):
        monkeypatch.setattr(intervals, "PART", part)
        got = {(r.k, r.lag): r.r for r in intervals.autocorrelation(df, "k", "i", "x", (2, 6)).collect()}
        assert got == pytest.approx(want)


@pytest.mark.parametrize(("n", "want"), [(5, [(0, 5)]), (25, [(0, 10), (10, 20), (20, 25)]), (20, [(0, 10), (10, 20)]), (0, [(0, 0)])])
def test_windows(spark, n, want):
    got = spark.range(1).select(intervals.window_spans(F.lit(n), 10, 1).alias("w")).first()["w"]
    assert [tuple(s) for s in got] == want


def test_many_windows_are_spread(spark):
    got = spark.range(1).select(intervals.window_spans(F.lit(1000), 10, 1).alias("w")).first()["w"]
    assert len(got) == 24 and got[0].start == 0 and got[-1].start == 990


def test_containment_and_edges(spark):
    spans = frame(spark, [(1, 1, 0, 10), (1, 2, 5, 8), (1, 3, 6, 9)], "k int, id long, start long, end long")
    points = frame(spark, [(1, 7), (1, 10), (1, 50)], "k int, t long")
    assert rows_of(intervals.at_point(points, spans, "k", "t")) == [(1, 10, 1), (1, 7, 2)]
    assert rows_of(intervals.nearest_edge(spans, 5.4, 1.0)) == [(2, "start")]
    assert rows_of(intervals.nearest_edge(spans, 20.0, 1.0)) == []


def test_attack_and_decay(spark):
    levels = [0.0, 0.01, 0.5, 1.0, 0.5, 0.05, 0.0]
    df = frame(spark, [(1, i, v) for i, v in enumerate(levels)] + [(2, 0, 0.0)] + [(3, 0, 1.0), (3, 1, 0.5)], "k int, f int, v double")
    assert rows_of(intervals.attack_decay(df, "k", "f", "v").select("k", "attack", "decay")) == [(1, 1, 2), (3, 0, None)]


# Vectors


def test_retrieval_of_planted_groups(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = [np.eye(8)[g] + 0.05 * rng.standard_normal(8) for g in range(3) for _ in range(4)] + [np.eye(8)[7]]
    df = frame(spark, [(i, x.tolist(), min(i // 4, 3)) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    p = {r.q: r.precision for r in vectors.precision(vectors.neighbours(df, 3), df, "vec_id", "label").collect()}
    assert all(p[i] == 1.0 for i in range(12)) and p[12] == 0.0
    s = vectors.separation(df, "label").first()
    assert s.separation > 0.8
    assert vectors.separation(df.where("label = 0"), "label").first().across is None


def test_zero_shot_ties_and_threshold(spark):
    s = frame(spark, [(1, "rhythmic", 0.50, 0.9), (1, "melodic", 0.49, 0.9), (2, "rhythmic", 0.5, 0.9), (2, "melodic", 0.1, 0.9), (3, "vocal", 0.5, None), (3, "other", 0.5, None)], "id long, class string, score double, h double")
    got = {r.id: r for r in vectors.zero_shot(s, "id", ["rhythmic", "melodic", "vocal", "other"], 10.0, harmonic=F.col("h"), threshold=0.5).collect()}
    assert got[1].best == "melodic" and got[2].assigned == "rhythmic" and got[3].best == "vocal"
    assert got[1].assigned is None and got[1].confidence < 0.5


def test_plane_keeps_distances(spark):
    df = frame(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)], "id long, v array<double>")
    plane, mean, axes = vectors.principal_plane(df, "id", "v")
    x = {r.id: r.x for r in plane.collect()}
    assert abs(x[5] - x[0]) == pytest.approx(5 * 5**0.5) and mean.tolist() == pytest.approx([2.5, 5.0, 5.0])
    assert rows_of(vectors.placed(df.where("id = 5"), "id", "v", mean, axes).select("x"))[0][0] == pytest.approx(x[5])


# State


def test_corrections_stay(spark):
    rows = frame(spark, [(1, "a", True), (2, "a", False), (3, None, False)], "id long, class string, confirmed boolean")
    found = frame(spark, [(1, "b"), (2, "b")], "id long, class string")
    assert rows_of(state.corrected(rows, "id", "class", found)) == [(1, "a", True), (2, "b", False), (3, None, False)]


def test_tags(spark):
    tags, uses = frame(spark, [(1, "Kick Drum")], "id long, name string"), frame(spark, [(10, 1)], "sample_id long, tag_id long")
    tags, uses = state.tags_added(tags, uses, "sample_id", 11, " kick  drum ")
    assert rows_of(tags) == [(1, "Kick Drum")] and rows_of(uses) == [(10, 1), (11, 1)]
    tags, uses = state.tags_added(tags, uses, "sample_id", 11, "pad")
    for item in (10, 11):
        tags, uses = state.tags_removed(tags, uses, "sample_id", item, "KICK DRUM")
    assert rows_of(tags) == [(2, "pad")] and rows_of(uses) == [(11, 2)]
    with pytest.raises(ValueError):
        state.tags_added(tags, uses, "sample_id", 1, "  ")


def test_staleness_is_three_valued(spark):
    df = frame(spark, [(1, None, 5), (2, 5, None), (3, 5, 6), (4, 6, 5)], "id long, stamp int, changed int")
    due = df.where(state.analysis_due(F.col("stamp"), F.col("changed"))).select("id")
    stale = df.where(state.segments_stale(F.col("stamp"), F.col("changed"))).select("id")
    assert rows_of(due) == [(1,), (3,)] and rows_of(stale) == [(3,)]


def test_replacing_segments(spark):
    spec = "id long, sample_id long, start_ms long, end_ms long, detection_method string, is_user_confirmed boolean"
    old = frame(spark, [(1, 7, 0, 5, "auto", False), (2, 7, 5, 9, "auto", True), (3, 7, 0, 9, "manual", False), (4, 8, 0, 5, "auto", False)], spec)
    new = frame(spark, [(7, 5, 9, "auto", False), (7, 3, 3, "auto", False), (7, 1, 4, "auto", False), (7, 1, 4, "auto", False)], "sample_id long, start_ms long, end_ms long, detection_method string, is_user_confirmed boolean")
    got = rows_of(state.replaced_segments(old, new, [7], 100).select("id", "sample_id", "start_ms", "end_ms"))
    assert got == [(100, 7, 1, 4), (2, 7, 5, 9), (3, 7, 0, 9), (4, 8, 0, 5)]


def test_migration_never_loosens(spark):
    old = frame(spark, [(1, True), (2, None)], "sample_id long, is_user_confirmed boolean")
    got = state.migrated("classification", old, 1, schema.VERSION)
    assert rows_of(got.select("content_class_confirmed", "structural_type_confirmed")) == [(False, False), (True, True)]
    with pytest.raises(ValueError):
        state.migrated("classification", old, 9, 3)


def test_folders(spark):
    libs = frame(spark, [("/a", True), ("/b", False)], "path string, in_scope boolean")
    assert state.scope_paths(libs) == ["/a"] and state.scope_paths(libs.where("not in_scope")) == [] and state.scope_paths(libs.where("false")) is None


def test_keyed_writes(spark, tmp_path):
    old, new = frame(spark, [(1, "a"), (2, "b")], "k long, v string"), frame(spark, [(2, "c"), (3, "d")], "k long, v string")
    assert rows_of(io.upsert(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows_of(io.insert_ignore(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        io.published(spark, path)
    io.publish(old, path)
    before = io.published(spark, path)
    # the new version is made from the old one, which its readers keep until it is retired
    io.publish(io.upsert(before, new, ["k"]), path)
    assert rows_of(io.published(spark, path)) == [(1, "a"), (2, "c"), (3, "d")] and rows_of(before) == [(1, "a"), (2, "b")]
    assert len(io.retired(spark, path)) == 1 and io.retired(spark, path) == []
    assert rows_of(io.published(spark, path)) == [(1, "a"), (2, "c"), (3, "d")]


def test_schemas():
    names = {f.name for f in schema.DESCRIPTORS}
    assert names <= {f.name for f in schema.ANALYSIS} and names <= {f.name for f in schema.SEGMENT_ANALYSIS}
    assert "tempo_bpm" not in names and len(schema.TABLES) == 14


# Ingestion


def test_comparison(spark):
    known = frame(spark, [(1, "/l/a", 5, 1.0, "h"), (2, "/l/b", 5, 1.0, "h"), (3, "/l/c", 5, 1.0, "h"), (4, "/l/d", 5, 1.0, "h"), (5, "/l/bad/e", 5, 1.0, "h"), (6, "/other/f", 5, 1.0, "h")], "id long, path string, size long, mtime double, hash string")
    found = frame(spark, [("/l/a", 5, 1.0, None), ("/l/b", 5, 2.0, "h"), ("/l/c", 5, 2.0, "x"), ("/l/new", 1, 1.0, "n")], "path string, size long, mtime double, hash string")
    got = {r.path: r.change for r in ingest.compared(found, known, unread=["/l/bad"], root="/l").collect()}
    assert got == {"/l/a": "unchanged", "/l/b": "identical", "/l/c": "changed", "/l/d": "removed", "/l/bad/e": "protected", "/other/f": "outside", "/l/new": "added"}


def test_ambiguous_twins_do_not_move(spark):
    spec = "path string, name string, size long, duration double, rate int, channels int, hash string"
    old = frame(spark, [(1, "x/hit.wav", "hit.wav", 5, 1.0, 1, 1, None), (2, "y/hit.wav", "hit.wav", 5, 1.0, 1, 1, None), (3, "z/k.wav", "k.wav", 6, 1.0, 1, 1, None), (4, "q/h.wav", "h.wav", 7, 1.0, 1, 1, "H")], "id long, " + spec)
    new = frame(spark, [("n/hit.wav", "hit.wav", 5, 1.0, 1, 1, "a"), ("m/hit.wav", "hit.wav", 5, 1.0, 1, 1, "a"), ("n/k.wav", "k.wav", 6, 1.0, 1, 1, "b"), ("n/other.wav", "other.wav", 7, 1.0, 1, 1, "H")], spec)
    assert rows_of(ingest.moved(old, new)) == [(3, "z/k.wav", "n/k.wav"), (4, "q/h.wav", "n/other.wav")]


def test_eviction(spark):
    files = frame(spark, [("a", 10, 100, True), ("b", 10, 7300, True), ("c", 10, 200, True), ("d", 99, 9000, False)], "path string, size long, used long, referenced boolean")
    assert rows_of(ingest.evicted(files, 20)) == [("a", "old"), ("d", "orphan")]
    assert rows_of(ingest.evicted(files, None)) == [("d", "orphan")]


def test_listing(spark, tmp_path):
    import hashlib
    import os

    for p in ("a.wav", "sub/b.WAV", "sub/c.flac", "loop.rx2", "._x.wav", "readme", "_packs/d.wav", ".kits/_e.wav", "sub/_f/g.wav"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(p.encode() * 3)
    os.symlink(tmp_path, tmp_path / "sub" / "loop")
    files, unread = ingest.walked(spark, str(tmp_path))
    assert rows_of(ingest.kinds_of(files)) == [("._*", 1), (".flac", 1), (".rx2", 1), (".wav", 5), ("<no-ext>", 1)]
    assert {(r.folder, r.filename) for r in files.collect()} >= {("_packs", "d.wav"), (".kits", "_e.wav"), ("sub/_f", "g.wav"), ("", "._x.wav")}
    assert unread.count() == 0 and ingest.walked(spark, f"{tmp_path}/none")[1].count() == 1
    for root in (f"file:{tmp_path}", f"file://{tmp_path}"):
        assert ingest.listing(spark, root).count() == 9
    both = ingest.hashed(files).join(ingest.contents(files).drop("error"), "path").collect()
    assert len(both) == 9 and all(r.error is None and r.hash == hashlib.blake2b(r.content).hexdigest() for r in both)
    gone = ingest.hashed(spark.createDataFrame([(f"{tmp_path}/none.wav",)], "path string")).first()
    assert gone.hash is None and "none.wav" in gone.error


def test_layouts_are_kept(spark, tmp_path):
    from nearfield.sources import layouts

    items = spark.createDataFrame([(i, [float(i), float(i * i % 7), 1.0]) for i in range(20)], "id long, vector array<double>")
    segments = spark.createDataFrame([(100, 3)], "id long, parent long")
    folder = str(tmp_path / "layouts")
    first = {r.id: (r.x, r.y) for r in layouts.fitted(items, folder, 1, {"a": 1.0}).collect()}
    assert layouts.loaded(spark, folder, 1)[0] == {"a": 1.0}
    none = spark.createDataFrame([(3, 9.0, 9.0), (4, 9.0, 9.0)], "id long, x double, y double")
    got = {r.id: (r.x, r.y) for r in layouts.place(none, items, segments, folder, 1, "segment", 100).collect()}
    assert got[3] == pytest.approx(first[3]) and got[4] == (9.0, 9.0)
    for bad in (lambda: layouts.fitted(items, folder, 2, {"a": 0.0}), lambda: layouts.fitted(items.limit(2), folder, 2, {"a": 1.0}), lambda: layouts.place(none, items, segments, folder, 1, "segment", 5), lambda: layouts.place(none, items, segments, folder, 1, "sample", 77)):
        with pytest.raises(ValueError):
            bad()


def test_catalogue_parts(spark):
    t = frame(spark, [(1, "b", 0.9), (1, "a", 0.9), (1, "c", 0.1), (1, "d", None)], "id long, tag string, score double")
    assert rows_of(catalog.top_joined(t, "id", "tag", "score", 2)) == [(1, "a, b")]
    base = frame(spark, [(1, 0, 5), (2, 5, 9)], "id long, start int, end int")
    edits = frame(spark, [(1, 0, 5), (2, 6, 9)], "id long, start int, end int")
    assert rows_of(catalog.staged(base, edits, frame(spark, [(-1, 1, 2)], "id long, start int, end int"))) == [(-1, 1, 2, True), (1, 0, 5, False), (2, 6, 9, True)]
