"""Chat formatting, sharding, top-k, URL filters, quality and mixing: plain versions, odd rows, held-out accuracy."""

import datetime
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.llm import chat, mixing, quality, sharding, topk, urlfilter

# Chat


def test_preference_pairs(spark):
    schema = "pair_id long, turn long, role string, text string, n long, c string, side string"
    row = lambda p, t, r, x: (p, t, r, x, 1, "x", "y")
    chosen = spark.createDataFrame([row(1, 2, "assistant", "good"), row(1, 1, "user", "hi"), row(1, 0, "system", None), row(2, 0, "user", "q"), row(3, 0, "user", "same"), row(4, None, "user", "lost"), row(None, 0, "user", "lost")], schema)
    rejected = spark.createDataFrame([row(1, 0, "system", ""), row(1, 1, "user", "hi"), row(1, 2, "assistant", "bad é"), row(1, 3, "user", "why"), row(3, 0, "user", "same"), row(5, 0, "assistant", "only")], schema)
    got = {r.pair_id: r for r in chat.formatted(chosen, rejected).collect()}
    assert set(got) == {1, 2, 3, 5}
    a = got[1]
    assert a.prompt == "<|im_start|>system\n<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n" and a.prompt_turns == 2
    assert a.chosen == "<|im_start|>assistant\ngood<|im_end|>\n" and a.rejected.endswith("user\nwhy<|im_end|>\n")
    (span,) = a.rejected_mask.split(",")
    begin, end = map(int, span.split("-"))
    assert a.rejected[begin:end] == "bad é<|im_end|>\n" and a.chosen[int(a.chosen_mask.split("-")[0]) :] == "good<|im_end|>\n"
    assert (got[2].prompt, got[2].rejected, got[2].tie) == ("", "", False)
    assert (got[3].chosen, got[3].rejected, got[3].tie) == ("", "", True)
    assert got[5].chosen == "" and got[5].rejected_mask != ""
    assert chat.formatted(chosen.where("false"), rejected.where("false")).count() == 0


def test_repeated_tied_and_long_turns(spark):
    long = "x" * 400_000
    schema = "pair_id long, turn long, role string, text string"
    chosen = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", long), (2, 5, "user", "q"), (2, 5, "user", "q")], schema)
    rejected = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b"), (1, 1, "assistant", "y" + long), (2, 5, "user", "q")], schema)
    got = {r.pair_id: r for r in chat.formatted(chosen, rejected).collect()}
    turn = "<|im_start|>user\n{}<|im_end|>\n".format
    assert got[1].prompt == turn("a") * 2 + turn("b") and got[1].prompt_turns == 3
    begin, end = map(int, got[1].chosen_mask.split("-"))
    assert got[1].chosen[begin:end] == long + "<|im_end|>\n" and got[1].rejected == f"<|im_start|>assistant\ny{long}<|im_end|>\n"
    assert (got[2].prompt, got[2].chosen, got[2].rejected, got[2].tie) == (turn("q"), turn("q"), "", False)


def test_null_last_answer_is_swapped_in_as_empty(spark):
    turns = spark.createDataFrame([(0, 0, "assistant", "own"), (1, 0, "assistant", None), (2, 0, "assistant", "alone")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.text for r in chat.with_swapped_answer(turns).collect()} == {0: "", 1: "own", 2: "alone"}


def test_main_path_is_native(spark):
    turns = spark.createDataFrame([(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "assistant", "c")], "conv_id long, turn long, role string, text string")
    out = chat.formatted(turns.withColumnRenamed("conv_id", "pair_id"), chat.with_swapped_answer(turns).withColumnRenamed("conv_id", "pair_id"))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert {r.pair_id: r.rejected for r in out.collect()} == {0: "<|im_start|>assistant\nc<|im_end|>\n", 1: "<|im_start|>assistant\nb<|im_end|>\n"}


# Sharding


def test_shards_are_even_and_places_have_no_gaps(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(6000)] + [(7, "again"), (7, "again"), (None, None), (9999, "é")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, shard int, slot int")
    got = sharding.sharded(df, 24).collect()
    assert len(got) == len(rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == sorted((-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    loads, places = [0] * 24, [[] for _ in range(24)]
    for r in got:
        loads[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert max(loads) <= 1.01 * min(loads)
    assert all(sorted(p) == list(range(len(p))) for p in places)
    assert sharding.sharded(df.where("false"), 24).count() == 0


def test_map_versions(spark, tmp_path):
    rng = random.Random(1)
    sizes = [rng.randint(0, 1000) for _ in range(2000)]
    first = sharding.SlotMap.balanced(sizes, 10)
    grown = first.grown(sizes, 11)
    moved = [(a, b) for a, b in zip(first.shard_of, grown.shard_of, strict=True) if a != b]
    assert moved and all(b == 10 for _, b in moved) and max(grown.loads(sizes)) < 1.06 * min(grown.loads(sizes))
    skewed = [s * 3 if x == 0 else s for s, x in zip(sizes, first.shard_of, strict=True)]
    again = first.rebalanced(skewed)
    assert max(again.loads(skewed)) < 1.02 * min(again.loads(skewed)) and again.version == 2
    assert sum(a != b for a, b in zip(first.shard_of, again.shard_of, strict=True)) < 600
    path = str(tmp_path / "map")
    for m in (first, again):
        m.save(spark, path)
    assert sharding.load(spark, path) == again and sharding.load(spark, path, 1) == first
    with pytest.raises(ValueError):
        first.save(spark, path)
    assert sharding.SlotMap.balanced([0] * 5, 2).shard_of == (0, 1, 0, 1, 0)


# Top-k


@pytest.mark.parametrize("clustered", [False, True])
def test_top_k_as_by_brute_force(spark, clustered, monkeypatch):
    monkeypatch.setattr(topk, "GROUP", 300)
    monkeypatch.setattr(topk, "CHUNK", 7)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 8))
    if clustered:
        x = rng.standard_normal((9, 8))[rng.integers(0, 9, 900)] + 0.01 * x
    x[50:80] = x[0]
    rows = [(i * 10, v.tolist(), 1, 1) for i, v in enumerate(x)] + [(1, None, 1, 1), (2, [1.0, None], 1, 1), (3, [float("nan")], 1, 1), (4, [float("inf")], 1, 1), (None, [1.0] * 8, 1, 1), (0, x[0].tolist(), 1, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, id int")
    got = sorted(tuple(r) for r in topk.search(df, F.col("id") % 50 == 0).collect())
    whole = np.floor(256 * x).astype(int)
    want = []
    for q in range(0, 900, 5):
        s = whole @ whole[q]
        best = sorted((j for j in range(900) if j != q), key=lambda j: (-s[j], j))[:5]
        want += [(q * 10, n + 1, j * 10, int(s[j])) for n, j in enumerate(best)]
    assert got == sorted(want)
    assert topk.search(df.where("false"), F.col("id") % 50 == 0).count() == 0
    few = topk.search(df.where("vec_id in (0, 10)"), F.col("id") % 50 == 0).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 10)]


def test_blocks_are_left_out():
    rng = np.random.default_rng(4)
    x = (256 * (rng.standard_normal((40, 16)) * 3)[np.repeat(np.arange(40), 200)] + rng.integers(-9, 9, (8000, 16))).astype(np.int64)
    blocks = topk.Blocks(np.arange(8000), x)
    blocks.top(np.arange(0, 8000, 400), x[::400], 5)
    assert blocks.scored < 0.5 * 8000 * 20


@pytest.mark.parametrize("bits", [5, 20, 26, 30, 31, 40, 52, 60, 100, 1000])
def test_scores_are_exact_at_every_size(bits):
    """Against Python's integers; beyond the longs, the nearest long."""
    rng = np.random.default_rng(bits)
    x = np.trunc(rng.uniform(-1, 1, (300, 64)) * 2.0**bits)
    x[::7] = np.trunc(x[::7] * 2.0 ** -(bits - 3))
    x[10:14] = x[10]
    ids, qids, q = np.arange(300), np.arange(0, 300, 9), x[::9]
    got = list(zip(*(a.tolist() for a in topk.Blocks(ids, x, 16).top(qids, q, 5)), strict=True))
    whole = [[int(c) for c in row] for row in x]
    want = []
    for n in qids.tolist():
        s = {j: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[n], whole[j], strict=True)))) for j in range(300) if j != n}
        want += [(n, j, s[j]) for j in sorted(s, key=lambda j: (-s[j], j))[:5]]
    assert got == want


def test_odd_vectors_take_part(spark):
    """Large, very large, very long, short and empty finite vectors: none stands aside, none ends the query."""
    rows = [(0, [300000.0, 1.0]), (1, [300000.0, 2.0]), (2, [1e300, 0.0]), (3, [-1e308, 1e308]), (4, []), (5, [1.0]), (50, [0.5] * 5000), (51, [0.25] * 5000), (52, [2.0**40, 2.0**-9])]
    got = {}
    for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, k=8).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert set(got) == {0, 50} and all(len(v) == 8 for v in got.values())
    top, low = 2**63 - 1, -(2**63)
    assert got[0] == {1: 76800000**2 + 256 * 512, 2: top, 3: low, 4: 0, 5: 76800000 * 256, 50: 76800000 * 128 + 256 * 128, 51: 76800000 * 64 + 256 * 64, 52: top if 76800000 * 2**48 > top else 76800000 * 2**48}
    assert got[50] == {0: 128 * (76800000 + 256), 1: 128 * (76800000 + 512), 2: top, 3: 0, 4: 0, 5: 128 * 256, 51: 128 * 64 * 5000, 52: 128 * 2**48}


# URL filters


def plain_judged(url, day, entries):
    import re

    m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", url or "")
    if not m or day is None:
        return ""
    host = re.sub(":[0-9]*$", "", re.sub("^.*@", "", m[1])).lower()
    path = host + "/" + "/".join(s for s in m[2].split("/") if s) + "/"
    out = set()
    for name, kind, pattern in {e[:3] for e in entries}:
        hit = ("." + host).endswith("." + pattern) if kind == "domain" else path.startswith(pattern + "/")
        past = sorted((e[4], e[3]) for e in entries if e[:3] == (name, kind, pattern) and e[4] <= day)
        if host and hit and past and past[-1][1] == "add":
            out.add(name)
    return ",".join(sorted(out))


def test_url_verdicts_as_by_brute_force(spark):
    rng = random.Random(8)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "xa.com", "d.org"]
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    entries = [(rng.choice("pq"), "domain", rng.choice(hosts[:4]), rng.choice(["add", "remove"]), day(rng.randint(0, 60))) for _ in range(30)]
    entries += [("s", "prefix", f"{rng.choice(hosts)}/{rng.choice(['x', 'x/y'])}", rng.choice(["add", "remove"]), day(rng.randint(0, 60))) for _ in range(30)]
    entries += [entries[0]]
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'u@', 'WWW.'])}{rng.choice(hosts)}{rng.choice(['', ':80'])}/{rng.choice(['', 'x', 'x/y/', 'xy', '//x//y'])}{rng.choice(['', '?q=/x', '#f'])}" for _ in range(300)]
    rows = [(u, day(rng.randint(0, 70)), "k", "l") for u in urls] + [(None, day(1), "k", "l"), ("nothing", day(1), "k", "l"), ("http://", day(1), "k", "l"), (urls[0], None, "k", "l"), ("http://a.com/" + "x/" * 20_000, day(40), "k", "l")]
    captures = spark.createDataFrame(rows, "url string, day date, kind string, lists_ string")
    listed = spark.createDataFrame([*entries, (None, "domain", "a.com", "add", day(0))], "list string, kind string, pattern string, action string, day date")
    got = urlfilter.judged(captures, listed)
    assert sorted((r.url or "", str(r.day), r.lists, r.blocked) for r in got.collect()) == sorted((u or "", str(d), (v := plain_judged(u, d, entries)), v != "") for u, d, *_ in rows)
    assert got.columns == ["url", "day", "kind", "lists_", "blocked", "lists"]
    assert urlfilter.judged(captures, listed.where("false")).where("blocked").count() == 0
    assert urlfilter.judged(captures.where("false"), listed).count() == 0


def test_times_of_one_day_and_odd_patterns(spark, monkeypatch):
    at = lambda hour, minute=0: datetime.datetime(2024, 5, 1, hour, minute, 0, 1)
    entries = [("p", "domain", " *.A.com. ", "add", at(18)), ("p", "domain", "a.com", "remove", at(20)), ("q", "prefix", "http://B.com:80//x/", "add", at(18)), ("r", "prefix", "C.org", "add", at(18)), ("s", "other", "a.com", "add", at(0)), ("s", "domain", "/", "add", at(0))]
    listed = spark.createDataFrame(entries, "list string, kind string, pattern string, action string, at timestamp")
    rows = [("http://a.com/", at(17, 59), ""), ("http://www.a.com/", at(18), "p"), ("http://a.com", at(19), "p"), ("http://a.com/", at(20), ""), ("http://b.com/x/y", at(19), "q"), ("http://b.com/", at(19), ""), ("http://c.org", at(19), "r"), ("http://c.org/z", at(19), "r"), ("http://d.c.org/z", at(19), "")]
    captures = spark.createDataFrame([(u, t, w, False, "x") for u, t, w in rows], "url string, fetched timestamp, want string, blocked boolean, lists string")
    for hot in (4096, 2):
        monkeypatch.setattr(urlfilter, "HOT", hot)
        out = urlfilter.judged(captures, listed, day="fetched", entry_time="at")
        assert out.columns == ["url", "fetched", "want", "blocked", "lists"]
        got = out.collect()
        assert len(got) == len(rows) and all(r.lists == r.want and r.blocked == (r.want != "") for r in got)


# Quality


def _prose(rng, n):
    return " ".join(rng.choice(["the", "river", "stone", "walks", "over", "green", "and", "old", "house"]) + rng.choice(["", "", ",", "."]) for _ in range(n))


def _rated(rng, n):
    out = []
    for i in range(n):
        grade, text = rng.choice([0, 1, 2, 2]), _prose(rng, rng.randint(5, 200))
        if grade == 0:
            text = rng.choice([text.upper() + "!!", " ".join(w + "&&&" for w in text.split()), "spam spam " * 20])
        elif grade == 1:
            text = text.replace(" ", " vile ", 2)
        out.append((i, text, grade))
    return out


def test_grades_of_held_out_rows():
    rng = random.Random(6)
    rows = _rated(rng, 900)
    at = lambda part: list(quality.features(pa.array([t for _, t, _ in part])))
    model = quality.fit(at(rows[:600]), np.array([g for *_, g in rows[:600]]), 3)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(np.array([model.weights[x].sum() for x in at(rows[600:])]))
    grade = np.array([g for *_, g in rows[600:]])
    assert ((tails[:, -1] >= quality.MIN_TAIL) == (grade == 2)).mean() > 0.97
    assert np.corrcoef(tails.sum(axis=1), grade)[0, 1] > 0.9


def test_quality_of_odd_rows(spark):
    rng = random.Random(7)
    rows = _rated(rng, 300)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in rows] + [(1000, None, "x", "y"), (1001, "", "x", "y"), (1001, "", "x", "y"), (1002, "stone " * 30_000, "x", "y")], "doc_id long, text string, id string, tail string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows] + [(0, 0), (None, 1), (5, None), (9999, 1)], "doc_id long, grade int")
    model = quality.fit_rated(docs, ratings, n_grades=3)
    out = quality.scored(docs, model)
    got = out.collect()
    assert len(got) == 304 and out.columns == ["doc_id", "text", "id", "tail", "expected_grade", "tail_probability"]
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    assert quality.scored(docs, quality.fit_rated(docs, ratings.where("false"), n_grades=3)).where("tail_probability < 0.99").count() == 0
    assert quality.scored(docs.where("false"), model).count() == 0
    few = quality.fit_rated(docs, ratings, n_grades=3, max_train=50)
    assert few.weights.shape == model.weights.shape


def plain_fit(x, grades, l2):
    """Penalised maximum likelihood by plain descent with halved steps, on the likelihood as it is written: weights and thresholds."""
    n, width = x.shape

    def loss(p):
        w, t = p[:width], np.concatenate([[p[width]], p[width] + np.cumsum(np.exp(p[width + 1 :]))])
        tail = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-(x @ w)[:, None] + t)), np.zeros((n, 1))], axis=1)
        chance = tail[np.arange(n), grades] - tail[np.arange(n), grades + 1]
        return -np.log(chance).sum() + l2 / 2 * w @ w

    p, rate = np.zeros(width + 2), 0.01
    for _ in range(4000):
        slope = np.array([(loss(p + h) - loss(p - h)) / 2e-5 for h in np.eye(len(p)) * 1e-5])
        while rate > 1e-12 and loss(p - rate * slope) > loss(p):
            rate /= 2
        p, rate = p - rate * slope, rate * 1.5
        if np.abs(slope).max() < 1e-3:
            break
    return p[:width], np.array([p[width], p[width] + np.exp(p[width + 1])])


def test_fit_as_by_plain_maximum_likelihood():
    rng = np.random.default_rng(3)
    x = rng.random((400, 4)) < [0.5, 0.4, 0.3, 0.2]
    z = x @ np.array([2.0, -1.5, 1.0, -2.5]) + rng.logistic(size=400)
    grades = (z > -0.5).astype(int) + (z > 1.0)
    model = quality.fit([np.flatnonzero(r) for r in x], grades, 3, least_z=0.0, least_r=0.0, steps=2000)
    w, t = plain_fit(x.astype(float), grades, 0.3)
    assert model.weights[:4] == pytest.approx(w, abs=0.02) and model.thresholds == pytest.approx(t, abs=0.02)
    assert model.tails(x @ model.weights[:4]) == pytest.approx(1 / (1 + np.exp(-(x @ w)[:, None] + t)), abs=0.01)
    # the steps that the operator takes come near it, too
    usual = quality.fit([np.flatnonzero(r) for r in x], grades, 3, least_z=0.0, least_r=0.0)
    assert usual.tails(x @ usual.weights[:4]) == pytest.approx(model.tails(x @ model.weights[:4]), abs=0.03)
    nothing = quality.fit([np.array([1, 2])] * 400, grades, 3)
    assert nothing.tails(np.zeros(1))[0, -1] > 0.99


def test_names_of_results_are_replaced(spark):
    df = spark.createDataFrame([(1, "some text", "old", "x")], "doc_id long, text string, expected_grade string, copies string")
    out = quality.scored(df, quality.CumulativeLink(np.zeros(quality.WIDTH), np.zeros(2)))
    assert out.columns == ["doc_id", "text", "copies", "expected_grade", "tail_probability"] and out.first().expected_grade == 1.0
    mix = mixing.mixed(df, {"lang": F.lit("en")}, {}, percent=100, copies="copies")
    assert mix.columns == ["doc_id", "text", "expected_grade", "lang", "copies"] and mix.first().copies == 1


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_keeps_clean_documents_of_the_tables(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    model = quality.fit_rated(docs, quality.grades(half), n_grades=3)
    rows = quality.scored(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "toxic", "tail_probability").collect()
    kept = {key: [r.tail_probability >= quality.MIN_TAIL for r in rows if (r.quality, r.toxic) == key] for key in ((1, 0), (1, 1), (0, 0))}
    assert np.mean(kept[1, 0]) > 0.98 and np.mean(kept[1, 1]) < 0.2 and np.mean(kept[0, 0]) < 0.05


# Mixing


def plain_fill(budget, nodes):
    """Shares by weight until all is given or all are full, by steps of the tightest sibling."""
    out, live = dict.fromkeys(nodes, 0.0), {n for n, (w, c) in nodes.items() if w > 0}
    left = budget
    while live and left > 1e-9:
        total = sum(nodes[n][0] for n in live)
        step = min(left / total, min((nodes[n][1] - out[n]) / nodes[n][0] for n in live))
        for n in live:
            out[n] += step * nodes[n][0]
        left -= step * total
        live = {n for n in live if nodes[n][1] - out[n] > 1e-9}
    return out


def test_budgets_as_by_plain_filling(spark):
    rng = random.Random(2)
    leaves = {(d, x): rng.randint(0, 500) for d in "abc" for x in "pqrs"}
    weights = {"d": {"a": 5.0, "b": 1.0}, "x": {"p": 3.0, "q": 0.0, "r": 0.5}}
    w = lambda level, v: weights[level].get(v, 1.0)
    df = spark.createDataFrame([(d, x, s) for (d, x), s in leaves.items()], "d string, x string, supply long")
    for percent in (5, 40, 90, 300):
        got = {(r.d, r.x): r.own for r in mixing.budgets(df, ["d", "x"], weights, percent, 2).collect()}
        budget = sum(leaves.values()) * percent // 100
        top = plain_fill(budget, {d: (w("d", d), sum(2 * s for (e, x), s in leaves.items() if e == d and w("x", x) > 0)) for d in "abc"})
        for d in "abc":
            low = plain_fill(top[d], {x: (w("x", x), 2 * leaves[d, x]) for x in "pqrs"})
            for x in "prs":
                assert abs(got[d, x] - low[x]) <= 1
        assert not any(k[1] == "q" for k in got)


def test_many_children_of_one_parent_are_filled_in_parts(spark):
    rng = random.Random(9)
    leaves = {f"host{i}": rng.choice([0, 1, 7, 7, rng.randint(1, 10**6)]) for i in range(3000)}
    df = spark.createDataFrame(list(leaves.items()), "d string, supply long")
    got = {r.d: r.own for r in mixing.budgets(df, ["d"], {}, 30, 1).collect()}
    want = plain_fill(sum(leaves.values()) * 30 // 100, {d: (1.0, s) for d, s in leaves.items()})
    assert set(got) == set(leaves) and all(abs(got[d] - want[d]) <= 1 for d in leaves)


@pytest.mark.parametrize("few", [100_000, 1])
def test_small_and_large_leaf_tables_agree(spark, monkeypatch, few):
    """On both sides of the size up to which leaves are broadcast."""
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", few)
    df = spark.createDataFrame([(i, "w " * (i % 9), f"s{i % 5}") for i in range(400)], "doc_id long, text string, source string")
    got = sorted(r.doc_id for r in mixing.mixed(df, {"source": F.col("source")}, {"source": {"s1": 3.0}}, percent=40).collect())
    assert len(got) > 100 and zlib.crc32(repr(got).encode()) == zlib.crc32(repr(sorted(set(got))).encode())
    monkeypatch.undo()
    assert got == sorted(r.doc_id for r in mixing.mixed(df, {"source": F.col("source")}, {"source": {"s1": 3.0}}, percent=40).collect())


def test_mixture_is_a_seeded_prefix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["en", None]), rng.choice(["s1", "s2"]), "x", "y") for i in range(1500)] + [(5, "w w", "en", "s1", "x", "y"), (2000, None, "en", "s1", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, full string, last string")
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    take = lambda percent, epochs=1: {(r.doc_id, r.text): r.n for r in mixing.mixed(df, levels, {"lang": {"en": 3.0}}, percent=percent, max_epochs=epochs, copies="n").collect()}
    small, large = take(20), take(60)
    assert set(small) <= set(large) and len(small) < len(large) < len(rows)
    tokens = sum(len((t or "").split()) * n for (_, t), n in large.items())
    total = sum(len((r[1] or "").split()) for r in rows)
    assert 0.6 * total <= tokens + 30 and tokens <= 0.6 * total + 4 * 31
    assert len(take(100)) == len({(r[0], r[1]) for r in rows})
    twice = take(170, 2)
    assert set(twice.values()) == {1, 2}
    assert mixing.mixed(df.where("false"), levels, {}).count() == 0
    assert mixing.mixed(df, levels, {}).columns == df.columns
