"""The kept index of a population: statistics, refreshes, versions and plans."""

import os
import random

import pytest
from pyspark.sql import functions as F

from nearfield import files, working
from nearfield.io import Tables
from nearfield.operators import index, similarity
from nearfield.operators.quantiles import quantiles
from nearfield.plans import ranking

AXES = similarity.Axes({"a": ["x", "y"], "b": ["w"], "none": ["v"]})
SCHEMA = "kind string, id long, parent long, start long, end long, window boolean, x double, y double, w double, v double"


def items(spark, seed, n, first):
    rng = random.Random(seed)
    pick = lambda f: rng.choice([None, float("nan"), f(), f(), f(), f()])
    rows = [(("sample", "segment")[i % 3 > 0], first + i, first + i - i % 3, i, i + 5, i % 5 == 0, pick(lambda: rng.gauss(3, 2)), pick(lambda: float(rng.randrange(3))), pick(rng.random), None) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def source(spark, seed, n, first, asked=None):
    def made():
        if asked is not None:
            asked.append(seed)
        return items(spark, seed, n, first)

    return index.Source(f"v{seed}-{n}", made)


@pytest.fixture
def path(spark):
    return working.fresh(spark, "index-test")


def under(path):
    top = path.removeprefix("file://") + "/items"
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(top) for f in fs if f.endswith(".parquet")}


def test_parts_that_are_written_at_once_keep_their_files(spark, path):
    """Another writer's unfinished files, below the items, outlast a refresh."""
    kept = index.Index(spark, path, AXES, buckets=4)
    kept.refresh({"p": source(spark, 1, 300, 0)})
    other = path.removeprefix("file://") + "/items/_temporary/0/unfinished"
    os.makedirs(other)
    kept.refresh({"p": source(spark, 1, 300, 0), "q": source(spark, 2, 50, 3000)})
    assert os.path.isdir(other) and kept.items().count() == 350


def test_many_parts_at_once_are_whole(spark, path):
    kept = index.Index(spark, path, AXES, buckets=4)
    sizes = [4000, 10, 3000, 20, 2000, 30, 1000, 40]
    kept.refresh({f"p{i}": source(spark, i, n, 10_000 * i) for i, n in enumerate(sizes)})
    assert kept.state.rows == kept.items().count() == sum(sizes)


def test_statistics_are_those_of_all_items_and_a_new_part_is_merged(spark, path):
    kept, asked = index.Index(spark, path, AXES, buckets=4), []
    parts = {"p": source(spark, 1, 3000, 0, asked), "q": source(spark, 2, 50, 3000, asked)}
    assert kept.refresh(parts) == ["p", "q"] and kept.refresh(parts) == [] and asked == [1, 2]
    before = under(path)
    parts["r"] = source(spark, 3, 900, 6000, asked)
    assert kept.refresh(parts) == ["r"] and asked == [1, 2, 3]
    # files of parts that haven't changed are neither read anew nor written
    assert before.items() <= under(path).items()
    whole = items(spark, 1, 3000, 0).unionByName(items(spark, 2, 50, 3000)).unionByName(items(spark, 3, 900, 6000))
    fitted = AXES.fitted(whole)
    assert kept.state.rows == 3950
    assert kept.state.centre == pytest.approx(fitted.centre) and kept.state.spread == pytest.approx(fitted.spread)
    weights = {"a": 1.0, "b": 0.7, "none": 1.0}
    plain = similarity.Ranker(whole, AXES)
    for kind, item in (("segment", 1), ("sample", 6000), ("segment", 3001)):
        shown = lambda r: sorted((x.sample_id, round(x.score, 9), x.hit_id) for x in r.ranked(kind, item, weights).collect())  # noqa: B023, E731
        assert shown(kept.ranker(parts)) == shown(plain)
    # another session's view of the same folder
    again = index.Index(spark, path, AXES, buckets=99)
    assert again.buckets == 4 and again.state == kept.state
    with pytest.raises(ValueError):
        index.Index(spark, path, similarity.Axes({"a": ["x"]}))


def test_changed_sources_are_refused_until_a_refresh(spark, path):
    kept = index.Index(spark, path, AXES, buckets=2)
    with pytest.raises(index.StaleIndex):
        kept.ranker()
    old = {"p": source(spark, 1, 60, 0), "q": source(spark, 5, 60, 600)}
    kept.refresh(old)
    new = {"p": source(spark, 4, 90, 0)}
    with pytest.raises(index.StaleIndex):
        kept.ranker(new)
    reader = kept.ranker(old)
    assert kept.refresh(new) == ["p"]
    with pytest.raises(index.StaleIndex):
        kept.ranker(old)
    # who reads the older state goes on with it
    assert reader.items.count() == 120 and kept.ranker(new).items.count() == 90
    kept.vacuum()
    assert kept.ranker(new).items.count() == 90 and len(files.names(spark, f"{path}/states")) == 1
    assert kept.refresh({}) == [] and kept.state.rows == 0


def test_ranking_on_the_index_has_no_exchange(spark, path):
    kept = index.Index(spark, path, AXES, buckets=4)
    kept.refresh({"p": source(spark, 1, 300, 0), "q": source(spark, 2, 300, 600)})
    ranked = kept.ranker().ranked("segment", 1, {"a": 1.0, "b": 1.0})
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Bucketed: true" in plan
    assert ranked.count() > 0


def test_empty_parts(spark, path):
    kept = index.Index(spark, path, AXES, buckets=2)
    kept.refresh({"p": source(spark, 1, 0, 0)})
    assert kept.state.rows == 0 and kept.state.centre["x"] is None and kept.state.spread["x"] == 1.0
    with pytest.raises(ValueError):
        kept.ranker().ranked("segment", 1, {"a": 1.0})


def buckets_of(path, own):
    """The bucket of each file of a part."""
    return [f.split("_")[-1].split(".")[0] for f in os.listdir(path.removeprefix("file://") + f"/items/part={own}") if f.endswith(".parquet")]


def test_buckets_follow_the_items(spark, path, monkeypatch):
    """A task sorts no more of a large population than of a small one, also of one that has grown."""
    monkeypatch.setattr(index, "BUCKET_ROWS", 100)
    kept = index.Index(spark, path, AXES)
    parts = {"p": source(spark, 1, 3000, 0), "q": source(spark, 2, 30, 3000)}
    kept.refresh(parts)
    assert kept.state.buckets == 31 and len(buckets_of(path, kept.state.parts["p"][1])) == 31
    reader, own = kept.ranker(parts), kept.state.parts["p"]
    parts["r"] = source(spark, 3, 2000, 6000)
    assert kept.refresh(parts) == ["r"] and kept.state.buckets == 31 and kept.state.parts["p"] == own
    parts["s"] = source(spark, 4, 2000, 9000)
    assert kept.refresh(parts) == ["p", "q", "r", "s"] and kept.state.buckets == 71
    assert kept.state.rows == kept.items().count() == 7030 and reader.items.count() == 3030
    whole = items(spark, 1, 3000, 0).unionByName(items(spark, 2, 30, 3000)).unionByName(items(spark, 3, 2000, 6000)).unionByName(items(spark, 4, 2000, 9000))
    shown = lambda r: sorted((x.sample_id, round(x.score, 9), x.hit_id) for x in r.ranked("segment", 1, {"a": 1.0, "b": 0.7}).collect())
    assert shown(index.Index(spark, path, AXES).ranker(parts)) == shown(similarity.Ranker(whole, AXES))
    kept.vacuum()
    assert kept.items().count() == 7030


def test_buckets_stay_at_those_that_need_no_sorted_shuffle():
    """Up to MOST_ROWS items each."""
    assert [index._buckets_for(n, 12) for n in (0, 750_000, 45_000_000, 99_000_000, 270_000_000, 600_000_000)] == [12, 12, 90, 198, 200, 400]
    assert [index._buckets_for(n, 600) for n in (0, 45_000_000, 600_000_000)] == [200, 200, 400]


def test_lines_are_moved_once_into_buckets(spark, path):
    """What brings an order's lines together deals them into buckets too."""
    lines = ranking.sources(Tables(spark, "/root/testdata/sf0.001"))["lineitem"]
    kept = index.Index(spark, path, ranking.AXES, buckets=5)
    kept.refresh({"lineitem": lines})
    dealt = kept._selected(lines.dealt(5))
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "hashpartitioning(l_orderkey" in plan and ", 5)" in plan
    found = buckets_of(path, kept.state.parts["lineitem"][1])
    assert len(found) == len(set(found)) == 5
    want = kept._selected(lines.items())
    assert kept.items().exceptAll(want).isEmpty() and want.exceptAll(kept.items()).isEmpty()


def test_the_sample_is_that_of_least_hash(spark, path, monkeypatch):
    """Tasks send few rows for it, and it is whole where hashes are equal."""
    monkeypatch.setattr(index, "SAMPLE", 50)
    same = items(spark, 2, 900, 3000).withColumn("id", F.lit(7).cast("long"))
    kept = index.Index(spark, path, AXES, buckets=8)
    kept.refresh({"p": source(spark, 1, 3000, 0), "q": index.Source("same", lambda: same), "r": source(spark, 3, 20, 9000)})
    held = {p: sorted(r.h for r in spark.read.parquet(f"{path}/sample/part={own}").collect()) for p, (_, own) in kept.state.parts.items()}
    assert [len(held[p]) for p in "pqr"] == [50, 50, 20]
    assert held["p"] == sorted(r.h for r in items(spark, 1, 3000, 0).select(F.xxhash64("kind", "id").alias("h")).collect())[:50]
    # some three times the rows asked for pass a threshold, and of them alone a task sends its least
    plan = kept._least(kept.items(), 0.05)._jdf.queryExecution().optimizedPlan().toString()
    assert "<= -83010" in plan


def test_quantiles_within_given_brackets(spark):
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007).cast("double").alias("x"), F.lit(None).cast("double").alias("n"))
    value = {"x": F.col("x"), "n": F.col("n")}
    want = quantiles(df, value, 0.3)
    # right, off to either side, one point, and too many values between
    for low, high, between in ((2990.0, 3020.0, 40), (0.0, 5.0, 9), (9000.0, 9100.0, 99), (want["x"], want["x"], 1), (-1.0, 20_000.0, 10_000)):
        assert quantiles(df, value, 0.3, held=200, within={"x": (low, high, between), "n": (0.0, 1.0, 5)}) == want


def test_small_files_are_replaced_whole(spark, path):
    assert files.read_text(spark, f"{path}/one") is None and files.names(spark, path) == []
    for text in ("a", "é" * 5000, ""):
        files.write_text(spark, f"{path}/one", text)
        assert files.read_text(spark, f"{path}/one") == text
    before = files.version(spark, path)
    files.write_text(spark, f"{path}/two", "x")
    assert files.version(spark, path) != before and files.names(spark, path) == ["one", "two"]
    files.delete(spark, path)
    assert files.names(spark, path) == []
