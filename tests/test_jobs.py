"""Runs, serving, encoders' protocol and the command line."""

import time

import pytest
from pyspark.sql import functions as F

from nearfield import cli, schema
from nearfield.operators import intervals, state
from nearfield.plans import jobs
from nearfield.streaming import serving


def test_one_bad_row_ends_no_run(spark):
    work = spark.range(1, 8).withColumnRenamed("id", "k")
    do = lambda w: w.select("k", (F.col("k") * 2).alias("v"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("bad "), F.col("k").cast("string"))).alias("error"))
    stored = spark.createDataFrame([(1, 0), (3, 0), (99, 0)], "k long, v long")
    out, report = jobs.run_stage(work, do, stored, "k")
    assert {r.k: r.v for r in out.collect()} == {1: 2, 2: 4, 3: 0, 4: 8, 5: 10, 7: 14, 99: 0}
    assert report.counts == {"done": 5, "failed": 2} and report.errors == ["bad 3", "bad 6"]
    assert jobs.run_stage(work, do, stored, "k", ids=[])[1].text() == "nothing to do"
    assert jobs.run_stage(work, do, stored, "k", limit=2)[1].counts == {"done": 2}


def test_plans_stop_at_a_failure():
    ran = []
    step = lambda n: lambda: ran.append(n) or jobs.Report({"done": 1})

    def fails():
        raise RuntimeError("no model")

    report = jobs.run_plan([("a", step("a")), ("b", fails), ("c", step("c"))])
    assert ran == ["a"] and report.counts == {"done": 1} and "no model" in report.text()
    with pytest.raises(ValueError):
        jobs.run_plan([], scope=[])


def test_versions(spark):
    kept = serving.Versioned()
    a = kept.get("x", lambda: spark.range(3))
    assert kept.get("x", lambda: spark.range(9)) is a
    assert kept.get("y", lambda: kept.changed() or spark.range(1)) is None
    assert kept.get("x", lambda: spark.range(9)).count() == 9


def test_the_newest_query_wins(spark):
    newest = serving.NewestWins(spark)
    slow = newest.submit(lambda: spark.range(10**12).selectExpr("sum(id * 3 % 7)").collect())
    time.sleep(1)
    assert newest.submit(lambda: spark.range(5).count()).result(60) == 5
    assert slow.result(60) is None


def test_pools_and_one_writer(spark):
    with serving.pool(spark, "interactive"):
        assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") == "interactive"
    writer = serving.OneWriter()
    assert writer.run([lambda: 1, lambda: writer.stop() or 2, lambda: 3]) == [1, 2]


def test_targets_and_differences(spark):
    assert state.targets(1, [1, 2], True) == [1, 2] and state.targets(1, [1, 2], False) == [1] and state.targets(None, [], True) == []
    df = spark.createDataFrame([(1, "x", 2)], "id long, name string, more int")
    assert schema.differences(df, schema.TAGS) == {"missing": [], "extra": ["more"], "changed": []}
    assert schema.conformed(df, schema.LIBRARIES).schema.names == schema.LIBRARIES.names


def test_backtracking(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 0.5, 0.7, 0.9, 2.0, 3.0])], "k int, f int, v double")
    assert [r.onset for r in intervals.backtracked(df, "k", "f", "v").orderBy("f").collect()] == [0, 1, 1, 1, 4, 5]


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "rank_fold" in capsys.readouterr().out
    assert cli.main(["run", "one_root", "/root/testdata/sf0.001", "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 5
