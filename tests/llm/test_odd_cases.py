"""Cases that operators define: columns of any type, unknown actions and grades, rows without ids, stages on odd and empty tables."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearfield.llm import jaccard, mixing, quality, urlfilter


def test_captures_keep_columns_of_any_type(spark):
    at = dt.datetime(2024, 5, 1, 12)
    rows = [("http://a.example/x", at, {"k": 1}, [1, None]), (None, at, {}, None), ("http://b.example/", None, None, []), (None, None, {"z": 2}, [3]), (None, None, {"z": 2}, [3])]
    captures = spark.createDataFrame(rows, "url string, day timestamp, tags map<string,int>, list array<int>").selectExpr("*", "parse_json('{\"a\":1}') AS v")
    entries = spark.createDataFrame([("bad", "domain", "a.example", "add", dt.datetime(2024, 1, 1))], "list string, kind string, pattern string, action string, day timestamp")
    got = urlfilter.judged(captures, entries)
    assert got.columns == ["url", "day", "tags", "list", "v", "blocked", "lists"]
    want = [(u, t, x, u is not None and d is not None, "bad" if u and d else "") for u, d, t, x in rows]
    assert sorted(((r.url, r.tags, r["list"], r.blocked, r.lists) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_unknown_actions_change_nothing(spark):
    days = [("add", 1), ("note", 2), (None, 3), ("ADD", 4), ("remove", 8)]
    entries = spark.createDataFrame([("bad", "domain", "a.example", a, dt.datetime(2024, 1, d)) for a, d in days], "list string, kind string, pattern string, action string, day timestamp")
    assert [(r.since.day, r.until.day) for r in urlfilter.validity(entries).collect()] == [(1, 8)]
    captures = spark.createDataFrame([("http://a.example", dt.datetime(2024, 1, d)) for d in range(1, 10)], "url string, day timestamp")
    assert sorted((r.day.day, r.blocked) for r in urlfilter.judged(captures, entries).collect()) == [(d, d < 8) for d in range(1, 10)]


def rated(seed, n):
    rng = random.Random(seed)
    marks = {0: ["junk", "spam"], 1: ["rude"], 2: []}
    rows = []
    for i in range(n):
        g = rng.choice([0, 1, 2, 2])
        words = [f"w{rng.randrange(200)}" for _ in range(30)] + [rng.choice(marks[g])] * 2 if marks[g] else [f"w{rng.randrange(200)}" for _ in range(30)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), g))
    return rows


def test_unknown_grades_are_left_out(spark):
    rows = rated(1, 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    sound = [(i, g) for i, _, g in rows]
    odd = [(i, x) for i, x in zip(range(300, 306), [-1, 3, 99, None, -5, 2**30], strict=True)] + [(None, 1)]
    docs = docs.unionByName(spark.createDataFrame([(i, "junk w1") for i, _ in odd[:6]], docs.schema))
    ratings = "doc_id long, grade int"
    one, two = (quality.fit_rated(docs, spark.createDataFrame(r, ratings), n_grades=3) for r in (sound, sound + odd))
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.thresholds, two.thresholds)
    assert one.weights.any()
    for bad in (-1, 3):
        with pytest.raises(ValueError):
            quality.fit([np.array([1]), np.array([2])], np.array([0, bad]), 3)


def test_what_spark_counts_fits_as_the_rows_do(spark):
    """Features are chosen by counts made in Spark; the driver gets those alone."""
    rows = rated(2, 400) + [(1000, "word " * 50_000 + "junk", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = quality.fit_rated(docs, spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int"), n_grades=3)
    plain = quality.fit(list(quality.features(pa.array([t for _, t, _ in rows]))), np.array([g for *_, g in rows]), 3)
    assert np.allclose(model.weights, plain.weights, atol=1e-9) and np.allclose(model.thresholds, plain.thresholds)
    assert (model.weights != 0).sum() < 200
    # ids that repeat: max_train rows at most
    twice = quality.fit_rated(docs.unionByName(docs), spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int"), n_grades=3, max_train=300)
    assert len(twice.thresholds) == 2


def test_rows_without_ids_are_taken_by_their_texts(spark):
    texts = [" ".join(["w"] * n) + f" t{n}" for n in range(1, 40)] * 2
    df = spark.createDataFrame([(None, t, "en", "a") for t in texts], "doc_id long, text string, lang string, source string")
    got = mixing.mixed(df, {"lang": F.col("lang")}, {}, percent=50, copies="copies", tokens="n")
    taken, total = got.agg(F.sum("n")).first()[0], sum(len(t.split()) for t in texts)
    # the prefix ends with the texts that reach the budget, twice each
    assert total * 0.5 <= taken <= total * 0.5 + 2 * 40
    assert all(r["count"] == 2 for r in got.groupBy("text").count().collect())


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_docs(spark):
    rows = [(i, t, "en", "s1", len(t)) for i, t, _ in rated(3, 400)] + [(None, "no id here", "en", "s1", 1), (470, None, None, None, None), (471, "", "", "", 0), (472, " \n\t", "de", "s2", 3), (472, "again", "de", "s2", 3), (473, "long word " * 30_000, "fr", "s3", None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES[:-1]], ids=lambda s: s[0])
def test_stages_on_odd_rows_with_clashing_columns(spark, odd_docs, stage, tmp_path):
    spark.createDataFrame([(i, g // 2 if g != 1 else 1, int(g == 1)) for i, _, g in rated(3, 400)] + [(None, 1, 0), (470, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    clashing = odd_docs.selectExpr("*", "'x' AS c0", "1 AS grade", "2 AS _tail", "'y' AS _domain", "3 AS component_id", "'k' AS key")
    got = stage[1](spark, clashing, str(tmp_path))
    assert set(odd_docs.columns) <= set(got.columns) and 0 < got.count() <= odd_docs.count()
    assert got.select("doc_id").join(odd_docs, "doc_id", "left_anti").where("doc_id is not null").count() == 0
    empty = stage[1](spark, odd_docs.where("false"), str(tmp_path))
    assert empty.columns == odd_docs.columns and empty.count() == 0


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_list_with_one_straggler_is_copied_about_once(spark):
    """Twenty thousand postings of one component and one of another: rows grow with the list, not with its square."""
    n = 20_000
    rows = spark.range(n + 1).select(F.lit(1).cast("long").alias("token"), F.col("id").alias("class"), F.lit(50).alias("n"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("odd1"), F.lit(0).cast("long").alias("odd2"), F.when(F.col("id") == n, n).otherwise(0).alias("comp"))
    # a list of one component alone is closed
    rows = rows.unionByName(rows.where("comp = 0 and class < 100").withColumn("token", F.lit(2).cast("long")))
    dealt = jaccard._dealt(rows.join(jaccard._open_lists(rows), "token"))
    assert dealt.count() < 1.01 * n and dealt.where("token = 2").count() == 0
    # every pair across components meets in one group
    met = dealt.alias("a").join(dealt.alias("b"), ["token", "i", "j"]).where("a.comp < b.comp and (a.own <> b.own or i = j)")
    assert met.count() == n


@pytest.mark.parametrize("block", [2, 7, 15, 40])
def test_blocks_of_lists_meet_each_pair_once(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(1)
    lists = [(t, c, rng.choice([0, 0, 0, 1, 2, c])) for t in range(4) for c in range(40)]
    rows = spark.createDataFrame([(t, c, 9, 0, 0, 0, m) for t, c, m in lists], "token long, class long, n int, pos int, odd1 long, odd2 long, comp long")
    dealt = jaccard._dealt(rows.join(jaccard._open_lists(rows), "token"))
    met = dealt.alias("a").join(dealt.alias("b"), ["token", "i", "j"]).where("a.class < b.class and a.comp <> b.comp and (i = j or a.own <> b.own)")
    got = sorted((r[0], r[1], r[2]) for r in met.select("token", F.col("a.class").alias("x"), F.col("b.class").alias("y")).collect())
    assert got == sorted((t, a, b) for t, a, x in lists for u, b, y in lists if t == u and a < b and x != y)
