"""Places in a whole list, and rescans of folders as one run."""

import os
import random

from pyspark.sql import functions as F

from nearfield.operators import places
from nearfield.sources import ingest


def test_places_of_every_row(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1.0, 1.0, rng.random()]), rng.choice("abc")) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x double, _part string").repartition(5)
    got = {r.id: r.place for r in places.in_order(df, [F.desc_nulls_last("x"), F.col("id")]).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: n + 1 for n, r in enumerate(want)}
    # equal rows get different places next to each other
    alike = places.in_order(spark.range(500).withColumn("x", F.lit(1)), [F.col("x")], "n")
    assert sorted(r.n for r in alike.collect()) == list(range(1, 501)) and alike.columns == ["id", "x", "n"]
    assert places.in_order(df.where("false"), [F.col("id")]).count() == 0


def test_places_have_no_single_task(spark):
    plan = spark.range(10).repartitionByRange(4, F.desc("id"))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "SinglePartition" not in plan


def test_a_rescan_reads_only_what_changed(spark, tmp_path, monkeypatch):
    def put(path, text, time=None):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
        if time:
            os.utime(tmp_path / path, (time, time))

    for n in range(6):
        put(f"a/{n}.wav", f"text {n}", 1000)
    put("a/twin1.wav", "same", 1000)
    put("a/twin2.wav", "same", 1000)
    nothing = spark.createDataFrame([], "id long, path string, size long, mtime timestamp, hash string")
    changes, known = ingest.rescanned(spark, str(tmp_path), nothing)
    assert sorted((os.path.relpath(r.path, tmp_path), r.id, r.change) for r in changes.collect()) == [*[(f"a/{n}.wav", n + 1, "added") for n in range(6)], ("a/twin1.wav", 7, "added"), ("a/twin2.wav", 8, "added")]

    read = []
    whole = ingest.hashed
    monkeypatch.setattr(ingest, "hashed", lambda files: read.extend(r.path for r in files.select("path").collect()) or whole(files))
    put("a/1.wav", "text X", 2000)  # same size, other text
    os.utime(tmp_path / "a/2.wav", (3000, 3000))  # touched
    (tmp_path / "a/3.wav").unlink()
    (tmp_path / "b").mkdir()
    (tmp_path / "a/4.wav").rename(tmp_path / "b/new name.wav")
    (tmp_path / "a/twin1.wav").rename(tmp_path / "b/twin1.wav")
    (tmp_path / "a/twin2.wav").rename(tmp_path / "b/twin2.wav")
    put("b/0.wav", "brand new", 1000)
    changes, now = ingest.rescanned(spark, f"file://{tmp_path}", known)
    got = sorted((os.path.relpath(r.path, tmp_path), r.id, r.change, r.old_path and os.path.relpath(r.old_path, tmp_path)) for r in changes.collect())
    assert got == [
        ("a/0.wav", 1, "unchanged", None), ("a/1.wav", 2, "changed", None), ("a/2.wav", 3, "identical", None), ("a/3.wav", 4, "removed", None), ("a/5.wav", 6, "unchanged", None),
        ("b/0.wav", 9, "added", None), ("b/new name.wav", 5, "moved", "a/4.wav"), ("b/twin1.wav", 7, "moved", "a/twin1.wav"), ("b/twin2.wav", 8, "moved", "a/twin2.wav"),
    ]
    assert {os.path.relpath(p, tmp_path) for p in read} == {"a/1.wav", "a/2.wav", "b/0.wav", "b/new name.wav", "b/twin1.wav", "b/twin2.wav"}
    assert sorted(r.id for r in now.collect()) == [1, 2, 3, 5, 6, 7, 8, 9]
    import hashlib

    hashes = {r.id: r.hash for r in now.collect()}
    assert hashes[2] == hashlib.blake2b(b"text X").hexdigest() and hashes[9] == hashlib.blake2b(b"brand new").hexdigest()
    # nothing changed since: nothing is read
    read.clear()
    changes, _ = ingest.rescanned(spark, str(tmp_path), now)
    assert read == [] and {r.change for r in changes.collect()} == {"unchanged"}
