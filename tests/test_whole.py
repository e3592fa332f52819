"""Whole tables: rows beyond any fixed range of ids are answered too."""

import pytest

from nearfield.plans import catalogue


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """A folder with three lines of order 1 and one of an order far beyond."""
    folder = str(tmp_path_factory.mktemp("whole"))
    rows = [(1, 1, 1, 5, 10.0, "A"), (1, 2, 1, 5, 20.0, "N"), (1, 3, 2, 700, 0.0, "R"), (9_000_000, 1, 2, 5, 30.0, "R")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, "a"), (2, "b")], "p_partkey long, p_name string").write.parquet(f"{folder}/part.parquet")
    return folder


def test_every_segment_has_a_label(spark, lines):
    got = {tuple(r) for r in catalogue.QUERIES["item_labels_whole"](spark, lines).where("kind = 'segment'").select("id", "label").collect()}
    assert got == {(101, "hit @ 0.500 s (100 ms) in a"), (102, "hit @ 0.500 s (200 ms) in a"), (103, "hit @ 1:10.000 (0 ms) in b"), (900_000_001, "hit @ 0.500 s (300 ms) in b")}


def test_every_segment_is_replaced(spark, lines):
    got = catalogue.QUERIES["segments_replaced_rows"](spark, lines).select("sample_id", "start_ms", "end_ms", "detection_method", "id").collect()
    assert sorted(map(tuple, got)) == [(1, 100, 110, "manual", -1_010_010), (1, 150, 160, "auto", 1), (1, 250, 270, "auto", 2), (9_000_000, 150, 180, "auto", 3)]


@pytest.fixture(scope="module")
def suppliers(spark, tmp_path_factory):
    """A folder with suppliers of keys 15 to 34 and 70."""
    folder = str(tmp_path_factory.mktemp("suppliers"))
    spark.createDataFrame([(k,) for k in [*range(15, 35), 70]], "s_suppkey long").write.parquet(f"{folder}/supplier.parquet")
    return folder


def test_every_supplier_has_a_tone(spark, suppliers):
    want = {f"/tones/{k}.wav" for k in [*range(15, 35), 70]}
    rows = catalogue.QUERIES["described_tones"](spark, suppliers).select("path", "error").collect()
    assert len(rows) == len(want) and {r.path for r in rows if r.error is None} == want
    cuts = catalogue.QUERIES["rendered_cuts"](spark, suppliers).collect()
    assert sorted(r.id for r in cuts) == [*range(15, 35), 70] and all(r.bytes > 0 and r.error is None for r in cuts)


def test_only_changed_files_are_described(spark, suppliers):
    rows = catalogue.QUERIES["described_changes"](spark, suppliers).select("path", "change").collect()
    assert sorted(map(tuple, rows)) == [("/tones/21.wav", "added"), ("/tones/24.wav", "changed"), ("/tones/31.wav", "added"), ("/tones/34.wav", "changed")]


def test_every_layout_stays(spark, suppliers):
    rows = catalogue.QUERIES["current_layout_whole"](spark, suppliers).collect()
    assert sorted(map(tuple, rows)) == [*((k, False) for k in [*range(15, 35), 70]), (71, True)]


def test_every_events_point_is_asked_for(spark, tmp_path):
    rows = spark.sql("select id as event_id, 7L as user_id, timestamp_seconds(id * 86400) as ts, 'x' as event_type, 2.5D as value from range(6)")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.QUERIES["segment_at_every_event"](spark, str(tmp_path)).select("t").collect()
    assert sorted(r.t for r in got) == [i * 86400 + 1800 for i in range(6)]
