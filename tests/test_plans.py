"""Plans: filters reach the scan, columns are pruned, joins are by equality, rankings don't shuffle before their fold."""

import re

import pytest
from pyspark.sql import functions as F

from nearfield.operators import intervals
from nearfield.plans import catalogue

DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalogue.QUERIES[name](spark, DIR)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize(("name", "pushed"), [("column_filter_range", "GreaterThanOrEqual(c_acctbal,0"), ("criteria_rows", "GreaterThanOrEqual(p_retailprice"), ("catalogue_row", "In(o_orderkey"), ("drill_down", "EqualTo(l_orderkey")])
def test_filters_reach_the_scan(spark, name, pushed):
    assert any(pushed in x for x in re.findall(r"PushedFilters: .*", plan(spark, name)))


@pytest.mark.parametrize(("name", "columns"), [("column_filter_text", "p_partkey:bigint,p_name:string"), ("visible_ids", "l_orderkey:bigint,l_quantity:double"), ("latest_caption", "conv_id:bigint,turn:bigint,text:string")])
def test_columns_are_pruned(spark, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(spark, name)


@pytest.mark.parametrize("name", ["outermost_prefixes", "folder_counts", "segment_at", "orphan_children", "filtered_children", "rank_scoped", "detrend_local_peaks"])
def test_no_nested_loops(spark, name):
    assert not re.search("NestedLoop|Cartesian", plan(spark, name))


@pytest.mark.parametrize("name", ["orphan_children", "childless_parents"])
def test_anti_joins(spark, name):
    assert "LeftAnti" in plan(spark, name)


def test_top_lists_are_heaps(spark):
    assert "TakeOrderedAndProject" in plan(spark, "sorted_list") and "TakeOrderedAndProject" in plan(spark, "worklist_limited")


@pytest.mark.parametrize("name", ["segment_at", "segment_at_every_event", "segment_at_wide", "rendered_cuts"])
def test_what_outgrows_its_estimate_is_not_broadcast(spark, name):
    """A span's nodes and a file's contents are many times as large as plans take them for."""
    found = plan(spark, name)
    assert "SortMergeJoin" in found and "BroadcastHashJoin" not in found


def test_no_python_in_relational_queries(spark):
    for name in ("rank_fold", "catalogue_list", "topk_tags", "segments_boundaries", "vector_search", "scan_diff", "evict_lru"):
        assert not re.search("Python|Arrow|Pandas", plan(spark, name)), name


def test_merging_and_containment_stay_in_the_jvm(spark):
    """Neither joins by inequality nor gathers a key's events; what merging stores between its rounds comes from such plans."""
    events = spark.createDataFrame([(1, 2.0, 3.0)], "k long, t double, s double")
    spans = spark.createDataFrame([(1, 1, 2, 3)], "k long, id long, start long, end long")
    for df in (intervals.following(events, "k", "t", 1.0), intervals._stretches(events, "k", "t", 1.0), intervals.at_point(spans.select("k", F.col("start").alias("t")), spans, "k", "t"), intervals.span_moments(events.withColumn("f", F.lit(0)), spans, "k", "f", ["s"], hop=1)):
        found = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("(?i)collect_list|Python|Arrow|Pandas|NestedLoop|Cartesian", found)


@pytest.mark.parametrize("name", ["read_files", "encoded_texts"])
def test_rows_of_one_small_file_are_dealt_over_tasks(spark, name):
    assert catalogue.QUERIES[name](spark, DIR).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
