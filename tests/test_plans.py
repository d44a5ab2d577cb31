"""Plan shapes that matter at scale."""

import re

import pytest

from fleetlens.operators.correlation import inspection_summary, latest_delivery, link
from fleetlens.operators.rollups import vehicle_risk_profile
from fleetlens.plans import medallion
from fleetlens.plans.registry import QUERIES
from fleetlens.sources import star_schema as src


def plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


BATCH = [n for n in QUERIES if not n.startswith("stream_")]


@pytest.mark.parametrize("name", BATCH)
def test_no_nested_loops_and_no_python(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text


@pytest.mark.parametrize("name", ["inspection_score", "default_actions", "worst_status",
                                  "classify_issue", "bronze_complaints", "checklist_unpivot"])
def test_row_local_queries_do_not_shuffle(spark, sf_dir, name):
    assert "Exchange" not in plan(spark, sf_dir, name)


def test_scan_reads_only_used_columns(spark, sf_dir):
    text = plan(spark, sf_dir, "inspection_summary")
    columns = re.search(r"FileScan parquet \[([^\]]*)\]", text).group(1)
    assert sorted(re.sub(r"#\d+L?", "", columns).split(",")) == [
        "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate"]


@pytest.mark.parametrize("name", ["latest_delivery", "recurrence_pairs"])
def test_group_limit_before_the_shuffle(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "Partial" in text and "WindowGroupLimit" in text


def test_inspection_summary_combines_before_both_shuffles(spark, sf_dir):
    text = plan(spark, sf_dir, "inspection_summary")
    assert text.count("Exchange hashpartitioning") == 2
    # the raw rows meet a hash aggregate, not one that sorts
    assert "SortAggregate" not in text and "HashAggregate" in text


def test_recent_rows_need_no_full_sort(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(spark, sf_dir, "recent_topn")


@pytest.mark.parametrize("name", ["metrics_summary", "silver_checks", "epdi_gaps", "gap_analysis"])
def test_gap_counts_build_no_vehicle_sets(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    for bad in ("collect_list(vehicle_id", "WindowGroupLimit [complaint_category"):
        assert bad not in text


@pytest.mark.parametrize("name, joins, exchanges", [
    # complaints, two for the inspection summary, one for deliveries; the rows of heavy
    # keys meet broadcasts instead, whose own exchanges are reused or small
    ("complaint_correlation", 2, 4), ("vehicle_risk_profile", 2, 4)])
def test_vehicle_joins_reuse_the_aggregation_partitioning(spark, sf_dir, name, joins, exchanges):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, sf_dir, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    main = text.split("Union", 1)[-1].split("BroadcastExchange")[0] if "Union" in text else text
    assert text.count("SortMergeJoin") >= joins
    assert main.count("Exchange hashpartitioning") <= exchanges


def test_silver_links_stored_bronze_without_an_exchange(spark, sf_dir):
    """Joins and groups by vehicle use the buckets; only the counts of heavy keys are broadcast."""
    prefix = "plan_"
    medallion.run_bronze({"complaints": src.staging_complaints(spark, sf_dir),
                          "inspections": src.staging_inspections(spark, sf_dir),
                          "deliveries": src.staging_deliveries(spark, sf_dir)}, prefix)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c, i, d = medallion.bronze_tables(spark, prefix)
        for df in (link(c, i, d), inspection_summary(i), latest_delivery(d), vehicle_risk_profile(c, i, d)):
            text = df._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(vehicle_id" not in text
            assert "Bucketed: true" in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        medallion.drop_tables(spark, prefix)
