"""Every registered query equals its DuckDB statement on the smallest data set."""

import pytest

import __spark_entry__ as contract
from fleetlens.plans.oracle import ORACLE
from fleetlens.plans.registry import QUERIES
from tests.compare import connect, differences, in_order


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, duck, name):
    assert differences(QUERIES[name](spark, sf_dir), duck, ORACLE[name]) == []


def test_all_are_registered():
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLE.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name, order", [
    ("gap_analysis", "complaint_count DESC, gap_category"),
    ("query_table", "complaint_count DESC, gap_category"),
    ("checklist_recommendations", "priority, total_complaints DESC, what_customers_complain_about"),
    ("top_recommendations", "priority DESC"),
    ("distinct_dealers", "dealer_id"),
    ("distinct_dealer_names", "dealer_code NULLS FIRST, dealer_name NULLS FIRST"),
    ("distinct_categories", "category NULLS FIRST, subcategory NULLS FIRST"),
    ("recent_topn", "created_at DESC, complaint_id DESC"),
    ("recent_inspections", "created_at DESC, inspection_id DESC"),
])
def test_order_of_rows(spark, sf_dir, duck, name, order):
    df = QUERIES[name](spark, sf_dir)
    want = in_order(duck, f"SELECT * FROM ({ORACLE[name]}) ORDER BY {order}", df.columns)
    assert [tuple(r) for r in df.collect()] == want and want


def test_entry(spark):
    df = contract.entry(spark)
    assert "complaint_id" in df.columns and df.count() > 0


@pytest.mark.parametrize("zone", ["Asia/Kolkata", "America/Los_Angeles"])
@pytest.mark.parametrize("name", ["complaint_dashboard", "complaint_trends", "spike_alert",
                                  "stream_spike_alert"])
def test_session_zone_does_not_matter(spark, sf_dir, duck, name, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert differences(QUERIES[name](spark, sf_dir), duck, ORACLE[name]) == []
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
