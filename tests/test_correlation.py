"""Correlation: ties, misses, guard, hot keys, and the two ways to the detail table."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import correlation as corr
from fleetlens.operators.skew import MOST_HEAVY, heavy_keys, left_join_unique
from fleetlens.sources import star_schema as src

DAY = dt.date(2024, 3, 1)
C = ("complaint_id long, vehicle_id string, customer_id string, complaint_date date, "
     "complaint_category string, description string")
I = ("inspection_id long, vehicle_id string, dealer_id string, inspection_date date, "
     "checklist_item string, status string, notes string")
D = ("delivery_id long, vehicle_id string, dealer_id string, delivery_date date, "
     "delivery_condition string, customer_signature string")


def frames(spark, c, i, d):
    return (spark.createDataFrame(c, C), spark.createDataFrame(i, I), spark.createDataFrame(d, D))


def complaint(n, vehicle, day):
    return (n, vehicle, "CU", DAY + dt.timedelta(day), "Service", None)


def test_guard_ties_and_misses(spark):
    c, i, d = frames(
        spark,
        [complaint(1, "A", 0), complaint(2, "A", 1), complaint(3, "A", -1),
         complaint(4, "none", 0), complaint(5, None, 0), complaint(6, "nodate", 0)],
        [(1, "A", "X", DAY, "Brakes", "FAIL", None), (2, "A", "X", DAY, "Brakes", "fail", None),
         (3, "A", "X", DAY, None, "Fail", None), (4, "A", "X", DAY, "Seats", "Pass", None)],
        [(7, "A", "old", DAY - dt.timedelta(9), "Good", ""), (8, "A", "low", DAY, "Fair", ""),
         (9, "A", "high", DAY, "Poor", ""), (10, "A", "unknown", None, "Good", ""),
         (11, "nodate", "Z", None, "Good", "")])
    rows = {r.complaint_id: r for r in corr.correlate(c, i, d).collect()}
    assert sorted(rows) == [2, 4, 5, 6]
    assert (rows[2].dealer_id, rows[2].days_since_delivery) == ("high", 1)
    assert (rows[2].inspection_status, rows[2].fail_count) == ("FAIL", 3)
    assert rows[2].failed_items == ["Brakes"]
    assert rows[4].inspection_status is None and rows[4].failed_items is None
    assert (rows[6].dealer_id, rows[6].days_since_delivery) == ("Z", None)


def test_no_fail_gives_an_empty_set(spark):
    _, i, _ = frames(spark, [], [(1, "A", "X", DAY, "Seats", "Pass", None)], [])
    assert tuple(corr.inspection_summary(i).first())[1:4] == ("PASS", 0, [])


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all complaints on one vehicle, a third without vehicle, one hot unknown."""
    c = [complaint(n, "HOT" if n % 3 == 0 else None if n % 3 == 1 else
                   "LOST" if n % 2 else f"V{n % 7}", n % 5 - 1) for n in range(600)]
    i = [(n, v, "X", DAY, f"item {n % 3}", "Fail" if n % 2 else "Pass", None)
         for n, v in enumerate(["HOT"] * 50 + [f"V{k}" for k in range(7)] + [None])]
    d = [(n, v, f"D{n}", DAY - dt.timedelta(n % 2), "Good", "")
         for n, v in enumerate(["HOT"] * 30 + [f"V{k}" for k in range(5)])]
    return frames(spark, c, i, d)


def same(a, b):
    return a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def plain_link(c, i, d):
    rows = c.join(corr.inspection_summary(i), "vehicle_id", "left").join(
        corr.latest_delivery(d), "vehicle_id", "left")
    return rows.withColumn("days_since_delivery", F.date_diff("complaint_date", "delivery_date"))


@pytest.mark.parametrize("heavy_rows", [1, 20, 500_000])
def test_split_join_equals_plain_join(skewed, heavy_rows):
    split = corr.link(*skewed, heavy_rows=heavy_rows)
    assert same(plain_link(*skewed).select(split.columns), split)
    assert split.count() == 600


def test_heavy_keys_are_bounded_by_their_share(spark, skewed):
    heavy = heavy_keys(skewed[0], "vehicle_id", 20).collect()
    assert sorted(r.vehicle_id for r in heavy) == ["HOT", "LOST"]
    many = spark.range(MOST_HEAVY * 2 + 2).select((F.col("id") / 2).cast("long").alias("k"))
    assert heavy_keys(many, "k", 1).count() <= MOST_HEAVY


@pytest.mark.parametrize("key_type", ["bigint", "string", "date"])
def test_split_join_with_keys_of_any_type(spark, key_type):
    """A hot key, keys without a match and rows without a key."""
    left = spark.range(2000).select(
        F.when(F.col("id") % 2 == 0, F.lit(None)).when(F.col("id") % 3 == 0, 5)
        .otherwise(F.col("id") % 40).alias("n"), "id")
    right = spark.range(20).select(F.col("id").alias("n"), (F.col("id") * 10).alias("v"))
    if key_type == "date":
        left, right = (x.withColumn("n", F.date_add(F.lit("2024-01-01"), F.col("n").cast("int")))
                       for x in (left, right))
    left, right = (x.select(F.col("n").cast(key_type).alias("k"), *x.columns[1:])
                   for x in (left, right))
    assert same(left.join(right, "k", "left"), left_join_unique(left, [right], "k", heavy_rows=100))


def test_rows_of_heavy_keys_are_not_shuffled(skewed):
    plan = corr.link(*skewed, heavy_rows=20)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastHashJoin" in plan and "Union" in plan


def test_only_heavy_keys_are_summed_up_a_second_time(skewed):
    plan = corr.link(*skewed, heavy_rows=20)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    semi = [n for n, line in enumerate(plan) if "Join LeftSemi" in line]
    assert len(semi) == 2  # inspections and deliveries
    assert not any(re.match(r"[ :+-]*(Aggregate|Window)", plan[n + 1]) for n in semi)


def test_detail_both_ways(spark, sf_dir):
    cid = [f(spark, sf_dir) for f in (src.complaints, src.inspections, src.deliveries)]
    stored = corr.complaint_detail(cid[0], corr.correlate(*cid))
    fused = corr.complaint_detail_from_bronze(*cid)
    links = corr.detail_from_links(corr.link(*cid))
    assert links.columns == fused.columns and links.exceptAll(fused).count() == 0
    assert stored.columns == fused.columns
    assert stored.exceptAll(fused).count() == 0 and fused.exceptAll(stored).count() == 0
    assert fused.count() == cid[0].count()


def test_one_row_per_complaint(spark, sf_dir):
    s = corr.correlate(src.complaints(spark, sf_dir), src.inspections(spark, sf_dir),
                       src.deliveries(spark, sf_dir))
    assert s.groupBy("complaint_id").count().where("count > 1").count() == 0
    assert s.where(F.col("days_since_delivery") < 1).count() == 0
