"""Dashboard states: merging and rolling up equals counting all complaints at once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import dashboard, dashboard_state as ds

SCHEMA = ("complaint_id long, dealer_id string, complaint_category string, complaint_date date, vehicle_id string, "
          "customer_id string, days_since_delivery int, inspection_status string")
DAYS = [None, *(dt.date(2024, m, d) for m in range(1, 8) for d in (1, 20))]


@pytest.fixture(scope="module")
def correlation(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["D1", "D1", "D2", None]), rng.choice(["Paint", None]), rng.choice(DAYS),
             rng.choice([None, *(f"V{v}" for v in range(9))]), rng.choice([None, "x", "y"]), rng.choice([None, 3, 20, 90]),
             rng.choice([None, "FAIL", "PASS"])) for k in range(300)]
    return spark.createDataFrame(rows, SCHEMA)


def numbers_of(spark, correlation, folder):
    out = {}
    for column in ("vehicle_id", "customer_id"):
        first = ds.numbered(correlation.where("complaint_id < 20"), column)
        first.write.parquet(f"{folder}/{column}1")
        known = spark.read.parquet(f"{folder}/{column}1")
        ds.numbered(correlation, column, known).write.parquet(f"{folder}/{column}2")
        out[column] = spark.read.parquet(f"{folder}/{column}2")
        assert known.exceptAll(out[column]).count() == 0  # numbers stay
        assert out[column].agg(F.count_distinct("number"), F.max("number"), F.count("*")).distinct().first()[0] == (
            correlation.select(F.count_distinct(column)).first()[0]) == out[column].count()
    return out


def merged(correlation, numbers, unit, parts=3):
    split = [correlation.where(F.pmod("complaint_id", F.lit(parts)) == k) for k in range(parts)]
    sums = ds.merge_sums(*[ds.rolled_up(ds.sums(p), unit) for p in split])
    held = ds.merge_members(*[ds.rolled_up(ds.members(p, c, n), unit) for p in split for c, n in numbers.items()])
    return ds.dashboard(sums, held)


def found(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_states_equal_the_dashboard_and_roll_up(spark, correlation, tmp_path):
    numbers = numbers_of(spark, correlation, tmp_path)
    months = merged(correlation, numbers, "month")
    whole = dashboard.complaint_dashboard(correlation).withColumnRenamed("complaint_month", "period")
    assert found(months) == found(whole)
    quarter = F.trunc("complaint_date", "quarter")  # a quarter's complaints dated to its first day are one month's
    whole = dashboard.complaint_dashboard(correlation.withColumn("complaint_date", quarter))
    assert found(merged(correlation, numbers, "quarter")) == found(whole.withColumnRenamed("complaint_month", "period"))
    assert "Expand" not in months._jdf.queryExecution().executedPlan().toString()
    assert found(merged(correlation.where("false"), numbers, "month")) == []


def test_members_over_several_bitmaps(spark):
    rows = spark.range(100_000).select(
        F.col("id").alias("complaint_id"), F.lit("D").alias("dealer_id"), F.lit("c").alias("complaint_category"),
        F.lit(dt.date(2024, 1, 1)).alias("complaint_date"), F.concat(F.lit("V"), F.col("id") % 70_000).alias("vehicle_id"))
    numbers = rows.select("vehicle_id").distinct().withColumn("number", F.substring("vehicle_id", 2, 9).cast("bigint"))
    state = ds.members(rows, "vehicle_id", numbers)
    assert state.count() == 4  # number 0 has a bitmap of its own
    again = ds.merge_members(state, ds.members(rows.where("complaint_id < 9"), "vehicle_id", numbers))
    assert again.agg(F.sum(F.bitmap_count("bits"))).first()[0] == 70_000
