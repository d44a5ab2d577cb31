"""The complaint dashboard from states that merge: sums, and exact bitmaps of the vehicles and customers.

Both states have rows per dealer, category and period, merge with those of other complaints and roll up from months to
longer periods without the complaints.  Distinct counts come from bitmaps over dense numbers, 32,768 numbers a bitmap,
so they need no Expand and a hot dealer is spread over its bitmaps.  A bitmap has 4 kB (far less where stored, as it is mostly
zeros): fit for dealers with many vehicles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.rules import dealer_risk_flag
from fleetlens.functions.scalars import month_of, pct
from fleetlens.operators.ids import assign_ids

GROUP = ["dealer_id", "complaint_category", "period"]
_SUMS = ["total_complaints", "n_rows", "days_sum", "days_count", "failed", "within_7", "within_30"]


def _grouped(correlation: DataFrame) -> DataFrame:
    return correlation.where(F.col("dealer_id").isNotNull()).withColumn("period", month_of(F.col("complaint_date")))


def sums(correlation: DataFrame) -> DataFrame:
    """Sums, minima and maxima of each dealer, category and month."""
    days = F.col("days_since_delivery")
    return _grouped(correlation).groupBy(*GROUP).agg(
        F.count("complaint_id").alias("total_complaints"), F.count(F.lit(1)).alias("n_rows"),
        F.sum(days).alias("days_sum"), F.count(days).alias("days_count"),
        F.min(days).alias("days_min"), F.max(days).alias("days_max"),
        F.count_if(F.col("inspection_status") == "FAIL").alias("failed"),
        F.count_if(days <= 7).alias("within_7"), F.count_if(days <= 30).alias("within_30"))


def merge_sums(*states: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, states).groupBy(*GROUP).agg(
        *[F.sum(c).alias(c) for c in _SUMS], F.min("days_min").alias("days_min"), F.max("days_max").alias("days_max"))


def numbered(rows: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """(column, number): the numbers in ``known``, and the next ones for values of ``rows`` that it doesn't have.

    Store the result before use: bitmaps merge only if they are made with the same numbers.
    """
    values = rows.select(column).where(F.col(column).isNotNull()).distinct()
    if known is None:
        known = values.where("false").withColumn("number", F.lit(0).cast("bigint"))
    new = assign_ids(values.join(known, column, "left_anti"), known, key=column, id_col="number", existing_id="number")
    return known.select(column, "number").unionByName(new.select(column, "number"))


def members(correlation: DataFrame, column: str, numbers: DataFrame) -> DataFrame:
    """Bitmaps of the values of ``column`` of each dealer, category and month."""
    # once for each group: a value that many complaints share is no hot key of the join
    held = _grouped(correlation).where(F.col(column).isNotNull()).select(*GROUP, column).distinct()
    return held.join(numbers, column).groupBy(
        *GROUP, F.lit(column).alias("member"), F.bitmap_bucket_number("number").alias("bucket"),
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def merge_members(*states: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, states).groupBy(*GROUP, "member", "bucket").agg(
        F.bitmap_or_agg("bits").alias("bits"))


def rolled_up(state: DataFrame, unit: str) -> DataFrame:
    """The rows of a state in longer periods ("quarter", "year"); merge it to have one row for each group."""
    return state.withColumn("period", F.trunc("period", unit).cast("timestamp_ntz"))


def dashboard(sums_state: DataFrame, members_state: DataFrame) -> DataFrame:
    """Counts, delays and risk flag of each dealer, category and period from merged states."""
    def counted(member: str):
        return F.when(F.col("member") == member, F.bitmap_count("bits")).otherwise(F.lit(0).cast("bigint"))

    counts = members_state.select(*GROUP, counted("vehicle_id").alias("vehicles"), counted("customer_id").alias("customers"))
    n, failed = F.sum("n_rows"), F.sum("failed")
    together = sums_state.unionByName(counts, allowMissingColumns=True).groupBy(*GROUP).agg(
        F.sum("total_complaints").alias("total_complaints"),
        F.coalesce(F.sum("vehicles"), F.lit(0)).alias("affected_vehicles"),
        F.coalesce(F.sum("customers"), F.lit(0)).alias("affected_customers"),
        F.round(F.sum("days_sum") / F.nullif(F.sum("days_count"), F.lit(0)), 1).alias("avg_days_since_delivery"),
        F.min("days_min").alias("min_days_since_delivery"), F.max("days_max").alias("max_days_since_delivery"),
        failed.alias("complaints_with_failed_inspection"), pct(failed, n).alias("pct_with_failed_inspection"),
        F.sum("within_7").alias("complaints_within_7days"), F.sum("within_30").alias("complaints_within_30days"))
    return together.withColumn("dealer_risk_flag", dealer_risk_flag(
        F.col("affected_vehicles"), F.col("pct_with_failed_inspection")))
