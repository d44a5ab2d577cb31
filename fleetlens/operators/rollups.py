"""Counts, checks and summary cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import rule_values as V
from fleetlens.functions.rules import first_match
from fleetlens.functions.scalars import is_fail, month_of, pct
from fleetlens.functions.scoring import risk_score_sql
from fleetlens.operators.correlation import inspection_summary, latest_delivery


def row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def table_counts(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """One row with the row count of every frame."""
    return spark.range(1).select(*[row_count(df).alias(n) for n, df in frames.items()])


def quality_checks(correlation: DataFrame, gaps: DataFrame) -> DataFrame:
    """Row count, distinct ids and guard violations of the correlation, in one pass."""
    return correlation.agg(
        F.count(F.lit(1)).alias("corr_rows"),
        F.count_distinct("complaint_id").alias("distinct_complaints"),
        F.count_if(F.col("days_since_delivery") <= 0).alias("bad_rows_remaining"),
    ).select("corr_rows", "distinct_complaints", row_count(gaps).alias("gap_rows"),
             "bad_rows_remaining")


def metrics_summary(complaints: DataFrame, inspections: DataFrame, deliveries: DataFrame,
                    gaps: DataFrame) -> DataFrame:
    """Totals for the landing page; sums over nothing are 0."""
    return gaps.agg(
        F.count(F.lit(1)).alias("gap_categories"),
        F.coalesce(F.sum("complaint_count"), F.lit(0)).alias("gap_total_complaints"),
    ).select(
        row_count(complaints).alias("total_complaints"),
        row_count(inspections).alias("total_inspections"),
        row_count(deliveries).alias("total_deliveries"),
        "gap_categories",
        "gap_total_complaints",
    )


def dealer_risk_counts(dashboard: DataFrame) -> DataFrame:
    """Dashboard groups per risk flag."""
    return dashboard.groupBy("dealer_risk_flag").agg(F.count(F.lit(1)).alias("cnt"))


def dealer_risk_map(counts: DataFrame) -> DataFrame:
    """The same as one map value; the flags are a fixed set of three."""
    return counts.agg(F.map_from_entries(F.collect_list(
        F.struct("dealer_risk_flag", "cnt"))).alias("dealer_risk"))


def complaint_trends(staged: DataFrame) -> DataFrame:
    """Volume, open/resolved split and classifier confidence per month and category."""
    n = F.count("ai_confidence")
    return staged.groupBy(
        month_of(F.col("complaint_date")).alias("complaint_month"), "category",
    ).agg(
        F.count(F.lit(1)).alias("complaint_count"),
        F.count_if(F.col("status") == "Open").alias("open_count"),
        F.count_if(F.col("status") == "Resolved").alias("resolved_count"),
        F.round(F.sum("ai_confidence") / F.nullif(n, F.lit(0)), 2).cast("double")
        .alias("avg_ai_confidence"),
    )


def dealer_performance(staged_complaints: DataFrame, staged_inspections: DataFrame) -> DataFrame:
    """Inspections, fail rate and complaints per inspection for every dealer.

    An inspection fails by its overall result, not by that of one item.
    """
    inspected = staged_inspections.groupBy("dealer_code", "dealer_name").agg(
        F.count(F.lit(1)).alias("inspected"), F.count_if(is_fail(F.col("overall_result"))).alias("failed"))
    complained = staged_complaints.groupBy("dealer_code", "dealer_name").agg(
        F.count(F.lit(1)).alias("complained"))
    both = inspected.join(complained, ["dealer_code", "dealer_name"], "full")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("inspected", "failed", "complained")]
    return both.select("dealer_code", "dealer_name", *counts).select(
        "dealer_code", "dealer_name",
        F.col("inspected").alias("total_inspections"),
        F.col("complained").alias("total_complaints"),
        pct(F.col("complained"), F.col("inspected")).alias("complaint_rate_pct"),
        pct(F.col("failed"), F.col("inspected")).alias("fail_rate_pct"),
    )


def vehicle_risk_profile(complaints: DataFrame, inspections: DataFrame,
                         deliveries: DataFrame) -> DataFrame:
    """Risk score and level of every inspected vehicle, with its complaint count.

    All three inputs are reduced to one row per vehicle before they are joined,
    so no join sees more than one row per key on either side.
    """
    counts = complaints.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("complaints"))
    items = F.col("failed_items")
    score = risk_score_sql(
        F.col("fail_count"), F.array_contains(items, V.ENGINE_ITEM),
        F.array_contains(items, V.BRAKE_ITEM), F.array_contains(items, V.ELECTRICAL_ITEM),
        F.col("dealer_id"), F.col("delivery_condition"))
    return (
        inspection_summary(inspections)
        .join(latest_delivery(deliveries), "vehicle_id", "left")
        .join(counts, "vehicle_id", "left")
        .withColumn("risk_score", score)
        .select(
            "vehicle_id", "dealer_id", "delivery_condition", "fail_count",
            F.coalesce("complaints", F.lit(0)).alias("complaint_count"),
            "risk_score",
            first_match([(F.col("risk_score") >= 0.70, "High"),
                         (F.col("risk_score") >= 0.35, "Medium")], "Low").alias("risk_level"),
        )
    )


def checklist_gap_analysis(detail: DataFrame) -> DataFrame:
    """Catch rate and gap class per category and issue."""
    grouped = detail.groupBy(
        F.col("complaint_category").alias("category"), F.col("specific_issue").alias("subcategory"),
    ).agg(
        F.count(F.lit(1)).alias("complaint_count"),
        F.min("mapped_checklist_item").alias("mapped_inspection_item"),
        F.count_if(F.col("inspection_status") == "FAIL").alias("caught"),
        F.bool_or(F.col("coverage_gap").startswith("NOT COVERED")).alias("not_covered"),
    ).withColumn("pdi_catch_rate_pct", pct(F.col("caught"), F.col("complaint_count")))
    return grouped.select(
        "category", "subcategory", "complaint_count", "mapped_inspection_item",
        "pdi_catch_rate_pct",
        first_match([
            (F.col("not_covered"), "Critical Gap"),
            ((F.col("caught") == 0) & (F.col("complaint_count") >= 2), "Major Gap"),
        ], "Covered").alias("gap_classification"),
    )


def _mean(column: str, digits: int) -> Column:
    # summed as decimals: the result does not depend on the order of the rows
    value = F.col(column).cast("decimal(18,4)")
    share = F.sum(value) / F.nullif(F.count(value), F.lit(0))
    return F.coalesce(F.round(share, digits).cast("double"), F.lit(0.0))


def _total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def summary_cards(trends: DataFrame, dealers: DataFrame, vehicles: DataFrame,
                  gaps: DataFrame) -> DataFrame:
    """The four dashboard cards as one row of structs."""
    def card(df: DataFrame, **columns: Column) -> Column:
        fields = [c.alias(n) for n, c in columns.items()]
        return df.agg(F.struct(*fields)).scalar()

    def level(name: str) -> Column:
        return F.count_if(F.col("risk_level") == name)

    rows = F.count(F.lit(1))
    return dealers.sparkSession.range(1).select(
        card(trends, total_complaints=_total(F.col("complaint_count")),
             open_complaints=_total(F.col("open_count")),
             resolved_complaints=_total(F.col("resolved_count")),
             avg_ai_confidence=_mean("avg_ai_confidence", 2)).alias("complaints"),
        card(dealers, total_dealers=rows, total_inspections=_total(F.col("total_inspections")),
             avg_complaint_rate=_mean("complaint_rate_pct", 1),
             avg_fail_rate=_mean("fail_rate_pct", 1)).alias("dealers"),
        card(vehicles, total_vehicles=rows, high_risk=level("High"), medium_risk=level("Medium"),
             low_risk=level("Low")).alias("vehicles"),
        card(gaps, total_gaps=rows,
             critical_gaps=F.count_if(F.col("gap_classification") == "Critical Gap"),
             avg_catch_rate=_mean("pdi_catch_rate_pct", 1)).alias("gaps"),
    )
