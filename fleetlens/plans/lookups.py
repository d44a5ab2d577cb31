"""Lookups over the stored gold tables: they link nothing again and read what their filter leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import dashboard, gaps, rollups, topn
from fleetlens.plans.medallion import stored_recommendations
from fleetlens.sources.sinks import query_table


def _gold(spark: SparkSession, name: str, prefix: str) -> DataFrame:
    return spark.table(f"{prefix}gold_{name}")


def categories(spark: SparkSession, prefix: str = "") -> DataFrame:
    """Categories and subcategories that complaints were sorted into."""
    return topn.distinct_values(_gold(spark, "checklist_gap_analysis", prefix), ["category", "subcategory"])


def dealers(spark: SparkSession, prefix: str = "") -> DataFrame:
    return topn.distinct_values(_gold(spark, "complaint_dashboard", prefix), ["dealer_id"])


def gap_class(spark: SparkSession, category: str, subcategory: str | None = None, prefix: str = "") -> DataFrame:
    """Gap classes of a category, or of one subcategory of it."""
    return gaps.lookup_gap_class(_gold(spark, "checklist_gap_analysis", prefix), category, subcategory)


def gap_context(spark: SparkSession, prefix: str = "", n: int = 15) -> DataFrame:
    """The largest gaps of each category as a text block."""
    return gaps.gap_context(_gold(spark, "checklist_gap_analysis", prefix), n)


def dealer_risk_counts(spark: SparkSession, prefix: str = "") -> DataFrame:
    return rollups.dealer_risk_counts(_gold(spark, "complaint_dashboard", prefix))


def top_recommendations(spark: SparkSession, text: str, prefix: str = "", n: int = 5) -> DataFrame:
    return dashboard.lookup_recommendations(stored_recommendations(spark, prefix), text, n)


def complaints_of(spark: SparkSession, category: str, issue: str | None = None, prefix: str = "") -> DataFrame:
    """Linked complaints of a category, or of one issue of it.

    The table is sorted by these columns, so files and row groups of other categories are skipped by their statistics.
    """
    where = F.col("complaint_category") == F.lit(category)
    if issue is not None:
        where &= F.col("specific_issue") == F.lit(issue)
    return query_table(spark, f"{prefix}gold_complaint_detail", where)
