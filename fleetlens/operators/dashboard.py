"""Report tables built from the complaint correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import rule_values as V
from fleetlens.functions.rules import (
    checklist_status, dealer_risk_flag, delivery_risk_level, sql_text)
from fleetlens.functions.scalars import gap_pct, month_of, pct
from fleetlens.operators.topn import rank_priority


def complaint_dashboard(correlation: DataFrame) -> DataFrame:
    """Counts, delays and risk flag per dealer, category and month.

    The distinct counts are planned by Spark as partial aggregates on the group
    plus the counted column, so a hot dealer is spread over its vehicles and
    customers before the last, small merge.
    """
    failed = F.col("inspection_status") == "FAIL"
    days = F.col("days_since_delivery")
    grouped = (
        correlation.where(F.col("dealer_id").isNotNull())
        .groupBy("dealer_id", "complaint_category",
                 month_of(F.col("complaint_date")).alias("complaint_month"))
        .agg(
            F.count("complaint_id").alias("total_complaints"),
            F.count_distinct("vehicle_id").alias("affected_vehicles"),
            F.count_distinct("customer_id").alias("affected_customers"),
            F.round(F.avg(days), 1).alias("avg_days_since_delivery"),
            F.min(days).alias("min_days_since_delivery"),
            F.max(days).alias("max_days_since_delivery"),
            F.count_if(failed).alias("complaints_with_failed_inspection"),
            pct(F.count_if(failed), F.count(F.lit(1))).alias("pct_with_failed_inspection"),
            F.count_if(days <= 7).alias("complaints_within_7days"),
            F.count_if(days <= 30).alias("complaints_within_30days"),
        )
    )
    return grouped.withColumn("dealer_risk_flag", dealer_risk_flag(
        F.col("affected_vehicles"), F.col("pct_with_failed_inspection")))


def delivery_service_link(correlation: DataFrame) -> DataFrame:
    """Complaints per dealer, delivery condition, category and risk level."""
    condition, status = F.col("delivery_condition"), F.col("inspection_status")
    return (
        correlation.where(F.col("dealer_id").isNotNull())
        .withColumn("risk_level", delivery_risk_level(condition, status))
        .groupBy("dealer_id", "delivery_condition", "complaint_category", "risk_level")
        .agg(
            F.count("complaint_id").alias("complaint_count"),
            F.count_distinct("vehicle_id").alias("vehicle_count"),
            F.round(F.avg("days_since_delivery"), 1).alias("avg_days_to_complaint"),
            F.count_if(status == "FAIL").alias("known_inspection_failures"),
            F.count_if(condition == "Damage").alias("damage_at_delivery"),
            F.count_if(condition == "Signature Withheld").alias("signature_withheld"),
        )
    )


def action_rules(spark: SparkSession) -> DataFrame:
    """The issue -> action table, one row per label, as a literal relation."""
    rows = ", ".join(f"({sql_text(i)}, {sql_text(a)})" for i, a in V.ISSUE_ACTIONS.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(issue, action)")


def action_lookup(df: DataFrame, issue_col: str, rules: DataFrame | None = None) -> DataFrame:
    """Add ``specific_action_required``; labels without an entry get the default text.

    The built-in table has a fixed, small number of rows and is broadcast; a
    caller's table is left to Spark's own size check.
    """
    right = F.broadcast(action_rules(df.sparkSession)) if rules is None else rules
    return (
        df.join(right, F.col(issue_col) == F.col("issue"), "left")
        .withColumn("specific_action_required",
                    F.coalesce("action", F.lit(V.DEFAULT_ISSUE_ACTION)))
        .drop("issue", "action")
    )


def checklist_recommendations(detail: DataFrame) -> DataFrame:
    """One row per issue: volume, catch rate, coverage status, action and priority."""
    base = detail.groupBy("specific_issue", "mapped_checklist_item", "coverage_gap").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("inspection_status") == "FAIL").alias("fails"))
    per_issue = base.groupBy("specific_issue").agg(
        # smallest instead of an arbitrary first item, so that runs agree
        F.min("mapped_checklist_item").alias("item"),
        F.sum("n").alias("total_complaints"),
        F.sum("fails").alias("caught_by_inspection"),
        F.bool_or(F.col("coverage_gap").startswith("NOT COVERED")).alias("is_gap"),
        F.max("specific_issue").alias("label"),
    ).withColumn("pct_caught", pct(F.col("caught_by_inspection"), F.col("total_complaints")))
    # tested on an aggregate: as a plain filter it would move down to the rows and
    # have every text classified a second time
    per_issue = per_issue.where(F.col("label") != V.UNCATEGORISED)
    status, priority = checklist_status(
        F.col("is_gap"), F.col("pct_caught"), F.col("total_complaints"))
    return action_lookup(per_issue, "specific_issue").select(
        F.col("specific_issue").alias("what_customers_complain_about"),
        "total_complaints",
        "caught_by_inspection",
        F.col("pct_caught").alias("pct_caught_by_inspection"),
        F.coalesce("item", F.lit("NONE")).alias("current_checklist_item"),
        status.alias("checklist_status"),
        "specific_action_required",
        priority.alias("priority"),
    ).orderBy("priority", F.desc("total_complaints"), "what_customers_complain_about")


def lookup_recommendations(recommendations: DataFrame, text: str, n: int = 5) -> DataFrame:
    """Top recommendations whose issue contains ``text``, highest priority number first."""
    return (
        recommendations.where(F.col("what_customers_complain_about").contains(text))
        .orderBy(F.desc("priority"), "what_customers_complain_about")
        .limit(n)
    )


def enhanced_recommendations(recommendations: DataFrame,
                             answers: DataFrame | None = None) -> DataFrame:
    """Recommendations ranked by volume, with the improved procedure where there is one.

    ``answers`` holds (what_customers_complain_about, ai_recommendation) as
    written by a text model; without an answer the original action stands.
    """
    issue = "what_customers_complain_about"
    if answers is None:
        improved = recommendations.withColumn("ai_recommendation", F.lit(None).cast("string"))
    else:
        improved = recommendations.join(answers, issue, "left")
    ranked = rank_priority(
        improved.withColumnRenamed("priority", "rule_priority"),
        [F.desc("total_complaints"), F.col(issue)])
    return ranked.select(
        issue, "total_complaints", "caught_by_inspection",
        F.coalesce("pct_caught_by_inspection", F.lit(0.0)).alias("pct_caught_by_inspection"),
        gap_pct(F.col("pct_caught_by_inspection")).alias("gap_pct"),
        F.coalesce("current_checklist_item", F.lit("NONE")).alias("current_checklist_item"),
        F.col("specific_action_required").alias("original_action"),
        F.coalesce("ai_recommendation", "specific_action_required").alias("ai_recommendation"),
        "rule_priority", "priority",
    )
