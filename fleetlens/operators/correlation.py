"""Complaints linked to the inspection and delivery history of the vehicle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.rules import classify_issue, coverage_gap, map_checklist_item
from fleetlens.functions.scalars import is_fail
from fleetlens.operators.skew import left_join_unique
from fleetlens.operators.topn import latest_by

# columns complaint_detail takes from the correlation
LINKED = ["inspection_status", "failed_items", "delivery_condition", "days_since_delivery",
          "dealer_id"]


def inspection_summary(inspections: DataFrame) -> DataFrame:
    """One row per vehicle: any fail, fail count, failed items, latest inspection.

    Counted per (vehicle, failed item) first and folded per vehicle second.  The
    first step is a plain hash aggregate with map-side combine, so neither a hot
    vehicle nor a large number of vehicles forces a sort; ``collect_set`` over
    the raw rows would fall back to sorting them all.
    """
    failed = is_fail(F.col("status"))
    per_item = (
        inspections.groupBy(
            "vehicle_id", F.when(failed, F.col("checklist_item")).alias("failed_item"))
        .agg(F.count_if(failed).alias("fails"), F.max("inspection_date").alias("latest"))
    )
    return per_item.groupBy("vehicle_id").agg(
        F.when(F.sum("fails") > 0, "FAIL").otherwise("PASS").alias("inspection_status"),
        F.sum("fails").alias("fail_count"),
        F.array_sort(F.collect_list("failed_item")).alias("failed_items"),
        F.max("latest").alias("latest_inspection_date"),
    )


def latest_delivery(deliveries: DataFrame) -> DataFrame:
    """Newest delivery per vehicle; the higher id wins on the same day."""
    return latest_by(deliveries, ["vehicle_id"], ["delivery_date"], ["delivery_id"]).select(
        "vehicle_id", "delivery_id", "dealer_id", "delivery_date", "delivery_condition")


def link(complaints: DataFrame, inspections: DataFrame, deliveries: DataFrame,
         **join_options) -> DataFrame:
    """Every complaint, all its columns, with its vehicle's inspections and latest delivery."""
    joined = left_join_unique(
        complaints, [inspection_summary(inspections), latest_delivery(deliveries)],
        key="vehicle_id", **join_options)
    return joined.select(
        *complaints.columns, "inspection_status", "fail_count", "failed_items",
        "latest_inspection_date", "delivery_id", "dealer_id", "delivery_date",
        "delivery_condition",
        F.date_diff("complaint_date", "delivery_date").alias("days_since_delivery"),
    )


def after_delivery(min_days: int = 1):
    """Condition of the date guard; undelivered vehicles pass."""
    return F.col("delivery_date").isNull() | (F.col("days_since_delivery") >= min_days)


def guard_after_delivery(linked: DataFrame, min_days: int = 1) -> DataFrame:
    return linked.where(after_delivery(min_days))


def correlate(complaints: DataFrame, inspections: DataFrame, deliveries: DataFrame,
              min_days: int = 1, **join_options) -> DataFrame:
    """One row per complaint filed after delivery (or without one)."""
    return guard_after_delivery(
        link(complaints, inspections, deliveries, **join_options), min_days)


def _classified(complaints: DataFrame) -> DataFrame:
    """Complaint columns of the detail table, texts classified.

    Done before the join: the long rule list then runs in the scan, whose splits
    are even whatever the keys, and as a method short enough to be compiled.
    """
    return complaints.withColumn("specific_issue", classify_issue())


def _with_rules(linked: DataFrame) -> DataFrame:
    return linked.select(
        "complaint_id", "vehicle_id", "complaint_category", "description", *LINKED,
        "specific_issue",
        map_checklist_item().alias("mapped_checklist_item"),
        coverage_gap().alias("coverage_gap"),
    )


def complaint_detail(complaints: DataFrame, correlation: DataFrame) -> DataFrame:
    """All complaints with issue, checklist item and coverage text.

    ``complaint_id`` is the primary key of both frames.  For use where only a
    correlation table is stored; the two forms below need no self-join.
    """
    return _with_rules(_classified(complaints).join(
        correlation.select("complaint_id", *LINKED), "complaint_id", "left"))


def detail_from_links(linked: DataFrame, min_days: int = 1) -> DataFrame:
    """Same rows from the result of :func:`link`, without any join.

    Complaints the guard excludes keep NULL link columns.
    """
    if "specific_issue" not in linked.columns:
        linked = _classified(linked)
    kept = after_delivery(min_days)
    return _with_rules(linked.select(
        "complaint_id", "vehicle_id", "complaint_category", "description", "specific_issue",
        *[F.when(kept, F.col(c)).alias(c) for c in LINKED],
    ))


def complaint_detail_from_bronze(complaints: DataFrame, inspections: DataFrame,
                                 deliveries: DataFrame, min_days: int = 1,
                                 **join_options) -> DataFrame:
    """Same rows straight from the bronze frames, in the pass that links them."""
    return detail_from_links(
        link(_classified(complaints), inspections, deliveries, **join_options), min_days)
