"""Every operator as a named query over the test tables.

Arrays and structs are flattened here, and only here, so that results compare
as plain columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import rule_values as V
from fleetlens.functions import scoring
from fleetlens.functions.rules import (
    classify_issue, coverage_gap, map_checklist_item, sql_text)
from fleetlens.operators import correlation as corr
from fleetlens.operators import dashboard as dash
from fleetlens.operators import dashboard_state, gaps, inspections, recurrence, rollups, topn, vehicle_state
from fleetlens.operators.ids import assign_ids
from fleetlens.plans import lookups, medallion
from fleetlens.session import scratch_path
from fleetlens.sources import csv_files, sinks
from fleetlens.sources import staging as stg
from fleetlens.sources import star_schema as src
from fleetlens.streaming.alerts import open_windows, spike_alert
from fleetlens.streaming.ingest import ingest_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LOOKUP_CATEGORY = "Service"
LOOKUP_TEXT = "System"
LOOKUP_SUBCATEGORY = "Service Process / Scheduling"


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return register


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    """Array columns as text, keeping their order."""
    return df.withColumns({c: F.array_join(c, "|") for c in columns})


def _cid(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return src.complaints(spark, sf), src.inspections(spark, sf), src.deliveries(spark, sf)


def _correlation(spark: SparkSession, sf: str) -> DataFrame:
    return corr.correlate(*_cid(spark, sf))


def _detail(spark: SparkSession, sf: str) -> DataFrame:
    return corr.complaint_detail_from_bronze(*_cid(spark, sf))


def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.epdi_gaps(src.complaints(spark, sf), src.inspections(spark, sf))


def _recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return dash.checklist_recommendations(_detail(spark, sf))


def _dashboard(spark: SparkSession, sf: str) -> DataFrame:
    return dash.complaint_dashboard(_correlation(spark, sf))


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    return recurrence.recurrence_pairs(
        src.staging_inspections(spark, sf), src.staging_complaints(spark, sf))


# --- sources and sinks -------------------------------------------------------
@query("ingest_unprocessed")
def ingest_unprocessed(spark, sf):
    return stg.read_unprocessed(src.staging_complaints(spark, sf), stg.COMPLAINT_COLUMNS)


@query("bronze_complaints")
def bronze_complaints(spark, sf):
    return stg.to_bronze_complaints(
        stg.read_unprocessed(src.staging_complaints(spark, sf), stg.COMPLAINT_COLUMNS))


@query("bronze_inspections")
def bronze_inspections(spark, sf):
    return stg.to_bronze_inspections(
        stg.read_unprocessed(src.staging_inspections(spark, sf), stg.INSPECTION_COLUMNS))


@query("bronze_deliveries")
def bronze_deliveries(spark, sf):
    return stg.to_bronze_deliveries(
        stg.read_unprocessed(src.staging_deliveries(spark, sf), stg.DELIVERY_COLUMNS))


@query("mark_processed")
def mark_processed(spark, sf):
    staged = src.staging_complaints(spark, sf)
    taken = staged.where(~F.col("processed") & F.col("severity").isin("High", "Critical"))
    return stg.mark_processed(staged, taken, "complaint_id").select("complaint_id", "processed")


@query("mark_stored")
def mark_stored(spark, sf):
    """The same marks in a stored table with a directory for each mark and month."""
    staged = src.staging_complaints(spark, sf).select(
        "complaint_id", "severity", F.trunc("created_at", "month").alias("month"), "processed")
    table = f"run_{uuid.uuid4().hex}_staging"
    staged.hint("rebalance", F.col("processed"), F.col("month")).write.partitionBy("processed", "month").saveAsTable(table)
    taken = staged.where(~F.col("processed") & F.col("severity").isin("High", "Critical"))
    sinks.mark_stored(taken, table, "complaint_id", "month")
    return spark.table(table).select("complaint_id", "processed")


@query("assign_ids")
def new_ids(spark, sf):
    staged = src.staging_complaints(spark, sf)
    existing = stg.to_bronze_complaints(staged.where("processed"))
    return assign_ids(staged.where(~F.col("processed")).select("complaint_id", "customer_name"),
                      existing, key="complaint_id", existing_id="complaint_id")


@query("parse_classification")
def parse_classification(spark, sf):
    return stg.parse_classification(src.model_answers(spark, sf))


@query("load_csv")
def load_csv(spark, sf):
    """Export the staged complaints as CSV and load them back, blanks as NULL."""
    folder = scratch_path(spark, "csv")
    staged = src.staging_complaints(spark, sf).select(
        "complaint_id", "vin", "complaint_date", "description", "category", "ai_confidence",
        "processed")
    staged.write.csv(folder, header=True)
    return csv_files.load_csv(spark, folder, staged.schema)


@query("load_csv_multi_line")
def load_csv_multi_line(spark, sf):
    """The same with a line break in every description."""
    folder = scratch_path(spark, "csv")
    staged = src.staging_complaints(spark, sf).select(
        "complaint_id", F.concat(F.col("description"), F.lit("\n"), F.col("category"))
        .alias("description"))
    staged.write.csv(folder, header=True, escape='"', ignoreLeadingWhiteSpace=False,
                     ignoreTrailingWhiteSpace=False)
    return csv_files.load_csv(spark, folder, staged.schema, multi_line=True)


@query("query_table")
def query_table(spark, sf):
    """Filtered read of a named table; the gap report has one row per category."""
    gaps.gap_analysis(_gaps(spark, sf)).createOrReplaceTempView("gap_report")
    return sinks.query_table(spark, "gap_report", F.col("severity") == "Critical")


@query("table_counts")
def table_counts(spark, sf):
    c, i, d = _cid(spark, sf)
    return rollups.table_counts(spark, {"complaints": c, "inspections": i, "deliveries": d})


# --- silver ------------------------------------------------------------------
@query("latest_delivery")
def latest_delivery(spark, sf):
    return corr.latest_delivery(src.deliveries(spark, sf))


@query("inspection_summary")
def inspection_summary(spark, sf):
    return _joined(corr.inspection_summary(src.inspections(spark, sf)), "failed_items")


@query("inspection_summary_merged")
def inspection_summary_merged(spark, sf):
    """The summary from states kept for two parts of the inspections."""
    rows = src.inspections(spark, sf)
    parts = [corr.inspection_summary(rows.where(F.pmod("inspection_id", F.lit(2)) == k)) for k in (0, 1)]
    return _joined(vehicle_state.merge_inspections(*parts), "failed_items")


@query("latest_delivery_merged")
def latest_delivery_merged(spark, sf):
    """The latest deliveries from states kept for two parts of the deliveries."""
    rows = src.deliveries(spark, sf)
    parts = [corr.latest_delivery(rows.where(F.pmod("delivery_id", F.lit(2)) == k)) for k in (0, 1)]
    return vehicle_state.merge_deliveries(*parts)


@query("guard_after_delivery")
def guard_after_delivery(spark, sf):
    linked = corr.link(*_cid(spark, sf)).select(
        "complaint_id", "complaint_date", "delivery_date", "days_since_delivery")
    return corr.guard_after_delivery(linked)


@query("complaint_correlation")
def complaint_correlation(spark, sf):
    return _joined(_correlation(spark, sf), "failed_items")


@query("gap_not_in")
def gap_not_in(spark, sf):
    return gaps.uncovered(src.complaints(spark, sf), src.inspections(spark, sf))


@query("gap_left_anti")
def gap_left_anti(spark, sf):
    return gaps.uncovered(src.complaints(spark, sf), src.inspections(spark, sf), null_aware=False)


@query("epdi_gaps")
def epdi_gaps(spark, sf):
    return _gaps(spark, sf)


@query("epdi_gap_vehicles")
def epdi_gap_vehicles(spark, sf):
    return gaps.gap_vehicles(src.complaints(spark, sf), src.inspections(spark, sf))


@query("silver_checks")
def silver_checks(spark, sf):
    return rollups.quality_checks(_correlation(spark, sf), _gaps(spark, sf))


# --- gold --------------------------------------------------------------------
@query("complaint_dashboard")
def complaint_dashboard(spark, sf):
    return _dashboard(spark, sf)


@query("gap_analysis")
def gap_analysis(spark, sf):
    return gaps.gap_analysis(_gaps(spark, sf))


@query("delivery_service_link")
def delivery_service_link(spark, sf):
    return dash.delivery_service_link(_correlation(spark, sf))


@query("classify_issue")
def classify_issue_rules(spark, sf):
    return src.complaints(spark, sf).select(
        "complaint_id", "description", classify_issue().alias("specific_issue"))


@query("map_checklist_item")
def checklist_item_rules(spark, sf):
    return src.complaints(spark, sf).select(
        "complaint_id", map_checklist_item().alias("mapped_checklist_item"))


@query("coverage_gap")
def coverage_gap_rules(spark, sf):
    return src.complaints(spark, sf).select(
        "complaint_id", coverage_gap().alias("coverage_gap"))


@query("complaint_detail")
def complaint_detail(spark, sf):
    return _joined(_detail(spark, sf), "failed_items")


@query("checklist_recommendations")
def checklist_recommendations(spark, sf):
    return _recommendations(spark, sf)


@query("action_lookup")
def action_lookup(spark, sf):
    issues = src.complaints(spark, sf).select(
        "complaint_id", classify_issue().alias("specific_issue"))
    return dash.action_lookup(issues, "specific_issue")


# --- stored run --------------------------------------------------------------
_stored: dict[tuple[str, str], str] = {}


def _staged(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {"complaints": src.staging_complaints(spark, sf),
            "inspections": src.staging_inspections(spark, sf),
            "deliveries": src.staging_deliveries(spark, sf)}


def _stored_run(spark: SparkSession, sf: str) -> str:
    """Table prefix of a stored run over ``sf``, made once for each session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _stored:
        prefix = f"run_{uuid.uuid4().hex}_"
        medallion.run_all(spark, _staged(spark, sf), prefix)
        _stored[key] = prefix
    return _stored[key]


@query("stored_correlation")
def stored_correlation(spark, sf):
    return _joined(medallion.silver_table(spark, "complaint_correlation", _stored_run(spark, sf)), "failed_items")


@query("stored_detail")
def stored_detail(spark, sf):
    return _joined(medallion.stored_detail(spark, _stored_run(spark, sf)), "failed_items")


@query("stored_recommendations_ai")
def stored_recommendations_ai(spark, sf):
    return medallion.stored_recommendations(spark, _stored_run(spark, sf))


@query("stored_counts")
def stored_counts(spark, sf):
    prefix = _stored_run(spark, sf)
    names = ("bronze_complaints", "bronze_inspections", "bronze_deliveries",
             "silver_complaint_links", "silver_complaint_correlation", "silver_epdi_gap_vehicles")
    return rollups.table_counts(spark, {n: spark.table(prefix + n) for n in names})


@query("gold_checks")
def gold_checks(spark, sf):
    return medallion.gold_checks(spark, _stored_run(spark, sf))


@query("ai_priority")
def ai_priority(spark, sf):
    return dash.enhanced_recommendations(_recommendations(spark, sf))


@query("gap_pct")
def gap_pct(spark, sf):
    return dash.enhanced_recommendations(_recommendations(spark, sf)).select(
        "what_customers_complain_about", "pct_caught_by_inspection", "gap_pct")


@query("stored_categories")
def stored_categories(spark, sf):
    return lookups.categories(spark, _stored_run(spark, sf))


@query("stored_dealers")
def stored_dealers(spark, sf):
    return lookups.dealers(spark, _stored_run(spark, sf))


@query("stored_gap_class")
def stored_gap_class(spark, sf):
    return lookups.gap_class(spark, LOOKUP_CATEGORY, LOOKUP_SUBCATEGORY, _stored_run(spark, sf))


@query("stored_gap_context")
def stored_gap_context(spark, sf):
    return lookups.gap_context(spark, _stored_run(spark, sf))


@query("stored_dealer_risk")
def stored_dealer_risk(spark, sf):
    return lookups.dealer_risk_counts(spark, _stored_run(spark, sf))


@query("stored_top_recommendations")
def stored_top_recommendations(spark, sf):
    return lookups.top_recommendations(spark, LOOKUP_TEXT, _stored_run(spark, sf))


@query("stored_complaints_of")
def stored_complaints_of(spark, sf):
    return _joined(lookups.complaints_of(spark, LOOKUP_CATEGORY, prefix=_stored_run(spark, sf)), "failed_items")


def _period_dashboard(spark: SparkSession, sf: str, unit: str) -> DataFrame:
    """From the states of two parts of the stored links, merged."""
    prefix = _stored_run(spark, sf)
    linked = medallion.silver_table(spark, "complaint_correlation", prefix)
    columns = ("vehicle_id", "customer_id")
    numbers = {}
    for column in columns:
        path = scratch_path(spark, "numbers")
        dashboard_state.numbered(linked, column).write.parquet(path)
        numbers[column] = spark.read.parquet(path)
    parts = [linked.where(F.pmod("complaint_id", F.lit(2)) == k) for k in (0, 1)]
    sums = [dashboard_state.rolled_up(dashboard_state.sums(part), unit) for part in parts]
    members = [dashboard_state.rolled_up(dashboard_state.members(part, column, numbers[column]), unit)
               for part in parts for column in columns]
    return dashboard_state.dashboard(dashboard_state.merge_sums(*sums), dashboard_state.merge_members(*members))


@query("dashboard_from_states")
def dashboard_from_states(spark, sf):
    return _period_dashboard(spark, sf, "month")


@query("quarterly_dashboard")
def quarterly_dashboard(spark, sf):
    """Months rolled up to quarters without the complaints."""
    return _period_dashboard(spark, sf, "quarter")


# --- lookups and reports -----------------------------------------------------
@query("lookup_gap")
def lookup_gap(spark, sf):
    return gaps.lookup_gap(gaps.gap_analysis(_gaps(spark, sf)), LOOKUP_CATEGORY)


@query("lookup_gap_class")
def lookup_gap_class(spark, sf):
    return gaps.lookup_gap_class(rollups.checklist_gap_analysis(_detail(spark, sf)),
                                 LOOKUP_CATEGORY, LOOKUP_SUBCATEGORY)


@query("lookup_gap_category")
def lookup_gap_category(spark, sf):
    return gaps.lookup_gap_class(rollups.checklist_gap_analysis(_detail(spark, sf)),
                                 LOOKUP_CATEGORY)


@query("top_recommendations")
def top_recommendations(spark, sf):
    return dash.lookup_recommendations(
        dash.enhanced_recommendations(_recommendations(spark, sf)), LOOKUP_TEXT)


@query("recent_topn")
def recent_topn(spark, sf):
    return topn.top_n(
        src.staging_complaints(spark, sf).select(
            "complaint_id", "vin", "model", "variant", "customer_name", "dealer_name",
            "complaint_date", "category", "subcategory", "ai_category", "ai_subcategory",
            "ai_confidence", "severity", "status", "description", "created_at"),
        [F.desc("created_at"), F.desc("complaint_id")], 20)


@query("recent_inspections")
def recent_inspections(spark, sf):
    return topn.top_n(
        src.staging_inspections(spark, sf).select(
            "inspection_id", "vin", "model", "variant", "dealer_name", "inspector_name",
            "inspection_date", "overall_result", "risk_score", "risk_confidence",
            "delivery_cleared", "created_at"),
        [F.desc("created_at"), F.desc("inspection_id")], 20)


@query("metrics_summary")
def metrics_summary(spark, sf):
    return rollups.metrics_summary(*_cid(spark, sf), _gaps(spark, sf))


@query("dealer_risk_counts")
def dealer_risk_counts(spark, sf):
    return rollups.dealer_risk_counts(_dashboard(spark, sf))


@query("dealer_risk_map")
def dealer_risk_map(spark, sf):
    """The same counts by their keys; a flag that no group has is NULL."""
    counts = rollups.dealer_risk_map(rollups.dealer_risk_counts(_dashboard(spark, sf)))
    flags = {"normal": "Normal", "monitor": "Monitor", "high_risk": "High Risk Dealer"}
    return counts.select(*[
        F.try_element_at("dealer_risk", F.lit(flag)).alias(name) for name, flag in flags.items()])


@query("distinct_dealers")
def distinct_dealers(spark, sf):
    return topn.distinct_values(
        _correlation(spark, sf).where(F.col("dealer_id").isNotNull()), ["dealer_id"])


@query("distinct_categories")
def distinct_categories(spark, sf):
    return topn.distinct_values(
        rollups.checklist_gap_analysis(_detail(spark, sf)), ["category", "subcategory"])


@query("distinct_dealer_names")
def distinct_dealer_names(spark, sf):
    return topn.distinct_values(dealer_performance(spark, sf), ["dealer_code", "dealer_name"])


@query("complaint_trends")
def complaint_trends(spark, sf):
    return rollups.complaint_trends(src.staging_complaints(spark, sf))


@query("dealer_performance")
def dealer_performance(spark, sf):
    return rollups.dealer_performance(
        src.staging_complaints(spark, sf), src.staging_inspections(spark, sf))


@query("vehicle_risk_profile")
def vehicle_risk_profile(spark, sf):
    return rollups.vehicle_risk_profile(*_cid(spark, sf))


@query("checklist_gap_analysis")
def checklist_gap_analysis(spark, sf):
    return rollups.checklist_gap_analysis(_detail(spark, sf))


@query("summary_cards")
def summary_cards(spark, sf):
    cards = medallion.summary_cards(spark, _stored_run(spark, sf))
    return cards.select("complaints.*", "dealers.*", "vehicles.*", "gaps.*")


@query("gap_context")
def gap_context(spark, sf):
    return gaps.gap_context(rollups.checklist_gap_analysis(_detail(spark, sf)))


# --- risk and inspections ----------------------------------------------------
def _scorer_input(spark: SparkSession, sf: str) -> DataFrame:
    """Inspection result and latest delivery of every inspected vehicle."""
    return corr.inspection_summary(src.inspections(spark, sf)).join(
        corr.latest_delivery(src.deliveries(spark, sf)), "vehicle_id", "left")


@query("risk_score_sql")
def risk_score_sql(spark, sf):
    def failed(item):
        return F.array_contains("failed_items", item)

    return _scorer_input(spark, sf).select(
        "vehicle_id", scoring.risk_score_sql(
            F.col("fail_count"), failed(V.ENGINE_ITEM), failed(V.BRAKE_ITEM),
            failed(V.ELECTRICAL_ITEM), F.col("dealer_id"), F.col("delivery_condition"),
        ).alias("risk_score"))


@query("risk_score_function")
def risk_score_function(spark, sf):
    """The score by its SQL function, from SQL text."""
    scoring.register_score_defect_risk(spark)
    _scorer_input(spark, sf).createOrReplaceTempView("scorer_input")
    engine, brake, electrical = (
        sql_text(i) for i in (V.ENGINE_ITEM, V.BRAKE_ITEM, V.ELECTRICAL_ITEM))
    return spark.sql(f"""
        SELECT vehicle_id, score_defect_risk(
            INT(fail_count), array_contains(failed_items, {engine}),
            array_contains(failed_items, {brake}), array_contains(failed_items, {electrical}),
            dealer_id, delivery_condition) AS risk_score
        FROM scorer_input""")


@query("risk_score_model")
def risk_score_model(spark, sf):
    rows = _scorer_input(spark, sf).withColumn("failed_items", F.to_json("failed_items"))
    return _joined(scoring.risk_score_model(rows).select(
        "vehicle_id", "risk_score", "risk_level", "top_risk_factors"), "top_risk_factors")


@query("inspection_score")
def inspection_score(spark, sf):
    return scoring.inspection_score(src.submissions(spark, sf)).drop("checklist", "fix_actions")


@query("inspection_score_clamped")
def inspection_score_clamped(spark, sf):
    return scoring.inspection_score_clamped(src.forms(spark, sf)).drop("form")


@query("recurrence_pairs")
def recurrence_pairs(spark, sf):
    return _cases(spark, sf)


@query("recurrence_rates")
def recurrence_rates(spark, sf):
    return recurrence.recurrence_rates(_cases(spark, sf))


@query("inspection_decision")
def inspection_decision(spark, sf):
    return recurrence.inspection_decision(
        scoring.inspection_score(src.submissions(spark, sf)),
        recurrence.recurrence_rates(_cases(spark, sf))).drop("checklist", "fix_actions")


@query("default_actions")
def default_actions(spark, sf):
    return inspections.default_actions(src.submissions(spark, sf))


@query("worst_status")
def worst_status(spark, sf):
    return inspections.worst_status(src.forms(spark, sf))


@query("checklist_unpivot")
def checklist_unpivot(spark, sf):
    return inspections.checklist_unpivot(src.staging_inspections(spark, sf))


@query("checklist_pivot")
def checklist_pivot(spark, sf):
    return inspections.checklist_pivot(src.checked_items(spark, sf))


# --- streaming ---------------------------------------------------------------
@query("spike_alert")
def batch_spike_alert(spark, sf):
    return spike_alert(src.staging_complaints(spark, sf))


@query("stream_spike_alert")
def stream_spike_alert(spark, sf):
    """The alert as a stream, closed by a batch pass over the windows still open at its end."""
    base = scratch_path(spark, "alerts")
    alerts = spike_alert(src.stream_staging_complaints(spark, sf))
    run = (alerts.writeStream.format("parquet").outputMode("append")
           .option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
           .start(f"{base}/rows"))
    run.awaitTermination()
    streamed = spark.read.schema(alerts.schema).parquet(f"{base}/rows")
    return streamed.unionByName(open_windows(src.staging_complaints(spark, sf)))


@query("stream_ingest")
def stream_ingest(spark, sf):
    table = f"ingest_{uuid.uuid4().hex}"
    ingest_stream(src.stream_staging_complaints(spark, sf), "complaint_id",
                  [*stg.COMPLAINT_COLUMNS], stg.to_bronze_complaints, table,
                  scratch_path(spark, "ingest")).awaitTermination()
    return sinks.fresh_table(spark, table)
