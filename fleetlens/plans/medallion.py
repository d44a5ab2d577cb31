"""The staged -> bronze -> silver -> gold run over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import correlation as corr
from fleetlens.operators import dashboard as dash
from fleetlens.operators import rollups
from fleetlens.operators.gaps import epdi_gaps, gap_analysis, gap_vehicles
from fleetlens.sources import staging as stg
from fleetlens.sources.sinks import (
    append_new, bucketed_rows, buckets_of, class_of, fresh_table, materialize, publish, replace_parts,
    replace_rows, rows_in_classes, rows_to_append)

FEEDS = [
    ("complaints", "complaint_id", stg.COMPLAINT_COLUMNS, stg.to_bronze_complaints),
    ("inspections", "inspection_id", stg.INSPECTION_COLUMNS, stg.to_bronze_inspections),
    ("deliveries", "delivery_id", stg.DELIVERY_COLUMNS, stg.to_bronze_deliveries),
]


VEHICLE_PART = "vehicle_part"  # directory of a silver row: the bucket that bronze has its vehicle in
TOUCHED = "silver_touched"


def _new_rows(name: str, columns: list[str], to_bronze, staged: dict[str, DataFrame]) -> tuple[DataFrame, str | None]:
    """Unprocessed rows of a feed in bronze form, and the column that tells versions of a record apart."""
    timed = staged[name]
    newest = stg.INGESTED if "created_at" in timed.columns else None
    if newest:
        timed = timed.withColumn(newest, F.col("created_at"))
    return to_bronze(stg.read_unprocessed(timed, [*columns, *([newest] if newest else [])])), newest


def run_bronze(staged: dict[str, DataFrame], prefix: str = "") -> None:
    """Append the unprocessed rows of the three feeds that bronze doesn't hold yet.

    The bronze tables decide what is new, so a run may be repeated, or a stream
    (:mod:`fleetlens.streaming.ingest`) may have brought some of the rows before.  Of versions of
    a record the newest by ``created_at``, where the feed has it, is taken.  The tables are bucketed
    by vehicle, so that silver links them without an exchange.
    """
    for name, id_col, columns, to_bronze in FEEDS:
        new, newest = _new_rows(name, columns, to_bronze, staged)
        append_new(new, f"{prefix}bronze_{name}", id_col, newest, bucket_by="vehicle_id")


def bronze_tables(spark: SparkSession, prefix: str = "") -> list[DataFrame]:
    """Complaints, inspections and deliveries, by bucket of their vehicle."""
    return [bucketed_rows(spark, f"{prefix}bronze_{name}", "vehicle_id") for name, *_ in FEEDS]


def run_silver(spark: SparkSession, prefix: str = "") -> DataFrame:
    """Links, correlation and gaps.

    The links of all complaints are stored once: the correlation is a filter over
    them and the gold detail table a projection, so neither repeats the join.
    """
    c, i, d = bronze_tables(spark, prefix)
    links = materialize(_in_directories(spark, prefix, corr.link(c, i, d)), f"{prefix}silver_complaint_links",
                        partition_by=VEHICLE_PART)
    linked = materialize(corr.guard_after_delivery(links), f"{prefix}silver_complaint_correlation",
                         partition_by=VEHICLE_PART).drop(VEHICLE_PART)
    return _run_gaps(prefix, c, i, linked)


def _vehicle_classes(spark: SparkSession, prefix: str) -> int:
    return buckets_of(spark, f"{prefix}bronze_complaints") or int(spark.conf.get("spark.sql.shuffle.partitions"))


def _in_directories(spark: SparkSession, prefix: str, links: DataFrame) -> DataFrame:
    return links.withColumn(VEHICLE_PART, class_of("vehicle_id", _vehicle_classes(spark, prefix)))


def silver_table(spark: SparkSession, name: str, prefix: str = "") -> DataFrame:
    """The rows of `complaint_links` or `complaint_correlation`, without their directory."""
    return fresh_table(spark, f"{prefix}silver_{name}").drop(VEHICLE_PART)


def _run_gaps(prefix: str, c: DataFrame, i: DataFrame, linked: DataFrame) -> DataFrame:
    gaps = materialize(epdi_gaps(c, i), f"{prefix}silver_epdi_gaps")
    materialize(gap_vehicles(c, i), f"{prefix}silver_epdi_gap_vehicles")
    return rollups.quality_checks(linked, gaps)


def run_increment(spark: SparkSession, staged: dict[str, DataFrame], prefix: str = "") -> list[int]:
    """Bring new rows to bronze and link again only the vehicles that share a bucket with one of them.

    Silver must have been made by :func:`run_silver`.  Besides the ids that tell which rows are new, only touched buckets of bronze and of the two
    tables of links are read, and of the latter replaced; a second run without new rows touches nothing.  The buckets are noted in a
    table before bronze grows and struck out when silver holds them, so a run that died is made good by the next one: linking
    again gives the same rows.  The gap tables and gold are aggregates of the whole and are left to :func:`run_silver`'s and
    :func:`run_gold`'s next run.  One run at a time may write.  Returns the touched buckets.
    """
    classes, noted = _vehicle_classes(spark, prefix), f"{prefix}{TOUCHED}"
    touched: set[int] = set()
    for name, id_col, columns, to_bronze in FEEDS:
        new, newest = _new_rows(name, columns, to_bronze, staged)
        fresh = rows_to_append(new, f"{prefix}bronze_{name}", id_col, newest)
        touched |= {r[0] for r in fresh.select(class_of("vehicle_id", classes)).distinct().collect()}  # `classes` at most
    if touched:
        spark.createDataFrame([(k,) for k in sorted(touched)], f"{VEHICLE_PART} int").coalesce(1).write.mode(
            "append").saveAsTable(noted)
    run_bronze(staged, prefix)
    if not spark.catalog.tableExists(noted):
        return []
    touched = {r[0] for r in fresh_table(spark, noted).distinct().collect()}
    if touched:
        wanted = sorted(touched)
        c, i, d = (rows_in_classes(spark, f"{prefix}bronze_{name}", "vehicle_id", classes, wanted) for name, *_ in FEEDS)
        links = f"{prefix}silver_complaint_links"
        replace_parts(_in_directories(spark, prefix, corr.link(c, i, d)), links, VEHICLE_PART, wanted)
        again = spark.table(links).where(F.col(VEHICLE_PART).isin(wanted))
        replace_parts(corr.guard_after_delivery(again), f"{prefix}silver_complaint_correlation", VEHICLE_PART, wanted)
        spark.sql(f"TRUNCATE TABLE `{noted}`")
    return sorted(touched)


def run_gold(spark: SparkSession, prefix: str = "") -> DataFrame:
    links = silver_table(spark, "complaint_links", prefix)
    linked = silver_table(spark, "complaint_correlation", prefix)
    gaps = spark.table(f"{prefix}silver_epdi_gaps")
    publish(dash.complaint_dashboard(linked), f"{prefix}gold_complaint_dashboard")
    publish(gap_analysis(gaps), f"{prefix}gold_epdi_gap_analysis")
    publish(dash.delivery_service_link(linked), f"{prefix}gold_delivery_service_link")
    detail = publish(corr.detail_from_links(links), f"{prefix}gold_complaint_detail",
                     cluster_by=["complaint_category", "specific_issue", "complaint_id"])
    recommended = publish(dash.checklist_recommendations(detail),
                              f"{prefix}gold_checklist_recommendations")
    replace_rows(dash.enhanced_recommendations(recommended),
                 f"{prefix}gold_checklist_recommendations_ai")
    return gold_checks(spark, prefix)


def gold_checks(spark: SparkSession, prefix: str = "") -> DataFrame:
    """Row counts of the stored gold tables."""
    names = {"dashboard_rows": "complaint_dashboard", "gap_rows": "epdi_gap_analysis",
             "delivery_rows": "delivery_service_link", "detail_rows": "complaint_detail",
             "reco_rows": "checklist_recommendations"}
    return rollups.table_counts(
        spark, {k: spark.table(f"{prefix}gold_{n}") for k, n in names.items()})


def run_rollups(spark: SparkSession, staged: dict[str, DataFrame], prefix: str = "") -> None:
    """The four tables behind the summary cards."""
    c, i, d = bronze_tables(spark, prefix)
    publish(rollups.complaint_trends(staged["complaints"]), f"{prefix}gold_complaint_trends")
    publish(rollups.dealer_performance(staged["complaints"], staged["inspections"]),
                f"{prefix}gold_dealer_performance")
    publish(rollups.vehicle_risk_profile(c, i, d), f"{prefix}gold_vehicle_risk_profile")
    publish(rollups.checklist_gap_analysis(spark.table(f"{prefix}gold_complaint_detail")),
                f"{prefix}gold_checklist_gap_analysis")


def summary_cards(spark: SparkSession, prefix: str = "") -> DataFrame:
    """The four cards from the stored rollups."""
    return rollups.summary_cards(*(spark.table(f"{prefix}gold_{n}") for n in (
        "complaint_trends", "dealer_performance", "vehicle_risk_profile",
        "checklist_gap_analysis")))


def run_all(spark: SparkSession, staged: dict[str, DataFrame],
            prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """The stages in order; returns the silver and the gold checks."""
    run_bronze(staged, prefix)
    silver = run_silver(spark, prefix)
    gold = run_gold(spark, prefix)
    run_rollups(spark, staged, prefix)
    return silver, gold


def drop_tables(spark: SparkSession, prefix: str) -> None:
    """Drop every table and view whose name begins with ``prefix``, which must not be empty."""
    if not prefix:
        raise ValueError("a prefix is needed")
    for table in spark.catalog.listTables():
        if table.name.startswith(prefix) and not table.isTemporary:
            spark.sql(f"DROP {'VIEW' if table.tableType == 'VIEW' else 'TABLE'} `{table.name}`")


def stored_detail(spark: SparkSession, prefix: str = "") -> DataFrame:
    """The detail table by the join of stored complaints and stored correlation."""
    return corr.complaint_detail(spark.table(f"{prefix}bronze_complaints"),
                                 silver_table(spark, "complaint_correlation", prefix))


def stored_recommendations(spark: SparkSession, prefix: str = "") -> DataFrame:
    """The stored recommendations with improved procedures, without their load time."""
    table = spark.table(f"{prefix}gold_checklist_recommendations_ai")
    return table.where(F.col("generated_at").isNotNull()).drop("generated_at")
