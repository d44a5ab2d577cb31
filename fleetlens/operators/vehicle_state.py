"""Aggregates of a vehicle that are kept and merged instead of computed again.

A state is a frame with one row per vehicle whose columns merge: counts add up, dates take their maximum, sets
of failed items unite, and the latest delivery is the later of two.  The state of all rows is the merge of the
states of any parts that hold each row once, in any order and grouping, so a new batch costs its own rows and
one row for each vehicle it touches.  States are the frames that the joins by vehicle take
(:func:`inspection_summary`, :func:`latest_delivery`), so a stored state takes their place.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.topn import latest_by
from fleetlens.session import scratch_path

STATE_PART = "state_part"
_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def _together(states: tuple[DataFrame, ...]) -> DataFrame:
    return reduce(DataFrame.unionByName, states)


def merge_inspections(*states: DataFrame) -> DataFrame:
    """One :func:`~fleetlens.operators.correlation.inspection_summary` of several.

    A vehicle has at most one row in each, so the lists that are united are as many as the states.
    """
    return _together(states).groupBy("vehicle_id").agg(
        F.when(F.sum("fail_count") > 0, "FAIL").otherwise("PASS").alias("inspection_status"),
        F.sum("fail_count").alias("fail_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("failed_items")))).alias("failed_items"),
        F.max("latest_inspection_date").alias("latest_inspection_date"),
    )


def merge_deliveries(*states: DataFrame) -> DataFrame:
    """The latest of several :func:`~fleetlens.operators.correlation.latest_delivery`."""
    return latest_by(_together(states), ["vehicle_id"], ["delivery_date"], ["delivery_id"])


def complaint_state(complaints: DataFrame) -> DataFrame:
    """Complaints of each vehicle: how many, the first and the last day."""
    return complaints.groupBy("vehicle_id").agg(
        F.count("*").alias("complaint_count"), F.min("complaint_date").alias("first_complaint"),
        F.max("complaint_date").alias("last_complaint"))


def merge_complaints(*states: DataFrame) -> DataFrame:
    return _together(states).groupBy("vehicle_id").agg(
        F.sum("complaint_count").alias("complaint_count"), F.min("first_complaint").alias("first_complaint"),
        F.max("last_complaint").alias("last_complaint"))


def add_to_state(new: DataFrame, table: str, merge: Callable[..., DataFrame], parts: int = 256) -> DataFrame:
    """Merge the state ``new`` into the stored state ``table`` (made where absent) and return the table's rows.

    The table has a directory for each of ``parts`` classes of vehicles.  Only directories of vehicles in ``new`` are read, and
    only these are replaced, after their new content has been written aside.  ``new`` must come from rows that
    the state does not hold yet (as :func:`~fleetlens.sources.sinks.rows_to_append` gives them); one run at a time may write.
    """
    spark: SparkSession = new.sparkSession
    names = new.columns
    dealt = F.pmod(F.xxhash64("vehicle_id"), F.lit(parts)).cast("int").alias(STATE_PART)
    if not spark.catalog.tableExists(table):
        new.select("*", dealt).repartition(STATE_PART).write.partitionBy(STATE_PART).saveAsTable(table)
        return spark.table(table).select(names)
    path = scratch_path(spark, "state")
    new.write.parquet(f"{path}/new")
    new = spark.read.schema(new.schema).parquet(f"{path}/new")
    touched = [r[0] for r in new.select(dealt).distinct().collect()]  # at most `parts` numbers
    spark.catalog.refreshTable(table)
    stored = spark.table(table)
    merged = merge(stored.where(F.col(STATE_PART).isin(touched)).select(names), new).select(*names, dealt)
    merged.write.parquet(f"{path}/merged")
    replaced = spark.read.schema(stored.schema).parquet(f"{path}/merged").select(stored.columns)
    before = spark.conf.get(_OVERWRITE)
    spark.conf.set(_OVERWRITE, "dynamic")  # the writer has no option of its own for tables
    try:
        replaced.repartition(STATE_PART).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(_OVERWRITE, before)
    spark.catalog.refreshTable(table)
    return spark.table(table).select(names)
