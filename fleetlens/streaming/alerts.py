"""Complaint spike alerts; the same function serves streams and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.functions.scalars import instant_to_wall, wall_to_instant
from fleetlens.sources.sinks import fresh_table, materialize, replace_parts

BATCH = "batch_id"


def spike_alert(complaints: DataFrame, time_col: str = "created_at",
                keys: tuple[str, ...] = ("dealer_code", "category"), more_than: int = 5,
                length: str = "6 hours", slide: str = "1 hour",
                watermark: str = "1 hour") -> DataFrame:
    """Windows in which a key has more than ``more_than`` complaints.

    On a stream the watermark bounds the state to open windows; a complaint later than
    that is not in the counts of the stream.  On a static frame it is ignored.  Counts combine before the shuffle, so a hot dealer
    sends one row per window and task.
    """
    # watermarks need instants: zone-free times of a stream are taken as UTC and
    # given back zone-free, whatever the session zone
    zone_free = complaints.isStreaming and dict(complaints.dtypes)[time_col] == "timestamp_ntz"
    if zone_free:
        complaints = complaints.withColumn(time_col, wall_to_instant(time_col))

    def bound(name: str) -> Column:
        return instant_to_wall(f"w.{name}") if zone_free else F.col(f"w.{name}")

    return (
        complaints.withWatermark(time_col, watermark)
        .groupBy(F.window(time_col, length, slide).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("complaints"))
        .where(F.col("complaints") > more_than)
        .select(bound("start").alias("window_start"), bound("end").alias("window_end"),
                *keys, "complaints")
    )


def open_windows(complaints: DataFrame, time_col: str = "created_at",
                 watermark: str = "1 hour", **options) -> DataFrame:
    """Alerts of the windows that a stream over the same complaints still holds back.

    In append mode a stream gives a window once the watermark has passed its end; this
    batch pass gives the others, so that both together are complete.
    """
    last = complaints.agg(F.max(time_col)).scalar()
    return spike_alert(complaints, time_col, watermark=watermark, **options).where(
        F.col("window_end") > last - F.expr(f"INTERVAL {watermark}"))


def merged_alert_stream(complaints: DataFrame, table: str, checkpoint: str, **options) -> StreamingQuery:
    """Count the available complaints of a stream into ``table``, so that late ones correct the windows they belong to.

    Each micro-batch keeps its own counts, of whatever windows its complaints are in, in a directory of its
    own, and counts add up: no complaint is too late, and no state is held.  A batch that is retried replaces its directory.
    The table belongs to the checkpoint; a stream that starts anew needs a new table.  ``options`` are those of
    :func:`spike_alert` but ``more_than``; :func:`merged_alerts` reads the table.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        counts = spike_alert(batch, more_than=0, **options).withColumn(BATCH, F.lit(batch_id).cast("int"))
        if not batch.sparkSession.catalog.tableExists(table):
            materialize(counts.limit(0), table, partition_by=BATCH)
        replace_parts(counts, table, BATCH, [batch_id])

    return (
        complaints.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merged_alerts(spark: SparkSession, table: str, more_than: int = 5) -> DataFrame:
    """The alerts of all complaints counted so far: what :func:`spike_alert` gives for them as one batch."""
    counts = fresh_table(spark, table).drop(BATCH)
    groups = [c for c in counts.columns if c != "complaints"]
    return counts.groupBy(*groups).agg(F.sum("complaints").alias("complaints")).where(F.col("complaints") > more_than)
