"""Streams against their batch twins."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from fleetlens.sources import staging
from fleetlens.sources import sinks
from fleetlens.streaming.alerts import open_windows, spike_alert
from fleetlens.streaming.ingest import ingest_stream, staged_stream

T0 = dt.datetime(2024, 1, 1)
STAGED = ("complaint_id string, vehicle_id string, customer_id string, complaint_date date, "
          "complaint_category string, description string, processed boolean, "
          "ingested_at timestamp")


def record(n, hours=0):
    return (f"CC-{n}", f"V{n % 5}", "CU", T0.date(), "Service", "text", False,
            T0 + dt.timedelta(hours=hours))


def put(spark, folder, rows):
    spark.createDataFrame(rows, STAGED).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture()
def table(spark):
    name = f"t_ingest_{uuid.uuid4().hex}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def run(spark, source, table, state):
    schema = spark.createDataFrame([], STAGED).schema
    ingest_stream(staged_stream(spark, str(source), schema, max_files=1), "complaint_id",
                  staging.COMPLAINT_COLUMNS, staging.to_bronze_complaints, table,
                  str(state)).awaitTermination()
    return sorted(r.complaint_id for r in sinks.fresh_table(spark, table).collect())


def test_ingest_is_incremental_and_drops_resent_ids(spark, tmp_path, table):
    source, state = tmp_path / "in", tmp_path / "state"
    put(spark, source, [record(n) for n in range(10)] + [record(3), record(3)])
    assert run(spark, source, table, state) == list(range(10))
    assert run(spark, source, table, state) == list(range(10))
    put(spark, source, [record(n, 1) for n in range(8, 15)])
    assert run(spark, source, table, state) == list(range(15))


def test_late_records_are_kept(spark, tmp_path, table):
    source, state = tmp_path / "in", tmp_path / "state"
    put(spark, source, [record(n, 100) for n in range(5)])
    run(spark, source, table, state)
    put(spark, source, [record(n, -100) for n in range(3, 8)])
    assert run(spark, source, table, state) == list(range(8))


def test_lost_checkpoint_gives_each_id_once(spark, tmp_path, table):
    """Several batches, then a fresh checkpoint over all of them, with late and resent ids."""
    source = tmp_path / "in"
    for part in (range(5), range(5, 8), range(2, 10)):
        put(spark, source, [record(n, -50 * (n % 2)) for n in part])
        run(spark, source, table, tmp_path / "first")
    assert run(spark, source, table, tmp_path / "fresh") == list(range(10))
    put(spark, source, [record(n) for n in range(9, 12)])
    assert run(spark, source, table, tmp_path / "fresh") == list(range(12))


def test_stream_and_batch_fill_the_same_table(spark, tmp_path, table):
    source = tmp_path / "in"
    put(spark, source, [record(n) for n in range(6)])
    run(spark, source, table, tmp_path / "state")
    feed = spark.createDataFrame([record(n) for n in range(4, 9)], STAGED)
    new = staging.to_bronze_complaints(staging.read_unprocessed(feed, staging.COMPLAINT_COLUMNS))
    sinks.append_new(new, table, "complaint_id")
    assert run(spark, source, table, tmp_path / "state") == list(range(9))


def test_rows_without_a_key_are_told_apart_by_their_columns(spark, table):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b"), (1, "c")], "k int, x string")
    for _ in range(2):
        sinks.append_new(df, table, "k")
    assert sorted(r.x for r in sinks.fresh_table(spark, table).collect()) == ["a", "b", "c"]


def test_alert_stream_equals_batch_for_closed_windows(spark, tmp_path):
    rows = [("D1" if n % 3 else "D2", "NVH", T0 + dt.timedelta(minutes=11 * n))
            for n in range(300)]
    schema = "dealer_code string, category string, created_at timestamp"
    df = spark.createDataFrame(rows, schema)
    df.repartition(1).sortWithinPartitions("created_at").write.parquet(str(tmp_path / "in"))
    stream = spike_alert(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    (stream.writeStream.format("parquet").outputMode("append")
     .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
     .start(str(tmp_path / "out")).awaitTermination())
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    closed = spike_alert(df).where(
        F.col("window_end") <= max(r[2] for r in rows) - dt.timedelta(hours=1))
    assert closed.count() > 0
    assert got.exceptAll(closed).count() == 0 and closed.exceptAll(got).count() == 0
    both, all_alerts = got.unionByName(open_windows(df)), spike_alert(df)
    assert both.exceptAll(all_alerts).count() == 0 and all_alerts.exceptAll(both).count() == 0


def test_alert_needs_more_than_five(spark):
    def alerts(n):
        rows = [("D", "NVH", T0 + dt.timedelta(minutes=m)) for m in range(n)]
        return spike_alert(spark.createDataFrame(
            rows, "dealer_code string, category string, created_at timestamp_ntz"))

    assert alerts(5).count() == 0
    assert alerts(6).count() == 6


def test_late_complaints_are_not_in_the_streams_counts(spark, tmp_path):
    """Later than the watermark: the stream leaves them out, the batch form counts them."""
    schema = "dealer_code string, category string, created_at timestamp"
    source = str(tmp_path / "in")

    def put_rows(minutes):
        rows = [("D", "NVH", T0 + dt.timedelta(minutes=m)) for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def pump():
        alerts = spike_alert(spark.readStream.schema(schema).parquet(source))
        (alerts.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
         .start(str(tmp_path / "out")).awaitTermination())
        got = spark.read.schema(alerts.schema).parquet(str(tmp_path / "out"))
        return {r.window_start: r.complaints for r in got.collect()}

    put_rows(range(6))
    put_rows([3000])
    first = pump()
    put_rows(range(10, 16))  # two days late
    put_rows([6000])
    assert pump() == first and first[T0] == 6
    whole = {r.window_start: r.complaints for r in spike_alert(
        spark.read.schema(schema).parquet(source)).collect()}
    assert whole[T0] == 12
