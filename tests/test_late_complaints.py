"""Window counts of a stream that late complaints correct."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from fleetlens.sources.sinks import replace_parts
from fleetlens.streaming import alerts

START = dt.datetime(2024, 1, 1)
SCHEMA = "created_at {}, dealer_code string, category string"


def found(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("time", ["timestamp", "timestamp_ntz"])
def test_late_complaints_correct_their_windows(spark, tmp_path, time):
    rng = random.Random(2)

    def complaints(n, first, last):
        at = [START + dt.timedelta(minutes=rng.randrange(first, last)) for _ in range(n)]
        return spark.createDataFrame([(t, rng.choice(["D1", "D1", None]), rng.choice("ab")) for t in at], SCHEMA.format(time))

    table, folder, checkpoint = f"late_{uuid.uuid4().hex}", str(tmp_path / "in"), str(tmp_path / "point")
    options = {"length": "2 hours", "slide": "1 hour"}
    parts = [complaints(60, 0, 300), complaints(60, 2000, 2300), complaints(40, 0, 300)]  # the last come a day late

    def run():
        stream = spark.readStream.schema(SCHEMA.format(time)).option("maxFilesPerTrigger", 1).parquet(folder)
        alerts.merged_alert_stream(stream, table, checkpoint, **options).awaitTermination()

    try:
        for part in parts[:2]:
            part.coalesce(1).write.mode("append").parquet(folder)
        run()
        early = found(alerts.merged_alerts(spark, table))
        assert early == found(alerts.spike_alert(parts[0].union(parts[1]), **options)) != []
        parts[2].coalesce(1).write.mode("append").parquet(folder)
        run()
        every = parts[0].union(parts[1]).union(parts[2])
        got = alerts.merged_alerts(spark, table)
        assert found(got) == found(alerts.spike_alert(every, **options)) != early
        assert got.columns == alerts.spike_alert(every, **options).columns
        last = max(r[0] for r in spark.table(table).select(alerts.BATCH).distinct().collect())
        counts = alerts.spike_alert(parts[2], more_than=0, **options)  # a batch that is retried
        replace_parts(counts.withColumn(alerts.BATCH, F.lit(last)), table, alerts.BATCH, [last])
        assert found(alerts.merged_alerts(spark, table)) == found(alerts.spike_alert(every, **options))
        run()  # nothing new
        assert found(alerts.merged_alerts(spark, table)) == found(alerts.spike_alert(every, **options))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
