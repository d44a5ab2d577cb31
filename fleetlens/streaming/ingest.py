"""Incremental staging -> bronze ingest.

The stream's checkpoint replaces the processed flag.  Every micro-batch appends the
ids that the bronze table doesn't hold yet, so a batch that is retried, a stream that starts
again with a fresh checkpoint, and records that are resent however late give each id
once.  What has been seen is kept in the table's files, not in the stream's state, and the
batch run fills the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetlens.sources.sinks import append_new
from fleetlens.sources.staging import INGESTED


def staged_stream(spark: SparkSession, folder: str, schema: T.StructType,
                  max_files: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .parquet(folder))


def ingest_stream(staged: DataFrame, id_col: str, columns: list[str],
                  to_bronze: Callable[[DataFrame], DataFrame], table: str,
                  checkpoint: str, newest: str | None = None,
                  bucket_by: str | None = None) -> StreamingQuery:
    """Run the available input through ``to_bronze`` into the managed ``table``.

    ``id_col`` names the key both before and after ``to_bronze``.  One stream or batch
    run at a time may write the table.  Of versions of a record in one micro-batch the newest
    by the staged column ``newest`` is taken.  A micro-batch reads the parts of the table that
    it has keys for, so its cost does not grow with the table.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        time = [F.col(newest).alias(INGESTED)] if newest else []
        append_new(to_bronze(batch.select(*columns, *time)), table, id_col,
                   INGESTED if newest else None, bucket_by)

    return (
        staged.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
