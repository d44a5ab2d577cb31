"""Dense surrogate ids without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign_ids(new: DataFrame, existing: DataFrame, key: str, id_col: str = "new_id",
               existing_id: str = "id", hex_digits: int = 4) -> DataFrame:
    """Number ``new`` from ``max(existing id) + 1`` on, without gaps.

    Rows are ordered by (leading ``hex_digits`` of md5(key), key).  The md5
    prefix cuts them into 16**hex_digits even buckets, each numbered on its own;
    a bucket starts where the buckets before it end.  ``key`` is unique in
    ``new``.  The numbering depends on the data alone, so retried tasks agree.
    """
    bucketed = new.withColumn("_bucket", F.substring(
        F.md5(F.col(key).cast("string")), 1, hex_digits))
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # 16**hex_digits rows at most: one window task and a broadcast are bounded
    starts = sizes.select("_bucket", (
        F.coalesce(F.sum("_n").over(
            Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).alias("_start"))
    top = existing.agg(F.coalesce(F.max(existing_id), F.lit(0))).scalar()
    number = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return (
        bucketed.withColumn("_rn", number)
        .join(F.broadcast(starts), "_bucket")
        .withColumn(id_col, (top + F.col("_start") + F.col("_rn")).cast("bigint"))
        .drop("_bucket", "_rn", "_start")
    )
