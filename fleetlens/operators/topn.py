"""Latest row, top-n and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int,
                  rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key.

    Spark plans ``row_number <= n`` with a group limit on both sides of the
    shuffle, so a task sends at most ``n`` rows per key however hot the key is.
    """
    numbered = df.withColumn("_rn", F.row_number().over(
        Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n)
    return numbered.withColumnRenamed("_rn", rank) if rank else numbered.drop("_rn")


def latest_by(df: DataFrame, keys: list[str], order: list[str], ties: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order``, then by ``ties``; NULLs come last."""
    return top_n_per_key(df, keys, [F.desc(c) for c in [*order, *ties]], 1)


def top_n(df: DataFrame, order: list[Column], n: int, where: Column | None = None) -> DataFrame:
    if where is not None:
        df = df.where(where)
    return df.orderBy(*order).limit(n)


def rank_priority(recommendations: DataFrame, order: list[Column]) -> DataFrame:
    """Number the recommendations 1..n in ``order``.

    Recommendations hold one row per issue label, so the single-task window
    below sees at most as many rows as there are labels in the rule table.
    """
    return recommendations.withColumn(
        "priority", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)
