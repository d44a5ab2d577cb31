"""Left joins that survive hot keys.

A left join to a frame with one row per key sends all left rows of a key to one
task.  When a key can hold a third of all rows that task never ends, and runtime
skew handling cannot help because the right side is an aggregate, not a plain
shuffle.  The join is therefore always done in two parts:

* rows of heavy keys stay where they are.  A key is heavy from ``HEAVY_ROWS`` rows
  and 1/``MOST_HEAVY`` of all rows on, so there are at most ``MOST_HEAVY`` of them; each
  has one right row, and these are broadcast.  Rows without a key match nothing
  and stay where they are as well;
* all other rows are shuffled by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_ROWS = 500_000
MOST_HEAVY = 100_000


def heavy_keys(df: DataFrame, key: str, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Keys of ``df`` with at least ``heavy_rows`` rows and 1/``MOST_HEAVY`` of all rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where((F.col("_rows") >= heavy_rows) & (F.col("_rows") * MOST_HEAVY >= total))
        .select(key)
    )


def left_join_unique(left: DataFrame, rights: list[DataFrame], key: str,
                     heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``left`` left-joined to every frame in ``rights``, each unique on ``key``."""
    def chain(start: DataFrame, frames: list[DataFrame]) -> DataFrame:
        return reduce(lambda acc, r: acc.join(r, key, "left"), frames, start)

    heavy = heavy_keys(left, key, heavy_rows)
    # the semi join sinks below the aggregates that make the right frames: what they hold of other keys is not
    # summed up a second time, and nothing at all is read where no key is heavy
    of_heavy = [r.join(F.broadcast(heavy), key, "left_semi") for r in rights]
    # at most MOST_HEAVY rows by their definition
    matched = F.broadcast(chain(heavy, of_heavy).withColumn("_heavy", F.lit(True)))
    stay = left.join(matched, key, "left").where("_heavy OR " f"`{key}` IS NULL").drop("_heavy")
    move = left.where(F.col(key).isNotNull()).join(F.broadcast(heavy), key, "left_anti")
    columns = [*left.columns, *[c for r in rights for c in r.columns if c != key]]
    return chain(move, rights).select(columns).unionByName(stay.select(columns))
