"""Managed-table writes and reads."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.topn import latest_by
from fleetlens.session import scratch_path


def append(df: DataFrame, table: str) -> None:
    df.write.mode("append").saveAsTable(table)


KEY_PART = "key_part"
KEYS_A_PART = 10_000_000
MOST_PARTS = 10_000
_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def _stored(spark: SparkSession, table: str) -> DataFrame:
    spark.catalog.refreshTable(table)
    return spark.table(table)


def fresh_table(spark: SparkSession, table: str) -> DataFrame:
    """The table as it is now, also where another session (as a stream has) wrote to it."""
    return _stored(spark, table).drop(KEY_PART)


def _in_parts(df: DataFrame, key: str, keys_a_part: int) -> DataFrame:
    """With the directory of each row: ranges of a numeric key, 256 hash classes of any other; NULL without key."""
    numeric = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    part = f"`{key}` div {keys_a_part}" if numeric else f"pmod(xxhash64(`{key}`), 256)"
    return df.withColumn(KEY_PART, F.expr(f"if(`{key}` IS NULL, NULL, cast({part} as bigint))"))


def rows_to_append(df: DataFrame, table: str, key: str, newest: str | None = None,
                   keys_a_part: int = KEYS_A_PART) -> DataFrame:
    """The rows that :func:`append_new` adds, with their directories.

    Only directories that the batch has keys for are read (all of them where it has keys for more than
    MOST_PARTS), and of those only the key.
    """
    spark = df.sparkSession
    df = _in_parts(df, key, keys_a_part)
    columns = [c for c in df.columns if c != newest]
    ties = F.xxhash64(*columns)
    # a row without a key stands for itself, so one pass over the batch does for both kinds
    itself = F.when(F.col(key).isNull(), F.struct(*columns))
    rows = latest_by(df.withColumn("_tie", ties).withColumn("_itself", itself), [key, "_itself"],
                     [newest] if newest else [], ["_tie"]).select(columns)
    if not spark.catalog.tableExists(table):
        return rows
    keyed, keyless = rows.where(F.col(key).isNotNull()), rows.where(F.col(key).isNull())
    there = _stored(spark, table)
    parts = [r[0] for r in keyed.select(KEY_PART).distinct().limit(MOST_PARTS + 1).collect()]
    known = there.where(F.col(KEY_PART).isin(parts)) if len(parts) <= MOST_PARTS else there
    keyed = keyed.join(known.select(key), key, "left_anti").select(columns)
    return keyed.unionByName(keyless.subtract(there.where(F.col(KEY_PART).isNull()).select(columns)))


def append_new(df: DataFrame, table: str, key: str, newest: str | None = None,
               bucket_by: str | None = None, keys_a_part: int = KEYS_A_PART) -> None:
    """Append the rows whose ``key`` the table doesn't hold yet, one for each key.

    Doing it again with the same rows, or with rows resent later, adds nothing: the
    table itself remembers what has arrived, however long ago.  Of several rows of a
    batch with one key the newest by the column ``newest`` is taken (which is not stored; then, and without
    it, the greatest by a hash of the row); a key that the table holds keeps its row.  Rows without a key are
    told apart by all their columns.

    The table has a directory for each range of ``keys_a_part`` keys, so a batch costs what its own ranges hold and not
    what the table holds.  ``bucket_by`` also deals the rows of a directory into buckets of a column, as many
    as shuffles have tasks when the table is made; joins and groups by that column then need no exchange.
    """
    spark = df.sparkSession
    rows = rows_to_append(df, table, key, newest, keys_a_part)
    if bucket_by and spark.catalog.tableExists(table):
        buckets = buckets_of(spark, table)
    else:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) if bucket_by else 0
    if buckets:
        rows = rows.repartition(buckets, bucket_by)  # one file for each bucket and directory
    write = rows.write.mode("append").partitionBy(KEY_PART)
    (write.bucketBy(buckets, bucket_by) if buckets else write).saveAsTable(table)


def buckets_of(spark: SparkSession, table: str) -> int:
    """Number of buckets of a table, 0 if it has none."""
    described = spark.sql(f"DESCRIBE EXTENDED `{table}`").where("col_name = 'Num Buckets'").first()
    return int(described.data_type) if described else 0


def bucketed_rows(spark: SparkSession, table: str, key: str, most_rows: int = 500_000, most_share: int = 4) -> DataFrame:
    """The rows of a table bucketed by ``key``, read so that no task has far more than the others.

    A bucket is read by one task.  Where one has more than ``most_rows`` rows and ``most_share`` times its share, as with a
    hot key, the files are read in splits instead; joins and groups then shuffle, after combining in the scan's tasks.
    """
    buckets, df = buckets_of(spark, table), fresh_table(spark, table)
    if not buckets:
        return df
    sizes = [r["count"] for r in df.groupBy(F.pmod(F.hash(key), F.lit(buckets))).count().collect()]
    if max(sizes, default=0) <= max(most_rows, most_share * sum(sizes) / buckets):
        return df
    return _in_splits(spark, table).drop(KEY_PART)


def _in_splits(spark: SparkSession, table: str) -> DataFrame:
    """The table's rows by splits of its files, not by buckets."""
    described = spark.sql(f"DESCRIBE EXTENDED `{table}`").where("col_name = 'Location'").first()
    return spark.read.schema(_stored(spark, table).schema).parquet(described.data_type)


def class_of(key: str, classes: int) -> Column:
    """Class of a row by its key: the bucket that a table bucketed by ``key`` alone has it in."""
    return F.pmod(F.hash(key), F.lit(classes))


def rows_in_classes(spark: SparkSession, table: str, key: str, classes: int, wanted: list[int]) -> DataFrame:
    """The rows whose key is in one of the ``wanted`` classes.

    Where the table is bucketed by ``key`` into as many buckets, only the files of those buckets are opened: a bucket's
    number stands in its files' names, and Spark prunes files by a condition on their names.  The files are read in splits, so a hot key's bucket is no single task's.
    """
    rows = _stored(spark, table)
    if buckets_of(spark, table) == classes:
        rows = _in_splits(spark, table)
        number = F.regexp_extract("_metadata.file_name", r"_(\d+)(\.[^_]*)?$", 1)
        rows = rows.where(number.cast("int").isin(wanted))
    return rows.where(class_of(key, classes).isin(wanted)).drop(KEY_PART)


def replace_parts(df: DataFrame, table: str, part: str, wanted: list[int]) -> None:
    """Let ``df`` be the content of the ``wanted`` directories of a table partitioned by ``part``; the others keep their files.

    ``df`` may read the table: its rows are written aside first.  A large directory is split
    over several files and tasks.  Doing it again with the same rows changes nothing.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "parts")
    df.write.parquet(path)
    aside = spark.read.schema(df.schema).parquet(path).select(spark.table(table).columns)
    filled = {r[0] for r in aside.select(part).distinct().collect()}
    if not filled <= set(wanted):
        raise ValueError(f"rows outside the directories to be replaced: {sorted(filled - set(wanted))[:5]}")
    _overwrite_parts(aside.hint("rebalance", F.col(part)), table)
    for empty in sorted(set(wanted) - filled):  # an overwrite leaves directories alone that get no row
        spark.sql(f"ALTER TABLE `{table}` DROP IF EXISTS PARTITION (`{part}` = {empty})")
    spark.catalog.refreshTable(table)


def _overwrite_parts(df: DataFrame, table: str) -> None:
    """Replace the directories that ``df`` has rows for; it has the table's columns in their order."""
    spark = df.sparkSession
    before = spark.conf.get(_OVERWRITE)
    spark.conf.set(_OVERWRITE, "dynamic")  # the writer has no option of its own for tables
    try:
        df.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(_OVERWRITE, before)


def mark_stored(ids: DataFrame, table: str, key: str, day: str, mark: str = "processed") -> list:
    """Set ``mark`` for the rows of a stored table whose ``key`` is in ``ids``; returns the days written.

    The table is partitioned by ``mark`` and ``day``, so unprocessed rows are read without the others, and only the
    directories of days that hold such a row are written; all others keep their files.  Rows without a mark count as
    unmarked, rows without a day have a directory of their own, rows without a key are never marked.  Doing it again
    changes nothing.  A run that died may leave rows in both directories of a day: any later run that writes the day takes
    an unmarked row that equals a marked one for its leftover.  One run at a time may mark a table.
    """
    spark = ids.sparkSession
    rows = _stored(spark, table)
    marked, unmarked = F.col(mark), ~F.coalesce(mark, F.lit(False))
    wanted = ids.select(key).distinct()
    days = [r[0] for r in rows.where(unmarked).join(wanted, key, "left_semi").select(day).distinct().collect()]
    if not days:
        return []
    here = F.col(day).isin([d for d in days if d is not None]) | (F.col(day).isNull() & F.lit(None in days))
    columns = rows.columns
    done, left = rows.where(marked & here), rows.where(unmarked & here)
    same = reduce(and_, [F.col(f"l.{c}").eqNullSafe(F.col(f"d.{c}")) for c in columns if c != mark])
    left = left.alias("l").join(done.alias("d"), same, "left_anti")
    hits = wanted.withColumn("_hit", F.lit(True))
    left = left.join(hits, key, "left").withColumn(mark, F.coalesce("_hit", mark))
    path = scratch_path(spark, "marks")
    done.unionByName(left.select(columns)).select(columns).write.parquet(path)
    aside = spark.read.schema(rows.schema).parquet(path).select(columns)
    _overwrite_parts(aside.hint("rebalance", F.col(mark), F.col(day)), table)
    filled = {(r[0], r[1]) for r in aside.where(unmarked).select(mark, day).distinct().collect()}
    for value in (False, None):
        for empty in (d for d in days if (value, d) not in filled):
            spec = ", ".join(f"`{c}` = {'NULL' if v is None else repr(str(v).lower())}" for c, v in ((mark, value), (day, empty)))
            spark.sql(f"ALTER TABLE `{table}` DROP IF EXISTS PARTITION ({spec})")
    spark.catalog.refreshTable(table)
    return sorted(days, key=str)


def materialize(df: DataFrame, table: str, cluster_by: str | None = None,
                partition_by: str | None = None) -> DataFrame:
    """Create or replace ``table`` from ``df`` and return it as read back.

    The returned frame starts a new lineage at the stored files, so a lost
    executor costs a re-read, not a recomputation.  ``cluster_by`` range
    partitions the files on a column later filters use; ``partition_by`` gives each value of a column a directory.
    """
    if cluster_by:
        df = sorted_by(df, [cluster_by])
    write = df.write.mode("overwrite")
    (write.partitionBy(partition_by) if partition_by else write).saveAsTable(table)
    return df.sparkSession.table(table)


VERSION = "__v"


def versions(spark: SparkSession, name: str) -> list[str]:
    """Stored versions of a published name, oldest first."""
    start = f"{name}{VERSION}".lower()
    return sorted(t.name for t in spark.catalog.listTables() if t.name.lower().startswith(start) and t.tableType != "VIEW")


def sorted_by(df: DataFrame, columns: list[str]) -> DataFrame:
    """Range partitioned and sorted, so that files and row groups hold few values of the first columns.

    A value that many rows share is split by the columns after it; let the last be a key.  The ranges are found by a pass
    over the rows before the one that deals them out, so the rows are written aside first and computed once.
    """
    path = scratch_path(df.sparkSession, "unsorted")
    df.write.parquet(path)
    df = df.sparkSession.read.schema(df.schema).parquet(path)
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def publish(df: DataFrame, name: str, kept: int = 2, cluster_by: list[str] | None = None) -> DataFrame:
    """Let the view ``name`` show the rows of ``df`` from one moment to the next, and return them as read back.

    The rows are written as a table of their own, then the view is switched to it: readers see the old rows or the new ones,
    never none, and a write that fails leaves the old ones.  A version stays until ``kept`` younger ones are there
    (the shown one among them), so a query that began before a switch can end.  ``df`` may read ``name``.  Each write has a
    name of its own, so files that a lost driver left behind are in nobody's way.  A plain table of that name gives way
    to the view once.  One run at a time may publish a name.  ``cluster_by`` sorts the files by columns that filters use.
    """
    spark = df.sparkSession
    if cluster_by:
        df = sorted_by(df, cluster_by)
    old = versions(spark, name)
    last = int(old[-1].lower().rsplit(VERSION, 1)[1].split("_")[0]) if old else 0
    table = f"{name}{VERSION}{last + 1:010d}_{uuid.uuid4().hex[:8]}"
    try:
        df.write.saveAsTable(table)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS `{table}`")
        raise
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
        spark.sql(f"DROP TABLE `{name}`")
    spark.sql(f"CREATE OR REPLACE VIEW `{name}` AS SELECT * FROM `{table}`")
    for gone in [*old, table][:-kept]:
        spark.sql(f"DROP TABLE IF EXISTS `{gone}`")
    return spark.table(name)


def replace_rows(df: DataFrame, table: str, stamp: str = "generated_at") -> DataFrame:
    """Replace the rows shown as ``table`` with ``df`` plus a load timestamp, in one step; see :func:`publish`."""
    return publish(df.withColumn(stamp, F.current_timestamp()), table)


def query_table(spark: SparkSession, table: str, where: Column | None = None,
                limit: int | None = None) -> DataFrame:
    """Filtered read; with a limit, of some ``limit`` rows in no order."""
    df = spark.table(table)
    if where is not None:
        df = df.where(where)
    return df if limit is None else df.limit(limit)
