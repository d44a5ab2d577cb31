"""Marks in a stored table, and filtered reads of sorted tables: untouched directories keep their files, others are skipped."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from fleetlens.plans import lookups, medallion
from fleetlens.sources import sinks

SCHEMA = "x int, id string, processed boolean, day date"
DAYS = [None, *(dt.date(2024, 1, k) for k in range(1, 6))]


@pytest.fixture()
def prefix(spark):
    name = f"marks{uuid.uuid4().hex}_"
    yield name
    medallion.drop_tables(spark, name)


def stored(spark, name, rows):
    spark.createDataFrame(rows, SCHEMA).write.partitionBy("processed", "day").saveAsTable(name)


def content(spark, name):
    return sorted(map(str, spark.table(name).select("x", "id", "processed", "day").collect()))


def files(spark, name):
    return {r[0]: (r[1], r[2]) for r in spark.table(name).select(
        F.col("_metadata.file_path"), "processed", "day").distinct().collect()}


def expected(rows, ids):
    return sorted(f"Row(x={x}, id={i!r}, processed={True if i in ids and i is not None else p}, day={d!r})" for x, i, p, d in rows)


@pytest.mark.parametrize("seed", range(3))
def test_marks_equal_plain_python_and_repeat(spark, prefix, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 2), f"C{k}", rng.choice([True, False, False, None]), rng.choice(DAYS)) for k in range(60)]
    rows += [(1, None, False, DAYS[1]), (1, None, None, None)]
    stored(spark, f"{prefix}t", rows)
    for ids in ([], ["none"], [f"C{k}" for k in range(0, 60, 3)], [f"C{k}" for k in range(60)]):
        taken = spark.createDataFrame([(i,) for i in [*ids, *ids[:2], None]], "id string")
        sinks.mark_stored(taken, f"{prefix}t", "id", "day")
        rows = [(x, i, True if i in ids else p, d) for x, i, p, d in rows]
        assert content(spark, f"{prefix}t") == expected(rows, [])
        assert sinks.mark_stored(taken, f"{prefix}t", "id", "day") == []
        assert content(spark, f"{prefix}t") == expected(rows, [])


def test_only_days_with_marked_rows_are_written(spark, prefix):
    rows = [(1, f"C{k}", k % 4 == 0, DAYS[1 + k % 5]) for k in range(100)]
    stored(spark, f"{prefix}t", rows)
    before = files(spark, f"{prefix}t")
    assert sinks.mark_stored(spark.createDataFrame([("C1",), ("C6",)], "id string"), f"{prefix}t", "id", "day") == [DAYS[2]]
    after = files(spark, f"{prefix}t")
    kept = {f for f, (_, day) in before.items() if day != DAYS[2]}
    assert kept == {f for f, (_, day) in after.items() if day != DAYS[2]} and len(kept) >= 8
    assert content(spark, f"{prefix}t") == expected(rows, ["C1", "C6"])


def test_a_run_that_died_leaves_no_row_twice(spark, prefix):
    rows = [(1, "a", False, DAYS[1]), (1, "a", True, DAYS[1]), (1, "b", False, DAYS[1]), (2, "c", False, DAYS[1])]
    stored(spark, f"{prefix}t", rows)  # "a" was marked, but its unmarked row not yet taken away
    sinks.mark_stored(spark.createDataFrame([("a",), ("b",)], "id string"), f"{prefix}t", "id", "day")
    assert content(spark, f"{prefix}t") == expected(
        [(1, "a", True, DAYS[1]), (1, "b", True, DAYS[1]), (2, "c", False, DAYS[1])], [])


def test_unprocessed_rows_are_read_without_the_others(spark, prefix):
    stored(spark, f"{prefix}t", [(1, f"C{k}", k % 2 == 0, DAYS[1]) for k in range(10)])
    plan = spark.table(f"{prefix}t").where("not processed")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(processed" in plan and "PushedFilters: []" in plan


def test_a_filtered_read_meets_few_files(spark, prefix):
    rows = spark.range(40_000).select(
        F.concat(F.lit("Cat "), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 16).cast("string")).alias("complaint_category"),
        F.concat(F.lit("Issue "), (F.col("id") % 7).cast("string")).alias("specific_issue"), F.col("id").alias("complaint_id"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small partitions would be put together
    try:
        sinks.publish(rows.repartition(8), f"{prefix}gold_complaint_detail",
                      cluster_by=["complaint_category", "specific_issue", "complaint_id"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)

    def read(df):
        return df.select(F.col("_metadata.file_path")).distinct().count()

    table = spark.table(sinks.versions(spark, f"{prefix}gold_complaint_detail")[-1])
    assert read(table) == 4
    assert read(table.where("complaint_category = 'Cat 9'")) <= 2  # one value of nine
    assert read(table.where("complaint_category = 'Cat 0'")) >= 2  # half of all rows is no single file
    found = lookups.complaints_of(spark, "Cat 9", "Issue 2", prefix=prefix)
    assert found.count() == rows.where("id % 16 = 9 and id % 7 = 2").count() > 0
    assert "EqualTo(complaint_category,Cat 9)" in found._jdf.queryExecution().executedPlan().toString()
