"""Incremental silver: equal to a full run, reading and replacing only the buckets of vehicles with new rows."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from fleetlens.plans import medallion
from fleetlens.sources import sinks

DAY = dt.date(2024, 1, 1)
FEEDS = {
    "complaints": "complaint_id string, vehicle_id string, customer_id string, complaint_date date, "
                  "complaint_category string, description string, processed boolean",
    "inspections": "inspection_id string, vehicle_id string, checklist_item string, status string, "
                   "inspection_date date, notes string, processed boolean",
    "deliveries": "delivery_id string, vehicle_id string, dealer_id string, delivery_date date, "
                  "delivery_condition string, processed boolean"}


def rows(rng, ids, vehicle):
    def day():
        return rng.choice([None, *(DAY + dt.timedelta(days=k) for k in range(6))])

    return {
        "complaints": [(f"C{k}", vehicle(), "x", day(), rng.choice(["Paint", "Brakes"]), "noise", False) for k in ids],
        "inspections": [(f"I{k}", vehicle(), rng.choice(["Seats", "Paint"]), rng.choice(["Fail", "Pass"]), day(), None, False)
                        for k in ids],
        "deliveries": [(f"D{k}", vehicle(), f"D{k % 3}", day(), "Good", False) for k in ids]}


def staged(spark, *parts):
    return {name: spark.createDataFrame([r for p in parts for r in p[name]], schema) for name, schema in FEEDS.items()}


def found(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def files(spark, table):
    spark.catalog.refreshTable(table)
    return {(f.split(f"{medallion.VEHICLE_PART}=")[1].split("/")[0], f) for f in spark.table(table).inputFiles()}


@pytest.fixture()
def prefixes(spark):
    names = [f"inc{k}_{uuid.uuid4().hex}_" for k in "ab"]
    buckets = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield names
    spark.conf.set("spark.sql.shuffle.partitions", buckets)
    for name in names:
        medallion.drop_tables(spark, name)


def test_an_increment_equals_a_full_run_and_touches_only_its_buckets(spark, prefixes):
    one, full = prefixes
    rng = random.Random(3)
    vehicles = ["hot", "hot", None, *(f"v{k}" for k in range(30))]
    old = rows(rng, range(200), lambda: rng.choice(vehicles))
    new = rows(rng, range(200, 203), lambda: rng.choice(["v1", "new"]))
    medallion.run_bronze(staged(spark, old), one)
    medallion.run_silver(spark, one)
    tables = [f"{one}silver_complaint_{n}" for n in ("links", "correlation")]
    before = [files(spark, t) for t in tables]
    touched = medallion.run_increment(spark, staged(spark, old, new), one)
    classes = spark.createDataFrame([("v1",), ("new",)], "vehicle_id string").select(
        sinks.class_of("vehicle_id", 8)).distinct().collect()
    assert touched and set(touched) <= {r[0] for r in classes} and len(touched) < 8

    medallion.run_bronze(staged(spark, old, new), full)
    medallion.run_silver(spark, full)
    for name in ("complaint_links", "complaint_correlation"):
        assert found(medallion.silver_table(spark, name, one)) == found(medallion.silver_table(spark, name, full))
    for table, had in zip(tables, before):
        assert {p for p, _ in had ^ files(spark, table)} <= {str(k) for k in touched}

    after = [files(spark, t) for t in tables]
    assert medallion.run_increment(spark, staged(spark, old, new), one) == []
    assert [files(spark, t) for t in tables] == after


def test_a_run_that_died_before_silver_is_made_good(spark, prefixes, monkeypatch):
    one, full = prefixes
    rng = random.Random(5)
    old = rows(rng, range(60), lambda: rng.choice(["a", "b", "c"]))
    new = rows(rng, range(60, 64), lambda: "b")
    medallion.run_bronze(staged(spark, old), one)
    medallion.run_silver(spark, one)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(medallion, "replace_parts", dies)
        with pytest.raises(RuntimeError):
            medallion.run_increment(spark, staged(spark, old, new), one)
    assert medallion.run_increment(spark, staged(spark, old, new), one)
    medallion.run_bronze(staged(spark, old, new), full)
    medallion.run_silver(spark, full)
    assert found(medallion.silver_table(spark, "complaint_links", one)) == found(
        medallion.silver_table(spark, "complaint_links", full))


def test_only_touched_buckets_are_opened(spark, prefixes):
    one = prefixes[0]
    rng = random.Random(9)
    medallion.run_bronze(staged(spark, rows(rng, range(300), lambda: f"v{rng.randrange(60)}")), one)
    table = f"{one}bronze_complaints"
    assert sinks.buckets_of(spark, table) == 8
    df = sinks.rows_in_classes(spark, table, "vehicle_id", 8, [2, 5])
    want = spark.table(table).drop(sinks.KEY_PART).where(F.pmod(F.hash("vehicle_id"), F.lit(8)).isin(2, 5))
    assert found(df) == found(want) != []
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    scan = plan.collectLeaves().head()
    assert scan.metrics().get("numFiles").get().value() <= 2 < len(spark.table(table).inputFiles())


def test_a_directory_without_rows_is_emptied(spark):
    table = f"parts_{uuid.uuid4().hex}"
    try:
        sinks.materialize(spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "x int, part int"), table, partition_by="part")
        sinks.replace_parts(spark.createDataFrame([(5, 0)], "x int, part int"), table, "part", [0, 1])
        assert found(spark.table(table)) == ["Row(part=0, x=5)", "Row(part=2, x=3)"]
        with pytest.raises(ValueError):
            sinks.replace_parts(spark.createDataFrame([(5, 2)], "x int, part int"), table, "part", [0])
        assert spark.table(table).count() == 2
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
