"""Published names: readers see old or new rows, a failed write leaves the old ones."""

import uuid

import pytest
from pyspark.sql import functions as F

from fleetlens.plans import medallion
from fleetlens.sources import sinks


@pytest.fixture()
def name(spark):
    prefix = f"pub{uuid.uuid4().hex}_"
    yield f"{prefix}gold"
    medallion.drop_tables(spark, prefix)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(prefix)]


def values(df):
    return sorted(r[0] for r in df.select("x").collect())


def test_a_switch_shows_old_or_new_rows(spark, name):
    assert values(sinks.publish(spark.range(3).toDF("x"), name)) == [0, 1, 2]
    began = spark.table(name)
    assert values(sinks.publish(spark.range(5, 7).toDF("x"), name)) == [5, 6]
    assert values(began) == [0, 1, 2]  # planned before the switch
    assert values(spark.table(name)) == values(spark.newSession().table(name)) == [5, 6]
    doubled = sinks.publish(spark.table(name).select((F.col("x") * 2).alias("x")), name)  # reads what it replaces
    assert values(doubled) == [10, 12] and len(sinks.versions(spark, name)) == 2


def test_a_failed_write_leaves_the_old_rows(spark, name):
    sinks.publish(spark.range(3).toDF("x"), name)
    with pytest.raises(Exception, match="no number"):
        sinks.publish(spark.range(4).select(F.raise_error(F.lit("no number")).cast("long").alias("x")), name)
    assert values(spark.table(name)) == [0, 1, 2] and len(sinks.versions(spark, name)) == 1
    assert values(sinks.publish(spark.range(1).toDF("x"), name)) == [0]


def test_columns_may_change_and_a_plain_table_gives_way(spark, name):
    spark.range(2).toDF("x").write.saveAsTable(name)
    assert values(sinks.publish(spark.range(4).toDF("x"), name)) == [0, 1, 2, 3]
    stamped = sinks.replace_rows(spark.range(1).toDF("x"), name)
    assert stamped.columns == ["x", "generated_at"] and stamped.where("generated_at IS NULL").count() == 0


def test_many_versions_keep_their_order(spark, name):
    for k in range(4):
        sinks.publish(spark.range(k, k + 1).toDF("x"), name, kept=1)
        assert values(spark.table(name)) == [k] and len(sinks.versions(spark, name)) == 1
