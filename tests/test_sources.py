"""Bronze rules, CSV, tables, ids, answer parsing and the stored pipeline."""

import datetime as dt
import gzip
import re
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import session
from fleetlens.operators import dashboard, ids, rollups, topn
from fleetlens.plans import medallion
from fleetlens.sources import csv_files, sinks, staging
from fleetlens.sources import star_schema as src


def test_bronze_constants_and_ids(spark):
    df = spark.createDataFrame(
        [("IN-12", "v", "Seats", "Pass", dt.date(2024, 1, 1), None),
         ("none", "v", "Seats", "Pass", dt.date(2024, 1, 1), None)],
        "inspection_id string, vehicle_id string, checklist_item string, status string, "
        "inspection_date date, notes string")
    out = staging.to_bronze_inspections(df)
    assert out.columns == staging.BRONZE_INSPECTIONS.names
    assert [(r.inspection_id, r.dealer_id) for r in out.collect()] == [
        (12, "DLR-000"), (None, "DLR-000")]
    ints = spark.createDataFrame([(5, "v", "d", dt.date(2024, 1, 1), "Good")],
                                 "delivery_id int, vehicle_id string, dealer_id string, "
                                 "delivery_date date, delivery_condition string")
    row = staging.to_bronze_deliveries(ints).first()
    assert (row.delivery_id, row.customer_signature) == (5, "Signed via ePOD App")


def test_mark_processed_is_idempotent(spark):
    staged = spark.createDataFrame([("a", False, 1), ("b", True, 2), ("c", False, 3)],
                                   "id string, processed boolean, x int")
    taken = spark.createDataFrame([("a",), ("a",), ("zz",)], "id string")
    once = staging.mark_processed(staged, taken, "id")
    assert sorted(map(tuple, once.collect())) == [("a", True, 1), ("b", True, 2), ("c", False, 3)]
    assert staging.mark_processed(once, taken, "id").exceptAll(once).count() == 0
    assert staging.read_unprocessed(once, ["id"]).collect()[0].id == "c"


def test_csv_blank_is_null(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,name,n\n1,"a, b",2\n2,,\n3,"",4\n')
    schema = T.StructType([T.StructField("id", T.IntegerType()),
                           T.StructField("name", T.StringType()),
                           T.StructField("n", T.IntegerType())])
    rows = sorted(map(tuple, csv_files.load_csv(spark, str(tmp_path), schema).collect()))
    assert rows == [(1, "a, b", 2), (2, None, None), (3, None, 4)]
    whole = csv_files.load_csv(spark, str(tmp_path), schema, multi_line=True)
    assert sorted(map(tuple, whole.collect())) == rows
    (tmp_path / "y.csv").write_text('id,name,n\n4,"two\nlines ""quoted""",5\n')
    both = csv_files.load_csv(spark, str(tmp_path), schema, multi_line=True).where("id = 4").first()
    assert tuple(both) == (4, 'two\nlines "quoted"', 5)


CARS = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.IntegerType()),
                     T.StructField("d", T.DateType()), T.StructField("b", T.StringType())])


def test_csv_columns_are_bound_by_their_header(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("b,n,a,d\nB1,1,A1,2024-01-31\n")
    (tmp_path / "in" / "2.csv").write_text('n,"a",extra, d\n2,"A,2",x,\n,,y,2024-02-01\n')
    with gzip.open(tmp_path / "in" / "3.csv.gz", "wt") as out:
        out.write("\ufeffa,b\nA3,B3\n")
    (tmp_path / "in" / "4.csv").write_text("")
    (tmp_path / "in" / "5.csv").write_text("a,b,n,d\n")
    rows = sorted(map(tuple, csv_files.load_csv(spark, str(tmp_path / "in"), CARS).collect()), key=str)
    day = dt.date
    assert rows == sorted([("A1", 1, day(2024, 1, 31), "B1"), ("A,2", 2, None, None), (None, None, day(2024, 2, 1), None),
                           ("A3", None, None, "B3")], key=str)
    assert csv_files.csv_rejects(spark, str(tmp_path / "in"), CARS).collect() == []


def test_csv_lines_are_accepted_or_rejected(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text(
        "d,n,a,b\n2024-01-01,1,ok,ok\n2024-13-01,1,bad,day\n2024-01-01,oops,bad,number\nno,1.5,bad,both\n"
        "2024-01-01,1,short\n2024-01-01,1,long,line,more\n2024-01-01,99999999999,too,big\n, 7 ,blanks,ok\n\n")
    good = csv_files.load_csv(spark, str(tmp_path / "in"), CARS)
    assert sorted((r.a, r.n) for r in good.collect()) == [("blanks", 7), ("ok", 1)]
    assert good.where("n = 7").select("a").first().a == "blanks" and good.select("a").count() == 2
    table, rejects = csv_files.load_table(spark, str(tmp_path / "in"), CARS, "t_csv")
    found = {r.record: r.reason for r in rejects.collect()}
    wrong = "no value of the column's type: "
    assert found == {
        "2024-13-01,1,bad,day": wrong + "d", "2024-01-01,oops,bad,number": wrong + "n", "no,1.5,bad,both": wrong + "n, d",
        "2024-01-01,1,short": "not 4 fields", "2024-01-01,1,long,line,more": "not 4 fields",
        "2024-01-01,99999999999,too,big": wrong + "n"}
    assert rejects.where("file LIKE '%x.csv'").count() == 6 and table.count() + rejects.count() == 8
    assert table.columns == CARS.names and rejects.columns == csv_files.REJECT_COLUMNS


def test_csv_without_files_or_with_a_bad_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("")
    empty = csv_files.load_csv(spark, str(tmp_path), CARS)
    assert empty.columns == CARS.names and empty.collect() == []
    (tmp_path / "y.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError, match="repeated"):
        csv_files.load_csv(spark, str(tmp_path), CARS)


@pytest.fixture()
def growing(spark):
    name = f"grow_{uuid.uuid4().hex}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def files_read(df):
    """Files that a scan of the table takes, after its partition filters."""
    node = df._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().apply(0)
    df.collect()
    return node.metrics().apply("numFiles").value()


def test_append_reads_only_the_parts_it_has_keys_for(spark, growing):
    def batch(lo, hi, tag):
        return spark.range(lo, hi).select("id", F.concat(F.lit(tag), (F.col("id") % 3).cast("string")).alias("v"))

    read = []
    for k in range(4):
        new = batch(100 * k, 100 * k + 60, "a").unionByName(batch(100 * k, 100 * k + 10, "b"))
        sinks.append_new(new, growing, "id", bucket_by="v", keys_a_part=100)
        again = sinks.rows_to_append(batch(100 * k + 50, 100 * k + 70, "c"), growing, "id", keys_a_part=100)
        assert again.count() == 10
        known = sinks._stored(spark, growing).where(F.col(sinks.KEY_PART).isin([k])).select("id")
        read.append(files_read(known))
        text = again._jdf.queryExecution().optimizedPlan().toString()
        assert f"{sinks.KEY_PART}" in text and re.search(r"key_part#\d+L? (=|IN)", text)
    assert max(read) <= 2 * min(read) and max(read) <= 8  # not with the table
    assert sinks.fresh_table(spark, growing).columns == ["id", "v"]
    assert sinks.fresh_table(spark, growing).count() == 240


def test_of_versions_in_a_batch_the_newest_is_kept(spark, growing):
    rows = [(1, "old", 1), (1, "new", 3), (1, "mid", 2), (2, "only", None), (2, "timed", 0), (3, "x", 5), (3, "y", 5),
            (None, "n", 1), (None, "n", 2)]
    df = spark.createDataFrame(rows, "k long, v string, at long").repartition(3)
    sinks.append_new(df, growing, "k", newest="at")
    got = sorted(map(tuple, sinks.fresh_table(spark, growing).collect()), key=str)
    tie = got[2][1]
    assert got == [(1, "new"), (2, "timed"), (3, tie), (None, "n")] and tie in "xy"
    sinks.append_new(df.where("v = 'old'").withColumn("at", F.lit(9)), growing, "k", newest="at")
    sinks.append_new(df, growing, "k", newest="at")
    assert sorted(map(tuple, sinks.fresh_table(spark, growing).collect()), key=str) == got


def test_the_first_batch_is_read_once(spark, growing):
    batch = spark.range(20).select(F.when(F.col("id") > 5, F.col("id")).alias("k"), (F.col("id") % 2).alias("v"))
    rows = sinks.rows_to_append(batch, growing, "k")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert sorted((r.k, r.v) for r in rows.collect() if r.k) == [(n, n % 2) for n in range(6, 20)]
    assert sorted(r.v for r in rows.collect() if r.k is None) == [0, 1]


def test_sorted_rows_are_computed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(n):
        calls.add(1)
        return n % 7

    df = spark.range(100).select("id", F.udf(counted, "long")("id").alias("v"))
    assert [(r.v, r.id) for r in sinks.sorted_by(df, ["v", "id"]).collect()] == sorted((n % 7, n) for n in range(100))
    assert calls.value == 100


def test_keys_of_any_type_have_a_part(spark, growing):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "k string, v int")
    for _ in range(2):
        sinks.append_new(df, growing, "k")
    assert sorted(map(tuple, sinks.fresh_table(spark, growing).collect())) == [("a", 1), ("b", 2)]


def test_a_hot_key_is_read_in_splits(spark, growing):
    df = spark.range(400).select("id", F.when(F.col("id") < 300, "hot").otherwise(F.col("id").cast("string")).alias("v"))
    sinks.append_new(df, growing, "id", bucket_by="v")
    even, hot = (sinks.bucketed_rows(spark, growing, "v", n, 2) for n in (1000, 100))
    for rows, exchanges in ((even, 0), (hot, 1)):
        counts = rows.groupBy("v").count()
        assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == exchanges
        assert counts.where("v = 'hot'").first()["count"] == 300 and counts.count() == 101


def test_jdbc_options():
    plain = staging.jdbc_options("jdbc:x", "t")
    assert plain == {"url": "jdbc:x", "dbtable": "t", "fetchsize": "10000"}
    split = staging.jdbc_options("jdbc:x", "t", "id", (1, 100), 4)
    assert (split["partitionColumn"], split["upperBound"], split["numPartitions"]) == (
        "id", "100", "4")
    with pytest.raises(ValueError):
        staging.jdbc_options("jdbc:x", "t", "id")


def test_table_sinks(spark):
    df = spark.range(3).withColumn("name", F.lit("x"))
    sinks.materialize(df, "t_sink")
    sinks.append(df, "t_sink")
    assert spark.table("t_sink").count() == 6
    assert sinks.materialize(df, "t_sink", cluster_by="id").count() == 3
    first = sinks.replace_rows(df, "t_rows").first()
    assert first.generated_at is not None
    assert sinks.replace_rows(df.limit(1), "t_rows").count() == 1
    assert sinks.query_table(spark, "t_sink", F.col("id") > 0, 1).count() == 1
    assert sinks.query_table(spark, "t_sink").count() == 3


def test_ids_are_dense_and_follow_the_maximum(spark):
    new = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    old = spark.createDataFrame([(7,), (40,), (None,)], "id long")
    out = ids.assign_ids(new, old, "key", hex_digits=2)
    assert sorted(r.new_id for r in out.collect()) == list(range(41, 5041))
    again = {r.key: r.new_id for r in out.repartition(7).collect()}
    assert again == {r.key: r.new_id for r in out.collect()}
    first = ids.assign_ids(new.limit(3), old.limit(0), "key")
    assert sorted(r.new_id for r in first.collect()) == [1, 2, 3]


@pytest.mark.parametrize("answer, want", [
    ('{"category": "A", "subcategory": "B", "confidence": 0.5}', ("A", "B", 0.5)),
    ('```json\n{"category": "A"}\n```', ("A", "", 0.0)),
    ('text ```{"category": "A", "confidence": 1}``` more ```x```', ("A", "", 1.0)),
    ("{'category': 'A'}", ("Unknown", "Unclassified", 0.0)),
    ('{"category": "A"} and more', ("Unknown", "Unclassified", 0.0)),
    ('{"category": "A"} {"category": "B"}', ("Unknown", "Unclassified", 0.0)),
    ('{"category": "A"}, {"category": "B"}', ("Unknown", "Unclassified", 0.0)),
    ('{"category": "A", "confidence": "0.7"}', ("A", "", 0.7)),
    ('["A"]', ("Unknown", "Unclassified", 0.0)),
    ('{"subcategory": "B"}', ("Unknown", "Unclassified", 0.0)),
    ("", ("Unknown", "Unclassified", 0.0)),
    (None, ("Unknown", "Unclassified", 0.0)),
])
def test_answers(spark, answer, want):
    df = spark.createDataFrame([(1, answer)], "id int, answer string")
    row = staging.parse_classification(df).first()
    assert (row.category, row.subcategory, row.confidence) == want


def test_rank_latest_and_top(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", None, 4)],
                               "k string, d int, i int")
    assert sorted(map(tuple, topn.latest_by(df, ["k"], ["d"], ["i"]).collect())) == [
        ("a", 2, 3), ("b", None, 4)]
    top = topn.top_n(df, [F.desc("i")], 2, F.col("k") == "a")
    assert [r.i for r in top.collect()] == [3, 2]


def test_recommendation_answers_replace_actions(spark):
    recs = spark.createDataFrame(
        [("X", 5, 1, None, "NONE", "s", "do x", 2), ("Y", 9, 0, 0.0, "NONE", "s", "do y", 1)],
        "what_customers_complain_about string, total_complaints long, caught_by_inspection long, "
        "pct_caught_by_inspection double, current_checklist_item string, checklist_status string, "
        "specific_action_required string, priority int")
    answers = spark.createDataFrame([("X", "better")],
                                    "what_customers_complain_about string, ai_recommendation string")
    rows = dashboard.enhanced_recommendations(recs, answers).collect()
    got = {r.what_customers_complain_about: (r.ai_recommendation, r.gap_pct, r.priority)
           for r in rows}
    assert got == {"X": ("better", 100.0, 2), "Y": ("do y", 100.0, 1)}


def test_risk_map(spark):
    counts = spark.createDataFrame([("Normal", 2), ("Monitor", 1)],
                                   "dealer_risk_flag string, cnt long")
    assert rollups.dealer_risk_map(counts).first().dealer_risk == {"Normal": 2, "Monitor": 1}


def test_stored_pipeline(spark, sf_dir):
    staged = {"complaints": src.staging_complaints(spark, sf_dir),
              "inspections": src.staging_inspections(spark, sf_dir),
              "deliveries": src.staging_deliveries(spark, sf_dir)}
    silver, gold = (df.first() for df in medallion.run_all(spark, staged, "p_"))
    tables = [t.name for t in spark.catalog.listTables() if t.name.startswith("p_")]
    before = {t: spark.table(t).count() for t in tables}
    medallion.run_all(spark, staged, "p_")
    assert {t: spark.table(t).count() for t in tables} == before
    taken = staged["complaints"].where("NOT processed").count()
    assert silver.bad_rows_remaining == 0
    assert silver.corr_rows == silver.distinct_complaints <= taken
    assert before["p_bronze_complaints"] == taken
    assert gold.detail_rows == taken and gold.gap_rows == silver.gap_rows
    reco = spark.table("p_gold_checklist_recommendations")
    ai = spark.table("p_gold_checklist_recommendations_ai")
    assert sorted(r.priority for r in ai.collect()) == list(range(1, reco.count() + 1))
    assert "generated_at" in ai.columns
    detail = spark.table("p_gold_complaint_detail")
    assert reco.agg(F.sum("total_complaints")).first()[0] == detail.where(
        "specific_issue <> 'Uncategorised - Review Needed'").count()
    assert spark.table("p_gold_complaint_dashboard").agg(F.sum("total_complaints")).first()[0] == (
        spark.table("p_silver_complaint_correlation").where("dealer_id IS NOT NULL").count())
    medallion.drop_tables(spark, "p_")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("p_")]
    with pytest.raises(ValueError):
        medallion.drop_tables(spark, "")


def test_shared_folder(spark, monkeypatch):
    path = session.scratch_path(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    spark.range(3).write.parquet(path)
    session.remove_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)

    class Cluster:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster)
