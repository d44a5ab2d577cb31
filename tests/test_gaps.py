"""Gap tables: NULL rules of NOT IN, inline vehicle lists, lookups, text context."""

import datetime as dt

import pytest

from fleetlens.operators import gaps

DAY = dt.date(2024, 1, 1)


def complaints(spark, pairs):
    rows = [(n, v, c, DAY + dt.timedelta(n)) for n, (c, v) in enumerate(pairs)]
    return spark.createDataFrame(
        rows, "complaint_id long, vehicle_id string, complaint_category string, complaint_date date")


def items(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "checklist_item string")


@pytest.mark.parametrize("right, null_aware, left_anti", [
    (("B",), {"A"}, {"A", None}),
    (("B", None), set(), {"A", None}),
    ((), {"A", "B", None}, {"A", "B", None}),
    ((None,), set(), {"A", "B", None}),
])
def test_null_rules(spark, right, null_aware, left_anti):
    c = complaints(spark, [("A", "1"), ("B", "1"), (None, "1")])
    i = items(spark, *right)
    assert {r[0] for r in gaps.uncovered(c, i).collect()} == null_aware
    assert {r[0] for r in gaps.uncovered(c, i, null_aware=False).collect()} == left_anti
    rows = c.select("complaint_category", "vehicle_id")
    for anti, want in ((gaps.not_in, null_aware), (gaps.left_anti, left_anti)):
        salted = anti(rows, "complaint_category", i, "checklist_item", spread_by="vehicle_id")
        assert {r[0] for r in salted.collect()} == want and salted.columns == rows.columns
    c.createOrReplaceTempView("nc")
    i.createOrReplaceTempView("ni")
    sql = spark.sql("""SELECT DISTINCT complaint_category FROM nc
                       WHERE complaint_category NOT IN (SELECT checklist_item FROM ni)""")
    assert {r[0] for r in sql.collect()} == null_aware


def test_gap_rows_and_their_vehicles(spark):
    c = complaints(spark, [("A", "1"), ("A", "2"), ("A", "1"), ("A", None), ("B", "3"),
                           ("N", None), ("X", "9")])
    i = items(spark, "X")
    rows = {r.complaint_category: r for r in gaps.epdi_gaps(c, i).collect()}
    assert (rows["A"].complaint_count, rows["A"].vehicle_count) == (4, 2)
    assert (rows["A"].first_reported, rows["A"].last_reported) == (DAY, DAY + dt.timedelta(3))
    assert rows["N"].vehicle_count == 0 and set(rows) == {"A", "B", "N"}
    assert sorted(map(tuple, gaps.gap_vehicles(c, i).collect())) == [
        ("A", "1"), ("A", "2"), ("B", "3")]


def test_safe_variant_keeps_the_null_category(spark):
    c = complaints(spark, [(None, "1"), ("A", "2")])
    rows = {r.complaint_category: r for r in gaps.epdi_gaps(
        c, items(spark, None, "B"), null_aware=False).collect()}
    assert rows[None].vehicle_count == rows["A"].vehicle_count == 1
    pairs = gaps.gap_vehicles(c, items(spark, None, "B"), null_aware=False).collect()
    assert set(map(tuple, pairs)) == {(None, "1"), ("A", "2")}


def test_vehicle_sets_are_complete_at_every_size(spark):
    c = complaints(spark, [("A", str(n % 2500)) for n in range(5000)] + [("B", "1")])
    i = items(spark, "X")
    assert gaps.gap_vehicles(c, i).where("complaint_category = 'A'").count() == 2500
    assert {r.complaint_category: r.vehicle_count for r in gaps.epdi_gaps(c, i).collect()} == {
        "A": 2500, "B": 1}


def test_analysis_and_lookup(spark):
    c = complaints(spark, [("Service", str(n)) for n in range(4)] + [("O'Hare", "1")])
    out = gaps.gap_analysis(gaps.epdi_gaps(c, items(spark, "X")))
    first = out.first()
    assert (first.gap_category, first.severity, first.gap_duration_days) == ("Service", "Medium", 3)
    assert first.recommendation == "Add [Service] to ePDI checklist (affects 4 vehicles)"
    assert gaps.lookup_gap(out, "O'Hare").count() == 1
    assert gaps.lookup_gap(out, "x' OR '1'='1").count() == 0


def test_context_is_cut_and_ordered(spark):
    rows = [("A", f"S{n:02}", n, 0.0, "Covered") for n in range(20)] + [(None, None, 1, None, "G")]
    df = spark.createDataFrame(rows, "category string, subcategory string, complaint_count long, "
                                     "pdi_catch_rate_pct double, gap_classification string")
    text = {r.category: r.context.split("\n") for r in gaps.gap_context(df).collect()}
    assert len(text["A"]) == 15
    assert text["A"][0] == "- Complaint: A/S19 (count=19, PDI catch rate=0.0%, gap=Covered)"
    assert text[None] == ["- Complaint: None/None (count=1, PDI catch rate=None%, gap=G)"]
