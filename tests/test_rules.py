"""Golden rows for the rule tables, overlaps and boundaries included."""

import re

from pyspark.sql import functions as F

from fleetlens.functions import rule_values as V
from fleetlens.functions import rules
from fleetlens.functions.scalars import digits_to_bigint, gap_pct, not_blank, pct


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_issue_order_and_case(spark):
    golden = [
        ("the spoiler came off", "Engine Oil Consumption & Leaks"),
        ("an incident at the gate", "Body Damage (Dents / Scratches)"),
        ("VACUUM pump", "Climate Control / AC"),
        ("fuel efficiency is low", "Fuel System"),
        ("only 9 kmpl", "Fuel Efficiency Advisory"),
        ("touchscreen and Bluetooth", "Infotainment System"),
        ("BRAKE", V.UNCATEGORISED),
        ("Brake", "Brake System & ABS"),
        ("", V.UNCATEGORISED),
        (None, V.UNCATEGORISED),
    ]
    got = values(spark, golden, "description string, want string", rules.classify_issue(), "want")
    assert all(a == b for a, b in got), got


def test_each_rule_is_reached_by_its_first_substring_unless_shadowed(spark):
    rows = [(subs[0], label) for label, subs in V.ISSUE_RULES]
    got = values(spark, rows, "description string, want string", rules.classify_issue(), "want")
    wrong = [(a, b) for a, b in got if a != b]
    # "fuel efficiency" holds "fuel", which an earlier rule takes
    assert wrong == [("Fuel System", "Fuel Efficiency Advisory")]


def test_item_and_coverage(spark):
    rows = [
        ("Mechanical", "Brake squeals", "Brakes & Suspension", V.COVERED),
        ("Mechanical", "high oil consumption, gear whine", "Engine & Powertrain",
         V.COVERAGE_RULES[1][0]),
        ("Mechanical", None, "Engine & Powertrain", V.COVERED),
        ("Electrical", "OTA and ADAS", "Electrical & Infotainment", V.COVERAGE_RULES[3][0]),
        ("Cosmetic", "roof lining rust", "Interior & Comfort", V.COVERAGE_RULES[5][0]),
        ("Cosmetic", None, "Exterior & Body", V.COVERED),
        ("Service", None, None, V.COVERAGE_RULES[0][0]),
        ("Safety", "brake", None, V.COVERED),
        (None, "brake", None, V.COVERED),
    ]
    got = values(spark, rows, "complaint_category string, description string, item string, gap string",
                 rules.map_checklist_item(), "item", rules.coverage_gap(), "gap")
    assert all(a == b and c == d for a, b, c, d in got), got


def test_all_lists_in_one_stage_leave_no_method_too_long_to_compile(spark, capsys):
    texts = spark.createDataFrame([("Service", "brake")], "complaint_category string, description string").select(
        rules.classify_issue(), rules.map_checklist_item(), rules.coverage_gap())
    texts.explain(mode="codegen")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)
    assert all(int(n) < 8000 for n in sizes), sizes


def test_severity_boundaries(spark):
    severity, action = rules.gap_severity(F.col("n"))
    got = values(spark, [(n,) for n in (1, 3, 4, 7, 8, 14, 15)], "n long", severity)
    assert [g[0] for g in got] == ["Low", "Low", "Medium", "Medium", "High", "High", "Critical"]


def test_flags(spark):
    got = values(spark, [(3, 50.0), (3, 49.9), (2, 100.0), (1, 100.0)], "v long, p double",
                 rules.dealer_risk_flag(F.col("v"), F.col("p")))
    assert [g[0] for g in got] == ["High Risk Dealer", "Monitor", "Monitor", "Normal"]
    got = values(spark, [("Damage", "FAIL"), ("Good", "FAIL"), ("Damage", None), (None, None),
                         ("Signature Withheld", "PASS")], "c string, s string",
                 rules.delivery_risk_level(F.col("c"), F.col("s")))
    assert [g[0] for g in got] == ["High Risk", "Medium Risk", "Medium Risk", "Low Risk",
                                   "Medium Risk"]


def test_checklist_status(spark):
    status, priority = rules.checklist_status(F.col("g"), F.col("p"), F.col("n"))
    rows = [(True, 0.0, 1), (False, 0.0, 2), (False, 0.0, 1), (False, 0.1, 1)]
    got = values(spark, rows, "g boolean, p double, n long", status, priority)
    assert got == [(V.STATUS_NOT_COVERED, 1), (V.STATUS_NOT_CATCHING, 2), (V.STATUS_MONITOR, 4),
                   (V.STATUS_NOT_ENFORCED, 3)]


def test_scalars(spark):
    got = values(spark, [(1, 16), (1, 3), (0, 5), (0, 0)], "a long, b long",
                 pct(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [6.3, 33.3, 0.0, None]
    got = values(spark, [(None,), (0.0,), (62.5,)], "p double", gap_pct(F.col("p")))
    assert [g[0] for g in got] == [100.0, 100.0, 37.5]
    got = values(spark, [("CC-17090", ), ("12",), ("none",), ("",), (None,)], "x string",
                 digits_to_bigint(F.col("x")))
    assert [g[0] for g in got] == [17090, 12, None, None, None]
    got = values(spark, [(" a ",), (" \n\t",), ("",), (None,)], "x string", not_blank(F.col("x")))
    assert [g[0] for g in got] == [True, False, False, False]


def test_every_issue_has_an_action():
    assert set(V.ISSUE_ACTIONS) == {label for label, _ in V.ISSUE_RULES}
