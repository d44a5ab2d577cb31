"""Checklist reshaping, recurrence and the delivery decision."""

import datetime as dt
import random

import pytest

from fleetlens.functions import rule_values as V
from fleetlens.functions.scoring import inspection_score
from fleetlens.operators import inspections, recurrence

DAY = dt.date(2024, 1, 1)
ITEMS = ["brakes", "electrical"]
WIDE = ("inspection_id string, vin string, inspection_date date, brakes_result string, "
        "brakes_action string, electrical_result string, electrical_action string")
LATER = "complaint_id string, vin string, complaint_date date, category string"


def test_pivot_takes_the_worst_and_fills_pass(spark):
    long = spark.createDataFrame(
        [(1, "brakes", "PASS"), (1, "brakes", "FAIL"), (1, "brakes", "QUICK_FIX"),
         (2, "electrical", "QUICK_FIX"), (3, "unknown", "FAIL")],
        "inspection_id long, item string, result string")
    rows = sorted(map(tuple, inspections.checklist_pivot(long, ITEMS).collect()))
    assert rows == [(1, "FAIL", "PASS"), (2, "PASS", "QUICK_FIX"), (3, "PASS", "PASS")]


def test_unpivot(spark):
    wide = spark.createDataFrame([("1", "v", DAY, "FAIL", "x", "PASS", None)], WIDE)
    assert sorted(map(tuple, inspections.checklist_unpivot(wide, ITEMS).collect())) == [
        ("1", "brakes", "FAIL", "x"), ("1", "electrical", "PASS", None)]


def test_default_actions(spark):
    df = spark.createDataFrame(
        [(1, {"brakes": "FAIL", "electrical": "QUICK_FIX"}, {"brakes": "", "electrical": "wire"}),
         (2, {"brakes": "QUICK_FIX"}, {"electrical": "ignored"}), (3, {"brakes": "FAIL"}, None)],
        "inspection_id long, checklist map<string,string>, fix_actions map<string,string>")
    assert sorted(map(tuple, inspections.default_actions(df, ITEMS).collect())) == [
        (1, "FAIL", "Failed — needs repair", "QUICK_FIX", "wire"),
        (2, "QUICK_FIX", "Quick fix applied", "PASS", ""),
        (3, "FAIL", "Failed — needs repair", "PASS", "")]


def test_worst_status_random_forms(spark):
    rng = random.Random(5)
    labels = [label for label, _ in V.FORM_ITEMS] + ["Stray"]
    forms = [(n, [(rng.choice(labels), rng.choice(["Pass", "Fail", "Quick Fix", "Other"]))
                  for _ in range(rng.randrange(15))]) for n in range(300)]
    df = inspections.worst_status(spark.createDataFrame(
        forms, "inspection_id long, form array<struct<name:string,status:string>>"))
    code = {"Pass": 0, "Fail": 2}
    for row in df.collect():
        form = forms[row.inspection_id][1]
        for item in V.CHECKLIST_KEYS:
            firsts = [next((s for n, s in form if n == label), "Pass")
                      for label, key in V.FORM_ITEMS if key == item]
            worst = ["PASS", "QUICK_FIX", "FAIL"][max(code.get(s, 1) for s in firsts)]
            assert row[f"{item}_result"] == worst
            assert row[f"{item}_action"] == V.FORM_ACTIONS.get(worst)


def brute_force_cases(wide, later, k):
    out = {}
    for n, item in enumerate(ITEMS):
        cases = []
        for ins, vin, day, *cells in wide:
            result, action = cells[2 * n], cells[2 * n + 1]
            if action and result in ("FAIL", "QUICK_FIX"):
                hits = [c for c in later if vin and c[1] == vin and c[2] > day]
                cases += [(day, ins, c[2], c[0], c[3]) for c in hits] or [
                    (day, ins, dt.date.min, "", None)]
        out[item] = sorted(cases, reverse=True)[:k]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cases_and_rates_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vins = ["HOT"] * 6 + ["A", "B", "C", None]
    wide = [(f"{n:03}", rng.choice(vins), DAY + dt.timedelta(rng.randrange(60)),
             *(x for _ in ITEMS for x in (rng.choice(["FAIL", "QUICK_FIX", "PASS"]),
                                          rng.choice(["did", "", None])))) for n in range(150)]
    later = [(f"c{n:03}", rng.choice(vins), DAY + dt.timedelta(rng.randrange(90)),
              rng.choice(["Service", "", None])) for n in range(120)]
    cases = recurrence.recurrence_pairs(
        spark.createDataFrame(wide, WIDE), spark.createDataFrame(later, LATER), items=ITEMS)
    want = brute_force_cases(wide, later, 20)
    got = {i: [] for i in ITEMS}
    for r in sorted(cases.collect(), key=lambda r: (r.item, r.case_no)):
        got[r.item].append((r.inspection_date, r.inspection_id, r.complaint_date or dt.date.min,
                            r.complaint_id or "", r.complaint_category))
    assert got == want
    for r in recurrence.recurrence_rates(cases).collect():
        hits, n = sum(bool(c[4]) for c in want[r.item]), len(want[r.item])
        assert (r.recurrence_count, r.historical_cases) == (hits, n)
        assert r.recurrence_rate == round(hits / n * 100, 1)


@pytest.mark.parametrize("hits, total, rate, severity, add", [
    (3, 10, 30.0, None, 0), (4, 10, 40.0, "MEDIUM", 8), (5, 10, 50.0, "MEDIUM", 8),
    (6, 10, 60.0, "HIGH", 15), (5, 16, 31.2, "MEDIUM", 8), (7, 16, 43.8, "MEDIUM", 8),
])
def test_rate_boundaries(spark, hits, total, rate, severity, add):
    cases = spark.createDataFrame(
        [("brakes", "Service" if n < hits else None) for n in range(total)],
        "item string, complaint_category string")
    r = recurrence.recurrence_rates(cases).first()
    assert (r.recurrence_rate, r.severity, r.risk_add) == (rate, severity, add)
    assert r.warning == (severity is not None)


RATES = ("item string, historical_cases long, recurrence_count long, recurrence_rate double, "
         "warning boolean, severity string, risk_add int")
SUBMIT = "inspection_id long, checklist map<string,string>, fix_actions map<string,string>"


def test_decision(spark):
    rates = spark.createDataFrame(
        [("brakes", 10, 6, 60.0, True, "HIGH", 15), ("electrical", 10, 4, 40.0, True, "MEDIUM", 8),
         ("engine_bay", 10, 1, 10.0, False, None, 0)], RATES)
    df = spark.createDataFrame([
        (1, {"brakes": "QUICK_FIX"}, {"brakes": "pads"}),
        (2, {"electrical": "QUICK_FIX"}, {"electrical": "fuse"}),
        (3, {"electrical": "FAIL"}, {"electrical": "fuse", "brakes": "pads"}),
        (4, {"engine_bay": "QUICK_FIX"}, {"engine_bay": "oil"}),
        (5, {"brakes": "FAIL"}, {"brakes": "  "}),
        (6, {"brakes": "PASS"}, {}), (7, {"brakes": "PASS"}, None)], SUBMIT)
    out = {r.inspection_id: (r.overall_result, r.delivery_cleared, r.risk_score, r.warnings,
                             r.risk_recommendation.split(".")[0][:24])
           for r in recurrence.inspection_decision(inspection_score(df), rates).collect()}
    assert out == {
        1: ("FAIL", False, 20.0, 1, "HOLD DELIVERY — Recurren"),
        2: ("CONDITIONAL", True, 13.0, 1, "HOLD DELIVERY — Recurren"),
        3: ("FAIL", False, 38.0, 2, "HOLD DELIVERY — Recurren"),
        4: ("CONDITIONAL", True, 5.0, 0, "Quick fixes required bef"),
        5: ("FAIL", False, 15.0, 0, "Hold delivery — critical"),
        6: ("PASS", True, 0.5, 0, "Clear for delivery"),
        7: ("PASS", True, 0.5, 0, "Clear for delivery")}
    text = recurrence.inspection_decision(inspection_score(df), rates).where(
        "inspection_id = 3").first().risk_recommendation
    assert "2 item(s)" in text and "40.0% of cases" in text


def test_decision_without_history(spark):
    df = spark.createDataFrame([(1, {"brakes": "QUICK_FIX"}, {"brakes": "pads"})], SUBMIT)
    row = recurrence.inspection_decision(
        inspection_score(df), spark.createDataFrame([], RATES)).first()
    assert (row.warnings, row.risk_score, row.delivery_cleared) == (0, 5.0, True)


def test_undated_repairs_come_last(spark):
    """NULL dates sort after all dates, newest first; an undated repair can't have a later complaint."""
    item = V.CHECKLIST_KEYS[0]
    sheets = spark.createDataFrame(
        [("I1", "V1", None, "FAIL", "fixed"), ("I2", "V1", dt.date(2024, 1, 1), "FAIL", "fixed"),
         ("I3", "V2", dt.date(2024, 2, 1), "QUICK_FIX", "fixed")],
        f"inspection_id string, vin string, inspection_date date, {item}_result string, {item}_action string")
    complaints = spark.createDataFrame([("C1", "V1", dt.date(2024, 3, 1), "Service")],
                                       "complaint_id string, vin string, complaint_date date, category string")
    rows = recurrence.recurrence_pairs(sheets, complaints, items=[item]).orderBy("case_no").collect()
    assert [(r.inspection_id, r.complaint_id) for r in rows] == [("I3", None), ("I2", "C1"), ("I1", None)]
