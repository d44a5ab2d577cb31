"""The scorers against plain Python on full input grids."""

import itertools
import json

from pyspark.sql import functions as F

from fleetlens.functions import rule_values as V
from fleetlens.functions import scoring

FLAG = (True, False, None)
COLUMNS = ["fails", "engine", "brake", "electrical", "dealer", "cond"]


def grid(spark):
    rows = itertools.product((None, -1, 0, 1, 2, 3, 7), FLAG, FLAG, FLAG,
                             ("DLR-003", "DLR-001", None), ("Fair", "Good", None))
    return spark.createDataFrame(list(rows), (
        "fails int, engine boolean, brake boolean, electrical boolean, dealer string, "
        "cond string"))


def sql_or(a, b):
    return True if a or b else (None if a is None or b is None else False)


def expected_sql_score(fails, engine, brake, electrical, dealer, cond):
    critical = sql_or(engine, brake)
    hundredths = 10
    if fails == 0:
        hundredths = 5
    elif fails in (1, 2) and critical is not None:
        hundredths = {(1, False): 22, (1, True): 38, (2, False): 44, (2, True): 60}[fails, critical]
    elif fails is not None and fails >= 3:
        hundredths = 82 if critical else 68
    hundredths += 6 * bool(electrical) + 8 * (dealer == "DLR-003") + 6 * (cond == "Fair")
    return min(hundredths, 97) / 100


def test_sql_score_grid(spark):
    df = grid(spark).withColumn("score", scoring.risk_score_sql(*map(F.col, COLUMNS)))
    for r in df.collect():
        assert r.score == expected_sql_score(*r[:6]), r


def test_sql_function_equals_columns(spark):
    scoring.register_score_defect_risk(spark)
    df = grid(spark).withColumn("score", scoring.risk_score_sql(*map(F.col, COLUMNS)))
    again = df.withColumn("sql", F.expr(f"score_defect_risk({', '.join(COLUMNS)})"))
    assert again.where("NOT score <=> sql").count() == 0
    named = spark.sql("""SELECT score_defect_risk(0, false, false, false, 'DLR-001', 'Good') AS a,
        score_defect_risk(1, false, false, false, 'DLR-001', 'Good') AS b,
        score_defect_risk(2, true, false, false, 'DLR-003', 'Good') AS c,
        score_defect_risk(3, true, true, true, 'DLR-003', 'Fair') AS d""").first()
    assert tuple(named) == (0.05, 0.22, 0.68, 0.97)


ENGINE, BRAKE, ELECTRICAL = V.ENGINE_ITEM, V.BRAKE_ITEM, V.ELECTRICAL_ITEM
ONE, TWO = "1 inspection item failed", "2 inspection items failed"
MANY = "{} inspection items failed — above safe threshold"
DEALER = "Dealer DLR-003 — elevated historical complaint rate"
WORN = "Vehicle delivery condition: Poor"
TEXT = {item: text for item, _, text in V.CRITICAL_ITEMS}

# worked out by hand: fails, failed items, dealer, condition -> score, level, first three factors
MODEL_ROWS = [
    (0, [], None, None, 0.05, "LOW", []),
    (0, [], "DLR-003", "Poor", 0.19, "LOW", [DEALER, WORN]),
    (1, [], "DLR-9", "Good", 0.22, "LOW", [ONE]),
    (1, ["Other"], "DLR-003", "Good", 0.30, "LOW", [ONE, DEALER]),
    (1, [], "DLR-003", "Poor", 0.36, "MEDIUM", [ONE, DEALER, WORN]),
    (1, [ENGINE], None, "Good", 0.38, "MEDIUM", [ONE, TEXT[ENGINE]]),
    (1, [BRAKE], None, None, 0.36, "MEDIUM", [ONE, TEXT[BRAKE]]),
    (1, [ELECTRICAL], None, "Poor", 0.34, "LOW", [ONE, TEXT[ELECTRICAL], WORN]),
    (2, [], "DLR-9", "Good", 0.44, "MEDIUM", [TWO]),
    (2, [ENGINE, BRAKE], None, None, 0.74, "HIGH", [TWO, TEXT[ENGINE], TEXT[BRAKE]]),
    (2, [ENGINE, ELECTRICAL], "DLR-003", "Poor", 0.80, "HIGH",
     [TWO, TEXT[ENGINE], TEXT[ELECTRICAL]]),
    (3, [], None, None, 0.44, "MEDIUM", [MANY.format(3)]),
    (3, [ENGINE, BRAKE, ELECTRICAL], "DLR-003", "Poor", 0.94, "HIGH",
     [MANY.format(3), TEXT[ENGINE], TEXT[BRAKE]]),
    (9, ["Other", BRAKE], "DLR-003", None, 0.66, "MEDIUM", [MANY.format(9), TEXT[BRAKE], DEALER]),
    (-1, [], None, None, 0.68, "MEDIUM", []),
    (-1, [ENGINE, BRAKE], None, None, 0.97, "HIGH", [TEXT[ENGINE], TEXT[BRAKE]]),
]


def test_model_rows(spark):
    rows = [(n, f, json.dumps(i), d, c) for n, (f, i, d, c, *_) in enumerate(MODEL_ROWS)]
    df = scoring.risk_score_model(spark.createDataFrame(
        rows, "n int, fail_count int, failed_items string, dealer_id string, "
              "delivery_condition string"))
    got = {r.n: (r.risk_score, r.risk_level, r.top_risk_factors) for r in df.collect()}
    assert got == {n: want for n, (*_, score, level, texts) in enumerate(MODEL_ROWS)
                   for want in [(score, level, texts)]}


def test_model_items_as_array_or_broken_json(spark):
    one = spark.createDataFrame(
        [(2, [V.ENGINE_ITEM], "DLR-003", "Good"), (2, None, "DLR-003", "Good")],
        "fail_count int, failed_items array<string>, dealer_id string, delivery_condition string")
    assert [r.risk_score for r in scoring.risk_score_model(one).collect()] == [0.68, 0.52]
    broken = one.withColumn("failed_items", F.lit("[not json"))
    assert [r.risk_score for r in scoring.risk_score_model(broken).collect()] == [0.52, 0.52]


def test_inspection_score(spark):
    rows = [({"a": "FAIL", "b": "QUICK_FIX", "c": "PASS"},), ({"a": "QUICK_FIX"},), ({},),
            ({str(i): "PASS" for i in range(12)},), ({str(i): "PASS" for i in range(11)},)]
    got = [tuple(r)[1:] for r in scoring.inspection_score(
        spark.createDataFrame(rows, "checklist map<string,string>")).collect()]
    assert got == [
        (3, 1, 1, 20.5, 0.62, "FAIL", False), (1, 0, 1, 5.0, 0.54, "CONDITIONAL", True),
        (0, 0, 0, 0.0, 0.5, "PASS", True), (12, 0, 0, 6.0, 0.95, "PASS", True),
        (11, 0, 0, 5.5, 0.94, "PASS", True)]


def test_clamped_score(spark):
    def form(**n):
        return [(str(i), s) for s, k in n.items() for i in range(k)]

    rows = [(form(Fail=7),), ([("a", "Quick Fix")] * 2 + [("b", "Pass")],), (form(Pass=3),)]
    got = [tuple(r)[1:] for r in scoring.inspection_score_clamped(spark.createDataFrame(
        rows, "form array<struct<name:string,status:string>>")).collect()]
    assert got == [(7, 7, 0, 100.0, 0.85, "FAIL", False),
                   (3, 0, 2, 10.0, 0.85, "CONDITIONAL_PASS", True),
                   (3, 0, 0, 0.0, 0.85, "PASS", True)]
