"""Rule-based risk and inspection scores as native column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import rule_values as V
from fleetlens.functions.rules import first_match, sql_text


def _dec(value: str) -> Column:
    return F.lit(Decimal(value))


def risk_score_sql(fail_count: Column, engine: Column, brake: Column, electrical: Column,
                   dealer: Column, condition: Column) -> Column:
    """Defect risk in [0.05, 0.97] from the number and kind of failed items.

    Added up as decimals, then returned as double.  NULL flags follow SQL logic:
    one fail with an unknown engine flag and no brake fail scores 0.10.
    """
    critical = engine | brake
    arms = []
    for fails, at_least, wants_critical, score in V.SCORE_BASE:
        test = fail_count >= fails if at_least else fail_count == fails
        if wants_critical is not None:
            test = test & (critical if wants_critical else ~critical)
        arms.append((test, _dec(score)))
    none = _dec("0.00")
    score = (
        first_match(arms, _dec(V.SCORE_OTHERWISE))
        + F.when(electrical, _dec(V.SCORE_ELECTRICAL)).otherwise(none)
        + F.when(dealer.isin(V.HIGH_RISK_DEALERS), _dec(V.SCORE_DEALER)).otherwise(none)
        + F.when(condition.isin(V.WORN_CONDITIONS), _dec(V.SCORE_CONDITION)).otherwise(none)
    )
    return F.least(score, _dec(V.SCORE_CAP)).cast("double")


def register_score_defect_risk(spark: SparkSession, name: str = "score_defect_risk") -> None:
    """Make :func:`risk_score_sql` callable from SQL text as a temporary function."""
    arms = []
    for fails, at_least, wants_critical, score in V.SCORE_BASE:
        test = f"fails {'>=' if at_least else '='} {fails}"
        if wants_critical is not None:
            test += " AND (engine OR brake)" if wants_critical else " AND NOT (engine OR brake)"
        arms.append(f"WHEN {test} THEN {score}")
    dealers, worn = (", ".join(map(sql_text, v)) for v in (V.HIGH_RISK_DEALERS, V.WORN_CONDITIONS))
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(
            fails INT, engine BOOLEAN, brake BOOLEAN, electrical BOOLEAN,
            dealer STRING, cond STRING)
        RETURNS DOUBLE
        RETURN CAST(LEAST({V.SCORE_CAP},
            CASE {' '.join(arms)} ELSE {V.SCORE_OTHERWISE} END
            + IF(electrical, {V.SCORE_ELECTRICAL}, 0.00)
            + IF(dealer IN ({dealers}), {V.SCORE_DEALER}, 0.00)
            + IF(cond IN ({worn}), {V.SCORE_CONDITION}, 0.00)) AS DOUBLE)
    """)


def parse_items(items: Column) -> Column:
    """Failed items given as a JSON list in a string; missing or malformed means none."""
    return F.coalesce(F.from_json(items, "array<string>"), F.array().cast("array<string>"))


def risk_score_model(df: DataFrame, items_col: str = "failed_items") -> DataFrame:
    """Add ``risk_score``, ``risk_level`` and ``top_risk_factors`` to scorer input.

    Differs from :func:`risk_score_sql` on purpose: three or more fails share
    the base of two, item penalties are added on top, and the level is taken
    from the raw score, before the cap and the rounding.
    """
    fails = F.coalesce(F.col("fail_count"), F.lit(0))
    dealer = F.col("dealer_id")
    condition = F.col("delivery_condition")
    items = F.col(items_col)
    if dict(df.dtypes)[items_col] == "string":
        items = parse_items(items)
    items = F.coalesce(items, F.array().cast("array<string>"))

    score = first_match([(fails == 0, 0.05), (fails == 1, 0.22), (fails >= 2, 0.44)], 0.68)
    factors = [
        first_match(
            [
                (fails == 1, V.FACTOR_ONE_FAIL),
                (fails == 2, V.FACTOR_TWO_FAILS),
                (fails >= 3, F.concat(fails.cast("string"), F.lit(V.FACTOR_MORE_FAILS))),
            ],
            F.lit(None).cast("string"),
        )
    ]
    for item, penalty, text in V.CRITICAL_ITEMS:
        hit = F.array_contains(items, item)
        score = score + F.when(hit, penalty).otherwise(0.0)
        factors.append(F.when(hit, F.lit(text)))
    risky_dealer = dealer.isin(V.HIGH_RISK_DEALERS)
    score = score + F.when(risky_dealer, 0.08).otherwise(0.0)
    factors.append(F.when(risky_dealer, F.concat(
        F.lit(V.FACTOR_DEALER[0]), dealer, F.lit(V.FACTOR_DEALER[1]))))
    worn = condition.isin(V.WORN_CONDITIONS)
    score = score + F.when(worn, 0.06).otherwise(0.0)
    factors.append(F.when(worn, F.concat(F.lit(V.FACTOR_CONDITION), condition)))

    return (
        df.withColumn("_score", score)
        .withColumn("risk_score", F.round(F.least(F.col("_score"), F.lit(0.97)), 2))
        .withColumn("risk_level", first_match(
            [(F.col("_score") >= 0.70, "HIGH"), (F.col("_score") >= 0.35, "MEDIUM")], "LOW"))
        .withColumn("top_risk_factors", first_n(factors, 3))
        .drop("_score")
    )


def first_n(values: list[Column], n: int) -> Column:
    """The first ``n`` non-NULL values, in list order."""
    return F.slice(F.array_compact(F.array(*values)), 1, n)


def count_equal(values: Column, label: str) -> Column:
    """How many elements of an array equal ``label``; compiled, unlike a filter lambda."""
    return F.size(values) - F.size(F.array_remove(values, label))


def count_status(checklist: Column, label: str) -> Column:
    """How many entries of a ``map<string,string>`` carry ``label``."""
    return count_equal(F.map_values(checklist), label)


def inspection_score(df: DataFrame, checklist_col: str = "checklist") -> DataFrame:
    """Score one submitted checklist map per row; no shuffle."""
    checklist = F.col(checklist_col)
    return (
        df.withColumn("items_checked", F.size(checklist))
        .withColumn("items_failed", count_status(checklist, "FAIL"))
        .withColumn("items_quick_fix", count_status(checklist, "QUICK_FIX"))
        .withColumn("risk_score", F.round(
            F.col("items_failed") * 15.0 + F.col("items_quick_fix") * 5.0
            + (F.col("items_checked") - F.col("items_failed") - F.col("items_quick_fix")) * 0.5, 2))
        .withColumn("risk_confidence", F.least(
            _dec("0.95"), _dec("0.50") + F.col("items_checked") * _dec("0.04")).cast("double"))
        .withColumn("overall_result", first_match(
            [(F.col("items_failed") > 0, "FAIL"), (F.col("items_quick_fix") > 0, "CONDITIONAL")],
            "PASS"))
        .withColumn("delivery_cleared", F.col("items_failed") == 0)
    )


def inspection_score_clamped(df: DataFrame, form_col: str = "form") -> DataFrame:
    """Score a form (array of name/status structs): clamped to 0..100, no random noise."""
    states = F.col(form_col)["status"]
    return (
        df.withColumn("items_checked", F.size(form_col))
        .withColumn("items_failed", count_equal(states, "Fail"))
        .withColumn("items_quick_fix", count_equal(states, "Quick Fix"))
        .withColumn("risk_score", F.round(F.least(F.lit(100.0), F.greatest(
            F.lit(0.0), F.col("items_failed") * 15.0 + F.col("items_quick_fix") * 5.0)), 1))
        .withColumn("risk_confidence", F.lit(0.85))
        .withColumn("overall_result", first_match(
            [((F.col("items_failed") == 0) & (F.col("items_quick_fix") == 0), "PASS"),
             (F.col("items_failed") == 0, "CONDITIONAL_PASS")], "FAIL"))
        .withColumn("delivery_cleared", F.col("overall_result") != "FAIL")
    )
