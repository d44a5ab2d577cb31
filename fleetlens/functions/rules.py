"""Ordered first-match rules as native column expressions.

The long rule tables are turned into one SQL CASE each: a single expression for
Catalyst, built in one step instead of one call per rule and substring.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions import rule_values as V


def sql_text(value: str | None) -> str:
    """``value`` as a SQL string literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def first_match(cases: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first case whose condition is true, else ``default``."""
    chain = None
    for condition, value in cases:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return F.lit(default) if chain is None else chain.otherwise(default)


def contains_any(column: str, needles: Sequence[str]) -> str:
    """SQL condition: ``column`` holds one of the substrings, case-sensitively."""
    return "(" + " OR ".join(f"contains({column}, {sql_text(n)})" for n in needles) + ")"


def contains_one(column: str, needles: Sequence[str]) -> str:
    """The same condition as a lambda over the substrings.

    Long lists of tests joined by OR, several in one stage, make a method too long to be compiled: all three rule lists took
    three times as long that way.
    """
    return f"exists(array({', '.join(sql_text(n) for n in needles)}), needle -> contains({column}, needle))"


def _case(cases: Sequence[tuple[str, str]], default: str | None) -> Column:
    arms = " ".join(f"WHEN {condition} THEN {sql_text(label)}" for condition, label in cases)
    return F.expr(f"CASE {arms} ELSE {sql_text(default)} END")


def classify_issue(description: str = "description", rules=V.ISSUE_RULES,
                   default: str = V.UNCATEGORISED) -> Column:
    """Issue label of a complaint text; a NULL text matches no rule."""
    return _case([(contains_any(description, subs), label) for label, subs in rules], default)


def _by_category(category: str, description: str, rules, default: str | None) -> Column:
    cases = []
    for label, wanted, needles in rules:
        condition = f"{category} = {sql_text(wanted)}"
        if needles:
            condition += f" AND {contains_one(description, needles)}"
        cases.append((condition, label))
    return _case(cases, default)


def map_checklist_item(category: str = "complaint_category", description: str = "description",
                       rules=V.CHECKLIST_ITEM_RULES) -> Column:
    return _by_category(category, description, rules, None)


def coverage_gap(category: str = "complaint_category", description: str = "description",
                 rules=V.COVERAGE_RULES, default: str = V.COVERED) -> Column:
    return _by_category(category, description, rules, default)


def gap_severity(complaints: Column, levels=V.GAP_SEVERITY) -> tuple[Column, Column]:
    """(severity, action) for a complaint count; the last level is the floor."""
    *upper, floor = levels
    severity = first_match([(complaints >= n, s) for n, s, _ in upper], floor[1])
    action = first_match([(complaints >= n, a) for n, _, a in upper], floor[2])
    return severity, action


def dealer_risk_flag(vehicles: Column, pct_failed: Column) -> Column:
    return first_match(
        [((vehicles >= 3) & (pct_failed >= 50), "High Risk Dealer"), (vehicles >= 2, "Monitor")],
        "Normal",
    )


def delivery_risk_level(condition: Column, inspection_status: Column) -> Column:
    risky = condition.isin(V.RISKY_CONDITIONS)
    failed = inspection_status == "FAIL"
    return first_match([(risky & failed, "High Risk"), (risky | failed, "Medium Risk")], "Low Risk")


def checklist_status(is_gap: Column, pct_caught: Column, total: Column) -> tuple[Column, Column]:
    """(status text, priority 1..4, 1 = most urgent)."""
    conditions = [is_gap, (pct_caught == 0) & (total >= 2), pct_caught > 0]
    labels = [V.STATUS_NOT_COVERED, V.STATUS_NOT_CATCHING, V.STATUS_NOT_ENFORCED]
    status = first_match(list(zip(conditions, labels)), V.STATUS_MONITOR)
    priority = first_match([(c, n) for n, c in enumerate(conditions, 1)], 4)
    return status, priority
