"""Reshaping of inspection checklists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import rule_values as V
from fleetlens.functions.rules import first_match, sql_text


def checklist_unpivot(wide: DataFrame, items=V.CHECKLIST_KEYS,
                      keep: list[str] | None = None) -> DataFrame:
    """Wide -> long: one row per inspection and item with its result and action."""
    keep = keep or ["inspection_id"]
    args = ", ".join(f"'{i}', `{i}_result`, `{i}_action`" for i in items)
    return wide.select(
        *keep, F.expr(f"stack({len(items)}, {args})").alias("item", "result", "action"))


def checklist_pivot(long: DataFrame, items=V.CHECKLIST_KEYS) -> DataFrame:
    """Long -> wide: one ``<item>_result`` column per item, PASS when the item is missing.

    One conditional aggregate per item and a single shuffle by inspection;
    repeated items keep their worst result.
    """
    rank = F.when(F.col("result") == "FAIL", 2).when(F.col("result") == "QUICK_FIX", 1).otherwise(0)
    worst = long.groupBy("inspection_id").agg(
        *[F.max(F.when(F.col("item") == i, rank)).alias(i) for i in items])
    return worst.select("inspection_id", *[
        first_match([(F.col(i) == 2, "FAIL"), (F.col(i) == 1, "QUICK_FIX")], "PASS")
        .alias(f"{i}_result") for i in items])


def default_actions(submissions: DataFrame, items=V.CHECKLIST_KEYS,
                    keep: list[str] | None = None) -> DataFrame:
    """Submitted maps -> wide result/action columns; no shuffle.

    A missing item passes.  A passed item has a blank action; any other has the
    submitted fix text, or a default for its result.
    """
    quick, failed = (sql_text(V.SUBMIT_ACTIONS[r]) for r in ("QUICK_FIX", "FAIL"))
    keep = keep or ["inspection_id"]
    looked_up = submissions.select(*keep, *[c for item in items for c in (
        F.coalesce(F.col("checklist")[item], F.lit("PASS")).alias(f"{item}_result"),
        F.col("fix_actions")[item].alias(f"{item}_fix"))])
    return looked_up.select(*keep, *[c for item in items for c in (
        F.col(f"{item}_result"),
        F.expr(f"CASE WHEN {item}_result = 'PASS' THEN '' WHEN {item}_fix <> '' THEN {item}_fix "
               f"WHEN {item}_result = 'QUICK_FIX' THEN {quick} ELSE {failed} END")
        .alias(f"{item}_action"))])


def worst_status(forms: DataFrame, mapping=V.FORM_ITEMS, items=V.CHECKLIST_KEYS,
                 keep: list[str] | None = None) -> DataFrame:
    """Form entries -> wide result/action columns, worst status per item; no shuffle.

    Several form labels may feed one item.  If a label is repeated in a form its
    first entry counts, and an item no label speaks of passes without an action.
    """
    keep = keep or ["inspection_id"]
    ranked = forms.select(
        *keep, F.col("form.name").alias("names"), F.col("form.status").alias("states"),
    ).select(*keep, *[
        F.expr(f"greatest(0, {', '.join(_rank(label) for label, key in mapping if key == item)})")
        .alias(item) for item in items])
    quick, failed = (sql_text(V.FORM_ACTIONS[r]) for r in ("QUICK_FIX", "FAIL"))
    return ranked.select(*keep, *[c for item in items for c in (
        F.expr(f"elt({item} + 1, 'PASS', 'QUICK_FIX', 'FAIL')").alias(f"{item}_result"),
        F.expr(f"elt({item} + 1, NULL, {quick}, {failed})").alias(f"{item}_action"))])


def _rank(label: str) -> str:
    # status of the first entry with this label; anything but Pass and Fail is a quick fix
    status = f"get(states, int(array_position(names, {sql_text(label)})) - 1)"
    return f"CASE coalesce({status}, 'Pass') WHEN 'Fail' THEN 2 WHEN 'Pass' THEN 0 ELSE 1 END"
