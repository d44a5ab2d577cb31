"""How often a repaired checklist item was followed by a complaint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import rule_values as V
from fleetlens.functions.rules import first_match
from fleetlens.functions.scalars import not_blank
from fleetlens.operators.inspections import checklist_unpivot
from fleetlens.operators.topn import top_n_per_key

CASES_PER_ITEM = 20


def repaired_items(wide: DataFrame, items=V.CHECKLIST_KEYS) -> DataFrame:
    """Inspection items that failed or were fixed and carry an action text."""
    return checklist_unpivot(
        wide, items, keep=["inspection_id", "vin", "inspection_date"]
    ).where((F.col("action") != "") & F.col("result").isin("FAIL", "QUICK_FIX"))


def recurrence_pairs(wide: DataFrame, complaints: DataFrame, k: int = CASES_PER_ITEM,
                     items=V.CHECKLIST_KEYS) -> DataFrame:
    """The ``k`` newest historical cases per item.

    A case is a repaired item joined to one later complaint on the same vehicle,
    or alone when there is none.  Two facts keep this from ever building all
    pairs: every repair gives at least one case, so the newest ``k`` cases come
    from the newest ``k`` repairs of the item; and the newest complaints after a
    date are a prefix of the vehicle's newest complaints, so ``k`` per vehicle
    are enough for all its repairs.  Complaints are read once, filtered by a
    broadcast of at most ``k`` vehicles per item, and cut before the shuffle.
    """
    newest = [F.desc("inspection_date"), F.desc("inspection_id")]
    by_complaint = [F.desc("complaint_date"), F.desc("complaint_id")]
    repairs = top_n_per_key(repaired_items(wide, items), ["item"], newest, k)
    # at most k rows for each of the listed items
    vehicles = F.broadcast(repairs.select(F.col("vin").alias("c_vin")).distinct())
    latest = top_n_per_key(
        complaints.select(
            F.col("vin").alias("c_vin"), "complaint_id", "complaint_date",
            F.col("category").alias("complaint_category"),
        ).join(vehicles, "c_vin", "left_semi"),
        ["c_vin"], by_complaint, k)
    cases = repairs.join(
        latest,
        (F.col("vin") == F.col("c_vin")) & (F.col("complaint_date") > F.col("inspection_date")),
        "left")
    return top_n_per_key(cases, ["item"], newest + by_complaint, k, rank="case_no").select(
        "item", "case_no", "inspection_id", "vin", "inspection_date", "action", "result",
        "complaint_id", "complaint_date", "complaint_category",
    )


def recurrence_rates(cases: DataFrame) -> DataFrame:
    """Recurrence rate, severity and score surcharge per item."""
    rate = F.col("recurrence_count") / F.col("historical_cases")
    warned = rate > 0.3
    return (
        cases.groupBy("item")
        .agg(
            F.count(F.lit(1)).alias("historical_cases"),
            F.count_if(F.col("complaint_category") != "").alias("recurrence_count"),
        )
        .select(
            "item", "historical_cases", "recurrence_count",
            # ties to even, as x.x5 shares come up exactly (5 of 16)
            F.bround(rate * 100, 1).alias("recurrence_rate"),
            warned.alias("warning"),
            first_match([(rate > 0.5, "HIGH"), (warned, "MEDIUM")],
                        F.lit(None).cast("string")).alias("severity"),
            first_match([(rate > 0.5, 15), (warned, 8)], 0).alias("risk_add"),
        )
    )


def rates_as_map(rates: DataFrame) -> Column:
    """All warnings as one ``map<item, struct>`` scalar; one entry per checklist key."""
    entry = F.struct("item", F.struct("recurrence_rate", "severity", "risk_add"))
    return rates.where("warning").agg(F.map_from_entries(F.collect_list(entry))).scalar()


def inspection_decision(scored: DataFrame, rates: DataFrame) -> DataFrame:
    """Adjust scored submissions by the recurrence of the fixes they report.

    Rates have one row per checklist key, so they enter every row as a map
    value; submissions are neither exploded nor shuffled.  Warnings keep the
    order in which the submission lists its fixes.
    """
    def warning(fix: Column) -> Column:
        return F.when(not_blank(fix["value"]), F.try_element_at(F.col("_rates"), fix["key"]))

    # without any history the map is NULL and no fix is warned about
    warned = scored.withColumn("_rates", rates_as_map(rates)).withColumn(
        "_warnings", F.coalesce(
            F.array_compact(F.transform(F.map_entries("fix_actions"), warning)), no_warnings()))
    warnings = F.col("_warnings")
    decided = warned.select(
        *scored.columns,
        F.size(warnings).alias("warnings"),
        F.array_contains(warnings["severity"], "HIGH").alias("_high"),
        F.aggregate(warnings["risk_add"], F.lit(0), lambda acc, add: acc + add).alias("_add"),
        F.get(warnings["recurrence_rate"], F.lit(0)).cast("string").alias("_first_rate"),
    ).withColumn("overall_result", F.when(F.col("_high"), "FAIL").otherwise(
        F.col("overall_result")))
    text = first_match(
        [
            (F.col("warnings") > 0, F.concat(
                F.lit(V.HOLD_RECURRENCE[0]),
                F.col("warnings").cast("string"),
                F.lit(V.HOLD_RECURRENCE[1]), F.col("_first_rate"), F.lit(V.HOLD_RECURRENCE[2]))),
            (F.col("overall_result") == "PASS", V.CLEAR),
            (F.col("overall_result") == "CONDITIONAL", V.FIX_FIRST),
        ],
        V.HOLD_FAILED,
    )
    return (
        decided.withColumn("risk_score", F.round(F.col("risk_score") + F.col("_add"), 2))
        .withColumn("delivery_cleared", F.col("delivery_cleared") & ~F.col("_high"))
        .withColumn("risk_recommendation", text)
        .drop("_high", "_add", "_first_rate")
    )


def no_warnings() -> Column:
    return F.array().cast("array<struct<recurrence_rate:double,severity:string,risk_add:int>>")
