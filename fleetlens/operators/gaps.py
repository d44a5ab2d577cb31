"""Complaint categories without a checklist item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.rules import gap_severity
from fleetlens.operators.topn import top_n_per_key


def left_anti(left: DataFrame, column: str, right: DataFrame, right_column: str,
              spread_by: str | None = None) -> DataFrame:
    """NOT IN without the NULL traps: NULLs on the right are ignored, NULL rows are kept.

    If ``left`` repeats the values of ``column``, one of them may hold a third of
    its rows: ``spread_by`` then names a column that splits such a value over as
    many tasks as a shuffle has, each with its own copy of the distinct right values.
    """
    values = right.select(F.col(right_column).alias(column)).distinct()
    if spread_by is None:
        return left.join(values, column, "left_anti")
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = F.sequence(F.lit(0), F.lit(n - 1))
    return (
        left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(n)).cast("int"))
        .join(values.withColumn("_salt", F.explode(salts)), [column, "_salt"], "left_anti")
        .select(*left.columns)
    )


def not_in(left: DataFrame, column: str, right: DataFrame, right_column: str,
           spread_by: str | None = None) -> DataFrame:
    """Rows of ``left`` whose ``column`` is NOT IN ``right``, with SQL's NULL rules.

    A NULL on the right removes every row, a NULL on the left is removed unless
    the right is empty.  Done as a plain anti join on the distinct right values
    plus two existence tests that stop at the first row, because Spark's own
    null-aware anti join has to broadcast the right side whatever its size.
    """
    right_has_null = right.where(F.col(right_column).isNull()).select(F.lit(1)).exists()
    right_has_rows = right.select(F.lit(1)).exists()
    return left_anti(left, column, right, right_column, spread_by).where(
        ~right_has_rows | (F.col(column).isNotNull() & ~right_has_null))


def uncovered(complaints: DataFrame, inspections: DataFrame, null_aware: bool = True) -> DataFrame:
    """Distinct complaint categories that match no checklist item."""
    anti = not_in if null_aware else left_anti
    categories = complaints.select("complaint_category").distinct()
    return anti(categories, "complaint_category", inspections, "checklist_item")


def _per_vehicle(complaints: DataFrame) -> DataFrame:
    # a category can hold a third of all complaints, a (category, vehicle) pair
    # cannot once combined: every later step works on these pairs
    return complaints.groupBy("complaint_category", "vehicle_id").agg(
        F.count("complaint_id").alias("n"),
        F.min("complaint_date").alias("first"),
        F.max("complaint_date").alias("last"),
    )


def gap_vehicles(complaints: DataFrame, inspections: DataFrame,
                 null_aware: bool = True) -> DataFrame:
    """The whole affected-vehicle set of every gap as (category, vehicle) rows."""
    anti = not_in if null_aware else left_anti
    pairs = complaints.where(F.col("vehicle_id").isNotNull()).select(
        "complaint_category", "vehicle_id").distinct()
    return anti(pairs, "complaint_category", inspections, "checklist_item",
                spread_by="vehicle_id")


def epdi_gaps(complaints: DataFrame, inspections: DataFrame,
              null_aware: bool = True) -> DataFrame:
    """One row per uncovered category: counts and dates.

    The affected vehicles are a relation of their own, :func:`gap_vehicles`, at every size.
    """
    anti = not_in if null_aware else left_anti
    totals = _per_vehicle(complaints).groupBy("complaint_category").agg(
        F.sum("n").alias("complaint_count"),
        F.count("vehicle_id").alias("vehicle_count"),
        F.min("first").alias("first_reported"),
        F.max("last").alias("last_reported"),
    )
    return anti(totals, "complaint_category", inspections, "checklist_item")


def gap_analysis(gaps: DataFrame) -> DataFrame:
    """Severity, action and recommendation per gap, most frequent first."""
    severity, action = gap_severity(F.col("complaint_count"))
    return gaps.select(
        F.col("complaint_category").alias("gap_category"),
        "complaint_count",
        "vehicle_count",
        "first_reported",
        "last_reported",
        F.date_diff("last_reported", "first_reported").alias("gap_duration_days"),
        severity.alias("severity"),
        action.alias("action_required"),
        F.concat(F.lit("Add ["), F.col("complaint_category"),
                 F.lit("] to ePDI checklist (affects "), F.col("vehicle_count").cast("string"),
                 F.lit(" vehicles)")).alias("recommendation"),
    ).orderBy(F.desc("complaint_count"), "gap_category")


def lookup_gap(gaps: DataFrame, category: str) -> DataFrame:
    """Gap rows of one category; the value is bound, never spliced into SQL text."""
    return gaps.where(F.col("gap_category") == F.lit(category))


def lookup_gap_class(classified: DataFrame, category: str,
                     subcategory: str | None = None) -> DataFrame:
    """Gap classes of a category, or of one subcategory of it."""
    found = classified.where(F.col("category") == F.lit(category))
    if subcategory is not None:
        found = found.where(F.col("subcategory") == F.lit(subcategory))
    return found


def gap_context(gaps: DataFrame, n: int = 15) -> DataFrame:
    """First ``n`` gap rows per category as one text block."""
    def shown(column: str):
        return F.coalesce(F.col(column).cast("string"), F.lit("None"))

    line = F.concat(
        F.lit("- Complaint: "), shown("category"), F.lit("/"), shown("subcategory"),
        F.lit(" (count="), shown("complaint_count"),
        F.lit(", PDI catch rate="), shown("pdi_catch_rate_pct"),
        F.lit("%, gap="), shown("gap_classification"), F.lit(")"))
    first = top_n_per_key(gaps, ["category"],
                          [F.desc("complaint_count"), F.col("subcategory")], n, rank="rn")
    return first.groupBy("category").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("rn", line.alias("line"))))["line"],
                     "\n").alias("context"))
