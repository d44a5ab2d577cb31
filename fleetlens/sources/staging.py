"""Reading staged records and bringing them into bronze form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions import rule_values as V
from fleetlens.functions.scalars import digits_to_bigint

COMPLAINT_COLUMNS = ["complaint_id", "vehicle_id", "customer_id", "complaint_date",
                     "complaint_category", "description"]
INSPECTION_COLUMNS = ["inspection_id", "vehicle_id", "checklist_item", "status",
                      "inspection_date", "notes"]
DELIVERY_COLUMNS = ["delivery_id", "vehicle_id", "dealer_id", "delivery_date",
                    "delivery_condition"]

INGESTED = "ingested_at"  # tells versions of a record apart; not stored

_S, _D = T.StringType(), T.DateType()

BRONZE_COMPLAINTS = T.StructType([
    T.StructField("complaint_id", T.LongType()), T.StructField("vehicle_id", _S),
    T.StructField("customer_id", _S), T.StructField("complaint_date", _D),
    T.StructField("complaint_category", _S), T.StructField("description", _S)])
BRONZE_INSPECTIONS = T.StructType([
    T.StructField("inspection_id", T.LongType()), T.StructField("vehicle_id", _S),
    T.StructField("dealer_id", _S), T.StructField("inspection_date", _D),
    T.StructField("checklist_item", _S), T.StructField("status", _S),
    T.StructField("notes", _S)])
BRONZE_DELIVERIES = T.StructType([
    T.StructField("delivery_id", T.LongType()), T.StructField("vehicle_id", _S),
    T.StructField("dealer_id", _S), T.StructField("delivery_date", _D),
    T.StructField("delivery_condition", _S), T.StructField("customer_signature", _S)])


def read_unprocessed(staged: DataFrame, columns: list[str]) -> DataFrame:
    """Rows not processed yet, cut to ``columns``.

    Filter and projection reach the file or JDBC scan by themselves, so no
    hand-written subquery is needed; arrival order is left to the consumer.
    """
    return staged.where(~F.col("processed")).select(*columns)


def jdbc_options(url: str, table: str, split_column: str | None = None,
                 bounds: tuple[int, int] | None = None, splits: int = 1,
                 fetch_size: int = 10_000) -> dict[str, str]:
    """Options of a JDBC scan; with a numeric ``split_column`` it is read in parallel."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if split_column:
        if bounds is None:
            raise ValueError("a split column needs lower and upper bounds")
        options |= {"partitionColumn": split_column, "lowerBound": str(bounds[0]),
                    "upperBound": str(bounds[1]), "numPartitions": str(splits)}
    return options


def read_jdbc(spark: SparkSession, properties: dict[str, str] | None = None,
              **scan) -> DataFrame:
    """A staging table over JDBC; see :func:`jdbc_options`."""
    return spark.read.format("jdbc").options(
        **jdbc_options(**scan), **(properties or {})).load()


def _bronze(df: DataFrame, schema: T.StructType) -> list[str]:
    """Columns of the bronze form; the ingest time goes along where the frame has one."""
    return schema.names + [c for c in df.columns if c == INGESTED]


def to_bronze_complaints(df: DataFrame) -> DataFrame:
    return df.withColumn("complaint_id", digits_to_bigint(F.col("complaint_id"))).select(
        *_bronze(df, BRONZE_COMPLAINTS))


def to_bronze_inspections(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("inspection_id", digits_to_bigint(F.col("inspection_id")))
        .withColumn("dealer_id", F.lit(V.DEFAULT_DEALER))
        .select(*_bronze(df, BRONZE_INSPECTIONS))
    )


def to_bronze_deliveries(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("delivery_id", digits_to_bigint(F.col("delivery_id")))
        .withColumn("customer_signature", F.lit(V.DEFAULT_SIGNATURE))
        .select(*_bronze(df, BRONZE_DELIVERIES))
    )


def mark_processed(staged: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``staged`` with ``processed`` set for every id in ``ids``.

    Returns the new version of the table; both sides join on the primary key,
    so no key is hot.
    """
    hits = ids.select(id_col).distinct().withColumn("_hit", F.lit(True))
    return staged.join(hits, id_col, "left").select(*[
        F.coalesce("_hit", "processed").alias("processed") if c == "processed" else c
        for c in staged.columns])


def parse_classification(df: DataFrame, raw_col: str = "answer") -> DataFrame:
    """Category, subcategory and confidence from a model's raw answer.

    The answer may be plain JSON or sit in the first code fence.  An answer that
    is not a JSON object with a category gets the fallback values.
    """
    raw = F.col(raw_col)
    body = F.when(raw.contains("```"), F.replace(
        F.split_part(raw, F.lit("```"), F.lit(2)), F.lit("json"), F.lit(""))).otherwise(raw)
    # from_json ignores whatever follows a complete value, but not inside a list:
    # exactly one element means the answer was exactly one object
    several = F.from_json(
        F.concat(F.lit("["), body, F.lit("]")),
        "array<struct<category: string, subcategory: string, confidence: string>>",
        {"allowSingleQuotes": "false"})
    parsed = F.when(F.size(several) == 1, several[0])
    category, subcategory, confidence = V.FALLBACK_CLASSIFICATION
    ok = F.col("_parsed")["category"].isNotNull()
    return (
        df.withColumn("_parsed", parsed)
        .withColumn("category", F.when(ok, F.col("_parsed")["category"]).otherwise(category))
        .withColumn("subcategory", F.when(
            ok, F.coalesce(F.col("_parsed")["subcategory"], F.lit(""))).otherwise(subcategory))
        .withColumn("confidence", F.when(
            ok, F.coalesce(F.col("_parsed")["confidence"].try_cast("double"), F.lit(0.0)))
            .otherwise(confidence))
        .drop("_parsed", raw_col)
    )
