"""Canonical quality frames derived from the star-schema test tables.

Every frame is a projection of one table (no join, no shuffle), so the plan of
an operator shows only the operator's own exchanges, and the parquet scan reads
only the columns in use.

* staging complaints   <- events      (one complaint per event)
* staging inspections  <- orders      (one ten-item inspection sheet per order)
* staging deliveries   <- orders      (one delivery per order)
* bronze inspections   <- lineitem    (one checked item per line)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import rule_values as V
from fleetlens.functions.rules import sql_text

# stated rather than inferred: opening a frame then runs no footer-reading job
SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}

# sample texts, at least one per issue rule, plus overlapping, unmatched, blank and NULL ones
PHRASES = [
    "touchscreen freezes after startup", "Bluetooth drops calls every few minutes",
    "false collision alert on the highway", "rear camera shows a black picture",
    "AC blows warm air at noon", "USB port does not recognise the phone",
    "OTA update failed twice", "engine stall at the traffic light",
    "humming from the front at 90 kmph", "high oil consumption between fills",
    "brake pedal feels spongy", "clunk over speed bumps",
    "gear shift is rough in second", "fuel smell inside the cabin",
    "paint peels near the fuel cap", "rust spots under the lamp",
    "dent on the left panel", "an incident with the boot lid",
    "loose trim on the pillar", "headlight has condensation inside",
    "spoiler came loose", "seat does not slide back",
    "wiper leaves streaks", "tyre wears on one side",
    "sunroof leaks in heavy rain", "door seal is torn",
    "warranty terms were not explained", "poor kmpl in city traffic",
    "recall notice never arrived", "fuel efficiency far below claim",
    "VACUUM hose hisses", "noise nobody can place", None, "",
    "dashboard cluster goes dark", "steering pulls to the right",
    "lane departure warning is silent", "roof lining sags",
    "mirror does not fold", "Brake light stays on",
    "wind noise near the window", "appointment was moved twice",
    "ECU needs a new map",
]
CATEGORY_OF_EVENT = {
    "click": "Mechanical", "error": "Electrical", "view": "Cosmetic",
    "purchase": "Service", "signup": "Safety",
}
ITEM_NAMES = [
    "Engine & Powertrain", "Brakes & Suspension", "Electrical & Infotainment",
    "Interior & Comfort", "Exterior & Body", "Electrical",
]
CONDITION_OF_PRIORITY = {
    "1-URGENT": "Damage", "2-HIGH": "Signature Withheld", "3-MEDIUM": "Fair",
    "4-NOT SPECIFIED": "Poor", "5-LOW": "Good",
}
SEVERITIES = ["Low", "Medium", "High", "Critical"]
COMPLAINT_STATES = ["Open", "Open", "Resolved", "In Progress", "Resolved"]
DEALERS = 8
MODELS, VARIANTS, SUBCATEGORIES, INSPECTORS = 5, 4, 7, 9



def _pick(values: list, index: str) -> str:
    return f"get(array({', '.join(sql_text(v) for v in values)}), int({index}))"


def _lookup(table: dict, key: str) -> str:
    arms = " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in table.items())
    return f"CASE {key} {arms} END"


def _dealer(number: str) -> str:
    return f"concat('DLR-', lpad(string({number} % {DEALERS}), 3, '0'))"


def _result(n: int, labels: tuple[str, str, str] = ("FAIL", "QUICK_FIX", "PASS")) -> str:
    fail, fix, ok = labels
    return (f"CASE (o_orderkey * 31 + o_custkey * 17 + {n * 7}) % 23 "
            f"WHEN 0 THEN '{fail}' WHEN 1 THEN '{fix}' WHEN 2 THEN '{fix}' ELSE '{ok}' END")


def _any_result(label: str) -> str:
    return "'" + label + "' IN (" + ", ".join(_result(n) for n in range(len(V.CHECKLIST_KEYS))) + ")"


_ITEM_STATUS = "l_returnflag = 'R' AND l_quantity <= 4"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def staging_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_staging_complaints(read_table(spark, sf_dir, "events"))


def stream_staging_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as a file stream; a file source wants a folder or, as here, a pattern."""
    return as_staging_complaints(
        spark.readStream.schema(SCHEMAS["events"]).parquet(f"{sf_dir}/events.parque[t]"))


_CATEGORY = f"CASE WHEN event_id % 97 <> 5 THEN {_lookup(CATEGORY_OF_EVENT, 'event_type')} END"
_COMPLAINT_DATE = "date_sub(to_date(ts), int(event_id % 1500 + 8030))"
_DESCRIPTION = _pick(PHRASES, f"event_id % {len(PHRASES)}")


def as_staging_complaints(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "concat('CC-', event_id) AS complaint_id",
        "concat('VIN-', user_id * 11) AS vin",
        "concat('Customer ', user_id) AS customer_name",
        f"{_dealer('user_id')} AS dealer_code",
        f"concat('Dealer ', user_id % {DEALERS}) AS dealer_name",
        f"{_COMPLAINT_DATE} AS complaint_date",
        f"{_DESCRIPTION} AS description",
        f"{_CATEGORY} AS category",
        f"concat('Model ', user_id % {MODELS}) AS model",
        f"concat('Variant ', user_id % {VARIANTS}) AS variant",
        f"concat('Sub ', event_id % {SUBCATEGORIES}) AS subcategory",
        f"{_CATEGORY} AS ai_category",
        f"concat('Sub ', event_id % {SUBCATEGORIES}) AS ai_subcategory",
        f"{_pick(SEVERITIES, f'event_id % {len(SEVERITIES)}')} AS severity",
        f"{_pick(COMPLAINT_STATES, f'event_id % {len(COMPLAINT_STATES)}')} AS status",
        "CAST(event_id % 100 * 0.01 AS DECIMAL(5,2)) AS ai_confidence",
        "event_id % 3 = 0 AS processed",
        "concat('VH-', user_id * 11) AS vehicle_id",
        "concat('CU-', user_id) AS customer_id",
        f"{_CATEGORY} AS complaint_category",
        "ts AS ingested_at",
        "ts AS created_at",
    )


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").selectExpr(
        "event_id AS complaint_id",
        "concat('VH-', user_id * 11) AS vehicle_id",
        "concat('CU-', user_id) AS customer_id",
        f"{_COMPLAINT_DATE} AS complaint_date",
        f"{_CATEGORY} AS complaint_category",
        f"{_DESCRIPTION} AS description",
    )


def staging_inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = []
    for n, key in enumerate(V.CHECKLIST_KEYS):
        result = _result(n)
        sheets += [
            f"{result} AS {key}_result",
            f"CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN {result} = 'PASS' THEN '' "
            f"WHEN o_orderkey % 2 = 0 THEN 'Adjusted' ELSE 'Replaced part' END AS {key}_action",
        ]
    return read_table(spark, sf_dir, "orders").selectExpr(
        "concat('INS-', o_orderkey) AS inspection_id",
        # one sheet in ten belongs to a vehicle that can have complaints
        "concat('VIN-', o_custkey div 10 * 11 + int(o_orderkey % 10 <> 0)) AS vin",
        f"{_dealer('o_orderkey')} AS dealer_code",
        f"concat('Dealer ', o_orderkey % {DEALERS}) AS dealer_name",
        "to_date(o_orderdate) AS inspection_date",
        *sheets,
        f"concat('Model ', o_custkey % {MODELS}) AS model",
        f"concat('Variant ', o_custkey % {VARIANTS}) AS variant",
        f"concat('Inspector ', o_orderkey % {INSPECTORS}) AS inspector_name",
        f"CASE WHEN {_any_result('FAIL')} THEN 'FAIL' WHEN {_any_result('QUICK_FIX')} "
        "THEN 'CONDITIONAL' ELSE 'PASS' END AS overall_result",
        "CAST(o_orderkey % 200 * 0.5 AS DECIMAL(5,2)) AS risk_score",
        "CAST(0.5 + o_orderkey % 10 * 0.04 AS DECIMAL(5,2)) AS risk_confidence",
        f"NOT ({_any_result('FAIL')}) AS delivery_cleared",
        "o_orderkey % 3 = 0 AS processed",
        "concat('VH-', o_custkey) AS vehicle_id",
        f"{_pick(ITEM_NAMES, f'o_orderkey % {len(ITEM_NAMES)}')} AS checklist_item",
        f"{_result(0)} AS status",
        "CAST(NULL AS STRING) AS notes",
        "o_orderdate AS ingested_at",
        "o_orderdate AS created_at",
    )


def staging_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").selectExpr(
        "concat('DEL-', o_orderkey) AS delivery_id",
        "concat('VH-', o_custkey) AS vehicle_id",
        f"{_dealer('o_orderkey')} AS dealer_id",
        "to_date(o_orderdate) AS delivery_date",
        f"{_lookup(CONDITION_OF_PRIORITY, 'o_orderpriority')} AS delivery_condition",
        "o_orderkey % 3 = 0 AS processed",
        "o_orderdate AS ingested_at",
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS delivery_id",
        "concat('VH-', o_custkey) AS vehicle_id",
        f"{_dealer('o_orderkey')} AS dealer_id",
        "to_date(o_orderdate) AS delivery_date",
        f"{_lookup(CONDITION_OF_PRIORITY, 'o_orderpriority')} AS delivery_condition",
        f"{sql_text(V.DEFAULT_SIGNATURE)} AS customer_signature",
    )


def inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS inspection_id",
        "concat('VH-', l_orderkey div 10) AS vehicle_id",
        f"{_dealer('l_orderkey')} AS dealer_id",
        "to_date(l_shipdate) AS inspection_date",
        f"{_pick(ITEM_NAMES, f'l_partkey % {len(ITEM_NAMES)}')} AS checklist_item",
        f"CASE WHEN {_ITEM_STATUS} THEN 'fail' WHEN l_returnflag = 'N' THEN 'Quick Fix' "
        "ELSE 'Pass' END AS status",
        "CAST(NULL AS STRING) AS notes",
    )


def checked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: one row per (inspection, checklist key), keys may repeat or be missing."""
    return read_table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS inspection_id",
        f"{_pick(V.CHECKLIST_KEYS, f'l_partkey % {len(V.CHECKLIST_KEYS)}')} AS item",
        f"CASE WHEN {_ITEM_STATUS} THEN 'FAIL' WHEN l_returnflag = 'N' THEN 'QUICK_FIX' "
        "ELSE 'PASS' END AS result",
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One submitted checklist map, with fix texts, per order: 7 to 12 entries."""
    keys = V.CHECKLIST_KEYS + ["extra_1", "extra_2"]
    names = ", ".join(sql_text(k) for k in keys)
    results = ", ".join(_result(n) for n in range(len(keys)))
    fixes = ", ".join(
        f"CASE WHEN {_result(n)} = 'PASS' OR o_orderkey % 4 = 0 THEN '' "
        f"WHEN o_orderkey % 4 = 1 THEN '  ' ELSE 'Adjusted {key}' END"
        for n, key in enumerate(V.CHECKLIST_KEYS))
    size = "int(o_orderkey % 6 + 7)"
    return read_table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS inspection_id",
        f"map_from_arrays(slice(array({names}), 1, {size}), slice(array({results}), 1, {size})) "
        "AS checklist",
        f"map_from_arrays(slice(array({', '.join(sql_text(k) for k in V.CHECKLIST_KEYS)}), "
        f"1, {size}), slice(array({fixes}), 1, {size})) AS fix_actions",
    )


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One form per order: array of (name, status), some labels missing, the first repeated."""
    entries = ", ".join(
        f"named_struct('name', {sql_text(label)}, 'status', "
        f"{_result(n, ('Fail', 'Quick Fix', 'Pass'))})"
        for n, (label, _) in enumerate(V.FORM_ITEMS))
    again = f"array(named_struct('name', {sql_text(V.FORM_ITEMS[0][0])}, 'status', 'Fail'))"
    return read_table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS inspection_id",
        f"concat(slice(array({entries}), int(o_orderkey % 4 + 1), "
        f"int({len(V.FORM_ITEMS)} - o_orderkey % 4 - o_orderkey % 3)), {again}) AS form",
    )


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw classifier answers: plain, fenced, wrapped in prose, partial and malformed JSON."""
    labelled = read_table(spark, sf_dir, "events").selectExpr(
        "event_id AS complaint_id", f"{_lookup(CATEGORY_OF_EVENT, 'event_type')} AS label")
    full = labelled.withColumn("full", F.expr(
        """concat('{"category": "', label, '", "subcategory": "Sub ', complaint_id % 7,
                  '", "confidence": 0.', lpad(string(complaint_id % 100), 2, '0'), '}')"""))
    return full.select("complaint_id", F.expr(r"""
        CASE complaint_id % 6
            WHEN 0 THEN full
            WHEN 1 THEN concat('```json\n', full, '\n```')
            WHEN 2 THEN concat('Here it is:\n```\n', full, '\n```\nDone')
            WHEN 3 THEN concat('I think this is ', label)
            WHEN 4 THEN concat('{"category": "', label, '"}')
            ELSE concat('  {"category": "', label,
                        '", "subcategory": "S", "confidence": 1, "reasoning": "r"}\n')
        END""").alias("answer"))
