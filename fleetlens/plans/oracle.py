"""Independent DuckDB statements for the registered queries.

Written for DuckDB and its own idioms (FILTER, DISTINCT ON, QUALIFY, lists), so
that an error in a Spark operator does not repeat itself here.  Shared are only
the fixed rule values and the expressions that derive the input frames.
"""

from __future__ import annotations

from fleetlens.functions import rule_values as V
from fleetlens.plans.registry import LOOKUP_CATEGORY, LOOKUP_SUBCATEGORY, LOOKUP_TEXT
from fleetlens.sources import star_schema as src


def _q(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _case(column: str, table: dict) -> str:
    return f"CASE {column} " + " ".join(
        f"WHEN {_q(k)} THEN {_q(v)}" for k, v in table.items()) + " END"


def _dealer(number: str) -> str:
    return f"'DLR-' || lpad(({number} % {src.DEALERS})::VARCHAR, 3, '0')"


def _contains(column: str, needles) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(n)})" for n in needles) + ")"


def _pct(part: str, whole: str) -> str:
    # exact half-up percentage with one decimal in whole numbers
    return f"(((2000 * ({part}) + ({whole})) // (2 * ({whole}))) / 10.0)::DOUBLE"


def _avg1(column: str) -> str:
    n, s = f"count({column})", f"sum({column})"
    return f"(((20 * {s} + {n}) // (2 * {n})) / 10.0)::DOUBLE"


def _mean(column: str, digits: int) -> str:
    # half-up mean of values that have one or two decimals
    scale = 10 ** digits
    n, s = f"count({column})", f"sum(round({column} * {scale})::BIGINT)"
    return f"coalesce((((2 * {s} + {n}) // (2 * {n})) / {scale}.0)::DOUBLE, 0)"


ISSUE = ("CASE " + " ".join(
    f"WHEN {_contains('description', subs)} THEN {_q(label)}" for label, subs in V.ISSUE_RULES)
    + f" ELSE {_q(V.UNCATEGORISED)} END")


def _category_rules(rules, default: str | None) -> str:
    arms = []
    for label, category, needles in rules:
        test = f"complaint_category = {_q(category)}"
        if needles:
            test += f" AND {_contains('description', needles)}"
        arms.append(f"WHEN {test} THEN {_q(label)}")
    return f"CASE {' '.join(arms)} ELSE {_q(default)} END"


ITEM = _category_rules(V.CHECKLIST_ITEM_RULES, None)
COVERAGE = _category_rules(V.COVERAGE_RULES, V.COVERED)
RESULT = ("CASE (o_orderkey * 31 + o_custkey * 17 + idx * 7) % 23 WHEN 0 THEN 'FAIL' "
          "WHEN 1 THEN 'QUICK_FIX' WHEN 2 THEN 'QUICK_FIX' ELSE 'PASS' END")
_KEYS = V.CHECKLIST_KEYS + ["extra_1", "extra_2"]
_FORM = [*V.FORM_ITEMS, (V.FORM_ITEMS[0][0], None)]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else _q(x) for x in r) + ")"
                     for r in rows)


# --- input frames and shared steps, each with the steps it reads --------------
STEPS: dict[str, tuple[str, list[str]]] = {}


def _step(name: str, sql: str, *needs: str) -> None:
    STEPS[name] = (sql, list(needs))


_step("sc", f"""
    SELECT *, category AS ai_category, category AS complaint_category FROM (
    SELECT event_id AS n, 'CC-' || event_id AS complaint_id, 'VIN-' || user_id * 11 AS vin,
           'Customer ' || user_id AS customer_name, {_dealer('user_id')} AS dealer_code,
           'Dealer ' || user_id % {src.DEALERS} AS dealer_name,
           ts::DATE - (event_id % 1500 + 8030)::INTEGER AS complaint_date,
           {_list(src.PHRASES)}[event_id % {len(src.PHRASES)} + 1] AS description,
           CASE WHEN event_id % 97 <> 5
                THEN {_case('event_type', src.CATEGORY_OF_EVENT)} END AS category,
           {_list(src.SEVERITIES)}[event_id % {len(src.SEVERITIES)} + 1] AS severity,
           {_list(src.COMPLAINT_STATES)}[event_id % {len(src.COMPLAINT_STATES)} + 1] AS status,
           'Model ' || user_id % {src.MODELS} AS model,
           'Variant ' || user_id % {src.VARIANTS} AS variant,
           'Sub ' || event_id % {src.SUBCATEGORIES} AS subcategory,
           event_id % 100 AS cents, event_id % 3 = 0 AS processed,
           'VH-' || user_id * 11 AS vehicle_id, 'CU-' || user_id AS customer_id, ts
    FROM events)""")
_step("c", """
    SELECT n AS complaint_id, vehicle_id, customer_id, complaint_date, complaint_category,
           description FROM sc""", "sc")
_step("i", f"""
    SELECT l_orderkey AS inspection_id, 'VH-' || l_orderkey // 10 AS vehicle_id,
           {_dealer('l_orderkey')} AS dealer_id, l_shipdate::DATE AS inspection_date,
           {_list(src.ITEM_NAMES)}[l_partkey % {len(src.ITEM_NAMES)} + 1] AS checklist_item,
           CASE WHEN l_returnflag = 'R' AND l_quantity <= 4 THEN 'fail'
                WHEN l_returnflag = 'N' THEN 'Quick Fix' ELSE 'Pass' END AS status
    FROM lineitem""")
_step("sd", f"""
    SELECT o_orderkey AS n, 'DEL-' || o_orderkey AS delivery_id,
           'VH-' || o_custkey AS vehicle_id, {_dealer('o_orderkey')} AS dealer_id,
           o_orderdate::DATE AS delivery_date,
           {_case('o_orderpriority', src.CONDITION_OF_PRIORITY)} AS delivery_condition,
           o_orderkey % 3 = 0 AS processed
    FROM orders""")
_step("d", """
    SELECT n AS delivery_id, vehicle_id, dealer_id, delivery_date, delivery_condition
    FROM sd""", "sd")
# one row per order and checklist entry
_step("sheet", f"""
    SELECT o_orderkey AS inspection_id, o_custkey, o_orderdate, idx, key, {RESULT} AS result
    FROM orders, (VALUES {_values(list(enumerate(_KEYS)))}) k(idx, key)""")
_step("si", f"""
    SELECT 'INS-' || inspection_id AS inspection_id, inspection_id AS n,
           'VIN-' || (o_custkey // 10 * 11 + CASE WHEN inspection_id % 10 = 0 THEN 0 ELSE 1 END)
               AS vin,
           {_dealer('inspection_id')} AS dealer_code,
           'Dealer ' || inspection_id % {src.DEALERS} AS dealer_name,
           o_orderdate::DATE AS inspection_date, key AS item, result,
           CASE WHEN inspection_id % 19 <> 0 THEN
               CASE WHEN result = 'PASS' THEN '' WHEN inspection_id % 2 = 0 THEN 'Adjusted'
                    ELSE 'Replaced part' END END AS action
    FROM sheet WHERE idx < {len(V.CHECKLIST_KEYS)}""", "sheet")
# one row per inspection sheet
_step("so", """
    SELECT n, dealer_code, dealer_name,
           CASE WHEN bool_or(result = 'FAIL') THEN 'FAIL'
                WHEN bool_or(result = 'QUICK_FIX') THEN 'CONDITIONAL' ELSE 'PASS' END
               AS overall_result
    FROM si GROUP BY ALL""", "si")
_step("ins", """
    SELECT vehicle_id,
           CASE WHEN bool_or(status ILIKE 'fail') THEN 'FAIL' ELSE 'PASS' END
               AS inspection_status,
           count(*) FILTER (WHERE status ILIKE 'fail') AS fail_count,
           coalesce(list_sort(list(DISTINCT checklist_item)
                    FILTER (WHERE status ILIKE 'fail')), []) AS failed_items,
           max(inspection_date) AS latest_inspection_date
    FROM i GROUP BY vehicle_id""", "i")
_step("dl", """
    SELECT DISTINCT ON (vehicle_id) vehicle_id, delivery_id, dealer_id, delivery_date,
           delivery_condition
    FROM d ORDER BY vehicle_id, delivery_date DESC NULLS LAST, delivery_id DESC""", "d")
_step("linked", """
    SELECT c.*, ins.* EXCLUDE (vehicle_id), dl.* EXCLUDE (vehicle_id),
           (c.complaint_date - dl.delivery_date)::INTEGER AS days_since_delivery
    FROM c LEFT JOIN ins USING (vehicle_id) LEFT JOIN dl USING (vehicle_id)""", "c", "ins", "dl")
_step("s", "SELECT * FROM linked WHERE coalesce(days_since_delivery, 1) > 0", "linked")
_step("detail", f"""
    SELECT c.complaint_id, c.vehicle_id, c.complaint_category, c.description,
           s.inspection_status, s.failed_items, s.delivery_condition, s.days_since_delivery,
           s.dealer_id, {ISSUE.replace('description', 'c.description')} AS specific_issue,
           {ITEM.replace('description', 'c.description').replace(
               'complaint_category', 'c.complaint_category')} AS mapped_checklist_item,
           {COVERAGE.replace('description', 'c.description').replace(
               'complaint_category', 'c.complaint_category')} AS coverage_gap
    FROM c LEFT JOIN s ON s.complaint_id = c.complaint_id""", "c", "s")
_step("gaps", """
    SELECT complaint_category, count(complaint_id) AS complaint_count,
           count(DISTINCT vehicle_id) AS vehicle_count,
           min(complaint_date) AS first_reported, max(complaint_date) AS last_reported
    FROM c WHERE complaint_category NOT IN (SELECT checklist_item FROM i)
    GROUP BY complaint_category""", "c", "i")
_step("dash", f"""
    SELECT dealer_id, complaint_category,
           date_trunc('month', complaint_date)::TIMESTAMP AS complaint_month,
           count(complaint_id) AS total_complaints,
           count(DISTINCT vehicle_id) AS affected_vehicles,
           count(DISTINCT customer_id) AS affected_customers,
           {_avg1('days_since_delivery')} AS avg_days_since_delivery,
           min(days_since_delivery) AS min_days_since_delivery,
           max(days_since_delivery) AS max_days_since_delivery,
           count(*) FILTER (WHERE inspection_status = 'FAIL')
               AS complaints_with_failed_inspection,
           {_pct("count(*) FILTER (WHERE inspection_status = 'FAIL')", "count(*)")}
               AS pct_with_failed_inspection,
           count(*) FILTER (WHERE days_since_delivery <= 7) AS complaints_within_7days,
           count(*) FILTER (WHERE days_since_delivery <= 30) AS complaints_within_30days,
           CASE WHEN affected_vehicles < 2 THEN 'Normal'
                WHEN affected_vehicles < 3 OR pct_with_failed_inspection < 50 THEN 'Monitor'
                ELSE 'High Risk Dealer' END AS dealer_risk_flag
    FROM s WHERE dealer_id IS NOT NULL GROUP BY ALL""", "s")
for _unit in ("month", "quarter"):
    _step(f"dash_{_unit}", STEPS["dash"][0].replace("date_trunc('month'", f"date_trunc('{_unit}'").replace(
        "AS complaint_month", "AS period"), "s")
_step("analysis", f"""
    SELECT complaint_category AS gap_category, complaint_count, vehicle_count,
           first_reported, last_reported,
           (last_reported - first_reported)::INTEGER AS gap_duration_days,
           lv.severity, lv.action AS action_required,
           'Add [' || complaint_category || '] to ePDI checklist (affects ' || vehicle_count
               || ' vehicles)' AS recommendation
    FROM gaps ASOF JOIN (VALUES {_values(V.GAP_SEVERITY)}) lv(least_n, severity, action)
        ON gaps.complaint_count >= lv.least_n""", "gaps")
_step("reco", f"""
    SELECT specific_issue AS what_customers_complain_about, count(*) AS total_complaints,
           count(*) FILTER (WHERE inspection_status = 'FAIL') AS caught_by_inspection,
           {_pct('caught_by_inspection', 'total_complaints')} AS pct_caught_by_inspection,
           coalesce(min(mapped_checklist_item), 'NONE') AS current_checklist_item,
           CASE WHEN bool_or(starts_with(coverage_gap, 'NOT COVERED')) THEN 1
                WHEN pct_caught_by_inspection > 0 THEN 3
                WHEN total_complaints > 1 THEN 2 ELSE 4 END::INTEGER AS priority,
           {_list([V.STATUS_NOT_COVERED, V.STATUS_NOT_CATCHING, V.STATUS_NOT_ENFORCED,
                   V.STATUS_MONITOR])}[priority] AS checklist_status,
           coalesce(any_value(a.action), {_q(V.DEFAULT_ISSUE_ACTION)})
               AS specific_action_required
    FROM detail LEFT JOIN (VALUES {_values(V.ISSUE_ACTIONS.items())}) a(issue, action)
        ON issue = specific_issue
    WHERE specific_issue <> {_q(V.UNCATEGORISED)} GROUP BY specific_issue""", "detail")
_step("ranked", """
    SELECT what_customers_complain_about, total_complaints, caught_by_inspection,
           coalesce(pct_caught_by_inspection, 0) AS pct_caught_by_inspection,
           100 - coalesce(pct_caught_by_inspection, 0) AS gap_pct, current_checklist_item,
           specific_action_required AS original_action,
           specific_action_required AS ai_recommendation, priority AS rule_priority,
           (row_number() OVER (ORDER BY total_complaints DESC,
                               what_customers_complain_about))::INTEGER AS priority
    FROM reco""", "reco")
_step("gapclass", f"""
    SELECT complaint_category AS category, specific_issue AS subcategory,
           count(*) AS complaint_count, min(mapped_checklist_item) AS mapped_inspection_item,
           {_pct("count(*) FILTER (WHERE inspection_status = 'FAIL')", "count(*)")}
               AS pdi_catch_rate_pct,
           CASE WHEN bool_or(starts_with(coverage_gap, 'NOT COVERED')) THEN 'Critical Gap'
                WHEN count(*) > 1 AND NOT coalesce(bool_or(inspection_status = 'FAIL'), false)
                THEN 'Major Gap' ELSE 'Covered' END AS gap_classification
    FROM detail GROUP BY ALL""", "detail")
_step("trends", """
    SELECT date_trunc('month', complaint_date)::TIMESTAMP AS complaint_month, category,
           count(*) AS complaint_count, count(*) FILTER (WHERE status = 'Open') AS open_count,
           count(*) FILTER (WHERE status = 'Resolved') AS resolved_count,
           (((2 * sum(cents) + count(*)) // (2 * count(*))) / 100.0)::DOUBLE
               AS avg_ai_confidence
    FROM sc GROUP BY ALL""", "sc")
_step("perf", f"""
    SELECT coalesce(a.dealer_code, b.dealer_code) AS dealer_code,
           coalesce(a.dealer_name, b.dealer_name) AS dealer_name,
           coalesce(a.n, 0) AS total_inspections, coalesce(b.n, 0) AS total_complaints,
           {_pct('coalesce(b.n, 0)', 'coalesce(a.n, 0)')} AS complaint_rate_pct,
           {_pct('coalesce(a.f, 0)', 'coalesce(a.n, 0)')} AS fail_rate_pct
    FROM (SELECT dealer_code, dealer_name, count(*) AS n,
                 count(*) FILTER (WHERE overall_result = 'FAIL') AS f
          FROM so GROUP BY ALL) a
    FULL JOIN (SELECT dealer_code, dealer_name, count(*) AS n FROM sc GROUP BY ALL) b
      ON a.dealer_code = b.dealer_code AND a.dealer_name = b.dealer_name""", "so", "sc")
_step("scorer", f"""
    SELECT vehicle_id, dealer_id, delivery_condition, fail_count, failed_items,
           list_contains(failed_items, {_q(V.ENGINE_ITEM)}) AS eng,
           list_contains(failed_items, {_q(V.BRAKE_ITEM)}) AS brk,
           list_contains(failed_items, {_q(V.ELECTRICAL_ITEM)}) AS ele
    FROM ins LEFT JOIN dl USING (vehicle_id)""", "ins", "dl")
_step("risk", f"""
    SELECT *, least(0.97,
        CASE WHEN fail_count = 0 THEN 0.05
             WHEN eng OR brk THEN [0.38, 0.60, 0.82][least(fail_count, 3)]
             ELSE [0.22, 0.44, 0.68][least(fail_count, 3)] END
        + CASE WHEN ele THEN 0.06 ELSE 0.00 END
        + CASE WHEN dealer_id IN {_in(V.HIGH_RISK_DEALERS)} THEN 0.08 ELSE 0.00 END
        + CASE WHEN delivery_condition IN {_in(V.WORN_CONDITIONS)} THEN 0.06 ELSE 0.00 END
        )::DOUBLE AS risk_score FROM scorer""", "scorer")
_step("profile", """
    SELECT risk.vehicle_id, dealer_id, delivery_condition, fail_count,
           coalesce(k.n, 0) AS complaint_count, risk_score,
           CASE WHEN risk_score < 0.35 THEN 'Low' WHEN risk_score < 0.70 THEN 'Medium'
                ELSE 'High' END AS risk_level
    FROM risk LEFT JOIN (SELECT vehicle_id, count(*) AS n FROM c GROUP BY vehicle_id) k
        USING (vehicle_id)""", "risk", "c")
_step("sub", """
    SELECT inspection_id, key, result, idx,
           CASE WHEN idx < 10 AND result <> 'PASS' THEN
               CASE inspection_id % 4 WHEN 0 THEN '' WHEN 1 THEN '  '
                    ELSE 'Adjusted ' || key END END AS fix
    FROM sheet WHERE idx < inspection_id % 6 + 7""", "sheet")
_step("scored", """
    SELECT *, items_failed * 15.0::DOUBLE + items_quick_fix * 5.0::DOUBLE
              + (items_checked - items_failed - items_quick_fix) * 0.5::DOUBLE AS risk_score,
           least(0.95, 0.50 + 0.04 * items_checked)::DOUBLE AS risk_confidence,
           CASE WHEN items_failed > 0 THEN 'FAIL' WHEN items_quick_fix > 0 THEN 'CONDITIONAL'
                ELSE 'PASS' END AS overall_result,
           items_failed = 0 AS delivery_cleared
    FROM (SELECT inspection_id, count(*)::INTEGER AS items_checked,
                 (count(*) FILTER (WHERE result = 'FAIL'))::INTEGER AS items_failed,
                 (count(*) FILTER (WHERE result = 'QUICK_FIX'))::INTEGER AS items_quick_fix
          FROM sub GROUP BY inspection_id)""", "sub")
_step("cases", """
    SELECT item, (row_number() OVER (PARTITION BY item ORDER BY inspection_date DESC,
               si.inspection_id DESC, complaint_date DESC NULLS LAST,
               complaint_id DESC NULLS LAST))::INTEGER AS case_no,
           si.inspection_id, si.vin, inspection_date, action, result, complaint_id,
           complaint_date, category AS complaint_category
    FROM si LEFT JOIN (SELECT vin, complaint_id, complaint_date, category FROM sc) k
        ON si.vin = k.vin AND complaint_date > inspection_date
    WHERE action <> '' AND result <> 'PASS' QUALIFY case_no <= 20""", "si", "sc")
_step("rates", """
    SELECT item, count(*) AS historical_cases, count(complaint_category) AS recurrence_count,
           round_even(100 * (recurrence_count / historical_cases), 1) AS recurrence_rate,
           recurrence_count * 10 > historical_cases * 3 AS warning,
           CASE WHEN recurrence_count * 2 > historical_cases THEN 'HIGH'
                WHEN recurrence_count * 10 > historical_cases * 3 THEN 'MEDIUM' END AS severity,
           CASE severity WHEN 'HIGH' THEN 15 WHEN 'MEDIUM' THEN 8 ELSE 0 END::INTEGER AS risk_add
    FROM cases GROUP BY item""", "cases")
_step("form", f"""
    SELECT o_orderkey AS inspection_id, idx, label, key,
           CASE WHEN idx = 12 THEN 'FAIL' ELSE {RESULT} END AS result
    FROM orders, (VALUES {_values([(n, a, b or V.FORM_ITEMS[0][1])
                                   for n, (a, b) in enumerate(_FORM)])}) f(idx, label, key)
    WHERE idx = 12 OR (idx >= o_orderkey % 4 AND idx < 12 - o_orderkey % 3)""")
_step("alert", """
    SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, dealer_code, category,
           count(*) AS complaints
    FROM (SELECT dealer_code, category,
                 date_trunc('hour', ts) - to_hours(unnest(range(6))) AS window_start FROM sc)
    GROUP BY ALL HAVING count(*) > 5""", "sc")


# what the stored run takes from the staging tables
STORED: dict[str, tuple[str, list[str]]] = {
    "c": ("""SELECT n AS complaint_id, vehicle_id, customer_id, complaint_date,
             complaint_category, description FROM sc WHERE NOT processed""", ["sc"]),
    "i": (f"""SELECT n AS inspection_id, 'VH-' || o_custkey AS vehicle_id,
              {_q(V.DEFAULT_DEALER)} AS dealer_id, inspection_date,
              {_list(src.ITEM_NAMES)}[n % {len(src.ITEM_NAMES)} + 1] AS checklist_item,
              result AS status, NULL::VARCHAR AS notes
              FROM si JOIN orders ON o_orderkey = n
              WHERE item = {_q(V.CHECKLIST_KEYS[0])} AND n % 3 <> 0""", ["si"]),
    "d": ("""SELECT n AS delivery_id, vehicle_id, dealer_id, delivery_date, delivery_condition
             FROM sd WHERE NOT processed""", ["sd"]),
}


def statement(body: str, *needs: str, stored: bool = False) -> str:
    """``body`` with the steps it needs as common table expressions, in order."""
    steps = STEPS | (STORED if stored else {})
    ordered: dict[str, str] = {}

    def visit(name: str) -> None:
        if name not in ordered:
            sql, parents = steps[name]
            for parent in parents:
                visit(parent)
            ordered[name] = sql

    for name in needs:
        visit(name)
    return "WITH " + ", ".join(f"{n} AS ({sql})" for n, sql in ordered.items()) + f" {body}"


def _wide(source: str, pick: str, items=V.CHECKLIST_KEYS) -> str:
    columns = ", ".join(pick.replace("@", i) for i in items)
    return f"SELECT inspection_id, {columns} FROM {source} GROUP BY inspection_id"


_WORST = ("[coalesce(max(CASE WHEN key = '@' THEN CASE result WHEN 'FAIL' THEN 3 "
          "WHEN 'QUICK_FIX' THEN 2 ELSE 1 END END), 1)]")


def _worst(choices: list[str | None], suffix: str) -> str:
    return f"{_list(choices)}{_WORST} AS \"@{suffix}\""


_REPORT = """SELECT gap_category, complaint_count, vehicle_count,
    first_reported, last_reported, gap_duration_days, severity, action_required,
    recommendation FROM analysis"""
_LINKED = "* EXCLUDE (failed_items), array_to_string(failed_items, '|') AS failed_items"
_FACTORS = " UNION ALL ".join([
    """SELECT vehicle_id, 1 AS pos, 0.0::DOUBLE AS add_on, CASE WHEN fail_count = 1
       THEN '1 inspection item failed' WHEN fail_count = 2 THEN '2 inspection items failed'
       ELSE fail_count || ' inspection items failed — above safe threshold' END AS txt
       FROM scorer WHERE fail_count > 0""",
    *[f"SELECT vehicle_id, {n}, {p}::DOUBLE, {_q(t)} FROM scorer "
      f"WHERE list_contains(failed_items, {_q(item)})"
      for n, (item, p, t) in enumerate(V.CRITICAL_ITEMS, 2)],
    f"""SELECT vehicle_id, 5, 0.08::DOUBLE, 'Dealer ' || dealer_id
        || ' — elevated historical complaint rate'
        FROM scorer WHERE dealer_id IN {_in(V.HIGH_RISK_DEALERS)}""",
    f"""SELECT vehicle_id, 6, 0.06::DOUBLE, 'Vehicle delivery condition: ' || delivery_condition
        FROM scorer WHERE delivery_condition IN {_in(V.WORN_CONDITIONS)}""",
])
_MODEL = f"""
    SELECT scorer.vehicle_id, round(least(raw, 0.97), 2) AS risk_score,
           CASE WHEN raw >= 0.70 THEN 'HIGH' WHEN raw >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END
               AS risk_level,
           coalesce(array_to_string(txts[1:3], '|'), '') AS top_risk_factors
    FROM scorer LEFT JOIN (
        SELECT vehicle_id, list(txt ORDER BY pos) AS txts, list(add_on ORDER BY pos) AS adds
        FROM ({_FACTORS}) GROUP BY vehicle_id) f USING (vehicle_id),
    LATERAL (SELECT list_reduce(list_concat(
        [[0.05::DOUBLE, 0.22::DOUBLE, 0.44::DOUBLE][least(fail_count, 2) + 1]],
        coalesce(adds, [])), lambda a, b: a + b) AS raw)"""
_DECISION = """
    SELECT scored.inspection_id, items_checked, items_failed, items_quick_fix, risk_confidence,
           risk_score + coalesce(w.adds, 0) AS risk_score, coalesce(w.n, 0)::INTEGER AS warnings,
           CASE WHEN w.high THEN 'FAIL' ELSE overall_result END AS overall_result,
           delivery_cleared AND NOT coalesce(w.high, false) AS delivery_cleared,
           CASE WHEN w.n > 0 THEN 'HOLD DELIVERY — Recurrence risk detected in ' || w.n
                || ' item(s). Same fixes applied before led to complaints in '
                || w.first_rate || '% of cases.'
                WHEN overall_result = 'PASS' THEN 'Clear for delivery'
                WHEN overall_result = 'CONDITIONAL' THEN 'Quick fixes required before delivery'
                ELSE 'Hold delivery — critical failures detected' END AS risk_recommendation
    FROM scored LEFT JOIN (
        SELECT inspection_id, count(*) AS n, sum(risk_add)::INTEGER AS adds,
               bool_or(rates.severity = 'HIGH') AS high,
               arg_min(recurrence_rate, idx) AS first_rate
        FROM sub JOIN rates ON item = key WHERE trim(fix) <> '' AND warning
        GROUP BY inspection_id) w USING (inspection_id)"""
_ANSWERS = f"""
    WITH e AS (
        SELECT event_id, {_case('event_type', src.CATEGORY_OF_EVENT)} AS label,
               '{{"category": "' || label || '", "subcategory": "Sub ' || event_id % 7
               || '", "confidence": 0.' || lpad((event_id % 100)::VARCHAR, 2, '0') || '}}' AS obj,
               chr(10) AS nl
        FROM events),
    raw AS (
        SELECT event_id, CASE event_id % 6
            WHEN 0 THEN obj
            WHEN 1 THEN '```json' || nl || obj || nl || '```'
            WHEN 2 THEN 'Here it is:' || nl || '```' || nl || obj || nl || '```' || nl || 'Done'
            WHEN 3 THEN 'I think this is ' || label
            WHEN 4 THEN '{{"category": "' || label || '"}}'
            ELSE '  {{"category": "' || label
                 || '", "subcategory": "S", "confidence": 1, "reasoning": "r"}}' || nl END AS txt
        FROM e),
    body AS (
        SELECT event_id, replace(CASE WHEN contains(txt, '```') THEN split_part(txt, '```', 2)
                                      ELSE txt END, 'json', '') AS txt FROM raw),
    obj AS (
        SELECT event_id, CASE WHEN json_valid(txt) THEN txt ELSE '{{}}' END AS js,
               js ->> '$.category' IS NOT NULL AS ok FROM body)
    SELECT event_id AS complaint_id,
           CASE WHEN ok THEN js ->> '$.category' ELSE 'Unknown' END AS category,
           CASE WHEN ok THEN coalesce(js ->> '$.subcategory', '') ELSE 'Unclassified' END
               AS subcategory,
           CASE WHEN ok THEN coalesce((js ->> '$.confidence')::DOUBLE, 0) ELSE 0 END::DOUBLE
               AS confidence
    FROM obj"""


ORACLE: dict[str, str] = {
    "ingest_unprocessed": statement(
        """SELECT complaint_id, vehicle_id, customer_id, complaint_date, complaint_category,
           description FROM sc WHERE NOT processed""", "sc"),
    "bronze_complaints": statement("SELECT * FROM c WHERE complaint_id % 3 <> 0", "c"),
    "bronze_inspections": statement("SELECT * FROM i", "i", stored=True),
    "bronze_deliveries": statement(
        f"SELECT *, {_q(V.DEFAULT_SIGNATURE)} AS customer_signature FROM d "
        "WHERE delivery_id % 3 <> 0", "d"),
    "mark_processed": statement(
        """SELECT complaint_id, processed OR severity IN ('High', 'Critical') AS processed
           FROM sc""", "sc"),
    "mark_stored": statement(
        """SELECT complaint_id, processed OR severity IN ('High', 'Critical') AS processed
           FROM sc""", "sc"),
    "assign_ids": statement(
        """SELECT complaint_id, customer_name,
           (SELECT max(n) FROM sc WHERE processed) + row_number() OVER (
               ORDER BY md5(complaint_id)[:4], complaint_id) AS new_id
           FROM sc WHERE NOT processed""", "sc"),
    "parse_classification": _ANSWERS,
    "load_csv": statement(
        """SELECT complaint_id, vin, complaint_date, nullif(description, '') AS description,
           category, (cents / 100)::DECIMAL(5,2) AS ai_confidence, processed FROM sc""", "sc"),
    "load_csv_multi_line": statement(
        """SELECT complaint_id, nullif(description || chr(10) || category, '') AS description
           FROM sc""", "sc"),
    "query_table": statement(f"{_REPORT} WHERE severity = 'Critical'", "analysis"),
    "table_counts": statement(
        """SELECT (SELECT count(*) FROM c) AS complaints, (SELECT count(*) FROM i) AS inspections,
           (SELECT count(*) FROM d) AS deliveries""", "c", "i", "d"),
    "latest_delivery": statement("SELECT * FROM dl", "dl"),
    "inspection_summary": statement(f"SELECT {_LINKED} FROM ins", "ins"),
    "latest_delivery_merged": statement("SELECT * FROM dl", "dl"),
    "inspection_summary_merged": statement(f"SELECT {_LINKED} FROM ins", "ins"),
    "guard_after_delivery": statement(
        "SELECT complaint_id, complaint_date, delivery_date, days_since_delivery FROM s", "s"),
    "complaint_correlation": statement(f"SELECT {_LINKED} FROM s", "s"),
    "gap_not_in": statement(
        """SELECT DISTINCT complaint_category FROM c
           WHERE complaint_category NOT IN (SELECT checklist_item FROM i)""", "c", "i"),
    "gap_left_anti": statement(
        """SELECT DISTINCT complaint_category FROM c WHERE NOT EXISTS (
           SELECT 1 FROM i WHERE checklist_item = complaint_category)""", "c", "i"),
    "epdi_gaps": statement("SELECT * FROM gaps", "gaps"),
    "epdi_gap_vehicles": statement(
        """SELECT DISTINCT complaint_category, vehicle_id FROM c
           WHERE complaint_category NOT IN (SELECT checklist_item FROM i)""", "c", "i"),
    "silver_checks": statement(
        """SELECT count(*) AS corr_rows, count(DISTINCT complaint_id) AS distinct_complaints,
           (SELECT count(*) FROM gaps) AS gap_rows,
           count(*) FILTER (WHERE days_since_delivery < 1) AS bad_rows_remaining FROM s""",
        "s", "gaps"),
    "complaint_dashboard": statement("SELECT * FROM dash", "dash"),
    "gap_analysis": statement(_REPORT, "analysis"),
    "delivery_service_link": statement(
        f"""SELECT dealer_id, delivery_condition, complaint_category,
            count(complaint_id) AS complaint_count, count(DISTINCT vehicle_id) AS vehicle_count,
            {_avg1('days_since_delivery')} AS avg_days_to_complaint,
            count(*) FILTER (WHERE inspection_status = 'FAIL') AS known_inspection_failures,
            count(*) FILTER (WHERE delivery_condition = 'Damage') AS damage_at_delivery,
            count(*) FILTER (WHERE delivery_condition = 'Signature Withheld')
                AS signature_withheld,
            ['Low Risk', 'Medium Risk', 'High Risk'][
                coalesce(delivery_condition IN {_in(V.RISKY_CONDITIONS)}, false)::INTEGER
                + coalesce(inspection_status = 'FAIL', false)::INTEGER + 1] AS risk_level
            FROM s WHERE dealer_id IS NOT NULL GROUP BY ALL""", "s"),
    "classify_issue": statement(
        f"SELECT complaint_id, description, {ISSUE} AS specific_issue FROM c", "c"),
    "map_checklist_item": statement(
        f"SELECT complaint_id, {ITEM} AS mapped_checklist_item FROM c", "c"),
    "coverage_gap": statement(f"SELECT complaint_id, {COVERAGE} AS coverage_gap FROM c", "c"),
    "complaint_detail": statement(f"SELECT {_LINKED} FROM detail", "detail"),
    "checklist_recommendations": statement("SELECT * FROM reco", "reco"),
    "action_lookup": statement(
        f"""SELECT complaint_id, specific_issue,
            coalesce(action, {_q(V.DEFAULT_ISSUE_ACTION)}) AS specific_action_required
            FROM (SELECT complaint_id, {ISSUE} AS specific_issue FROM c)
            LEFT JOIN (VALUES {_values(V.ISSUE_ACTIONS.items())}) a(issue, action)
                ON issue = specific_issue""", "c"),
    "stored_correlation": statement(f"SELECT {_LINKED} FROM s", "s", stored=True),
    "stored_detail": statement(f"SELECT {_LINKED} FROM detail", "detail", stored=True),
    "stored_recommendations_ai": statement("SELECT * FROM ranked", "ranked", stored=True),
    "stored_counts": statement(
        """SELECT (SELECT count(*) FROM c) AS bronze_complaints,
           (SELECT count(*) FROM i) AS bronze_inspections,
           (SELECT count(*) FROM d) AS bronze_deliveries,
           (SELECT count(*) FROM linked) AS silver_complaint_links,
           (SELECT count(*) FROM s) AS silver_complaint_correlation,
           (SELECT count(*) FROM (SELECT DISTINCT complaint_category, vehicle_id FROM c
            WHERE complaint_category NOT IN (SELECT checklist_item FROM i)))
               AS silver_epdi_gap_vehicles""", "c", "i", "d", "linked", "s", stored=True),
    "gold_checks": statement(
        f"""SELECT (SELECT count(*) FROM dash) AS dashboard_rows,
            (SELECT count(*) FROM gaps) AS gap_rows,
            (SELECT count(*) FROM (SELECT DISTINCT dealer_id, delivery_condition,
                complaint_category,
                coalesce(delivery_condition IN {_in(V.RISKY_CONDITIONS)}, false)::INTEGER
                + coalesce(inspection_status = 'FAIL', false)::INTEGER
                FROM s WHERE dealer_id IS NOT NULL)) AS delivery_rows,
            (SELECT count(*) FROM detail) AS detail_rows,
            (SELECT count(*) FROM reco) AS reco_rows""", "dash", "gaps", "s", "detail", "reco",
        stored=True),
    "ai_priority": statement("SELECT * FROM ranked", "ranked"),
    "gap_pct": statement(
        """SELECT what_customers_complain_about, pct_caught_by_inspection, gap_pct
           FROM ranked""", "ranked"),
    "lookup_gap": statement(
        f"{_REPORT} WHERE gap_category = {_q(LOOKUP_CATEGORY)}", "analysis"),
    "lookup_gap_class": statement(
        f"""SELECT * FROM gapclass WHERE category = {_q(LOOKUP_CATEGORY)}
            AND subcategory = {_q(LOOKUP_SUBCATEGORY)}""", "gapclass"),
    "lookup_gap_category": statement(
        f"SELECT * FROM gapclass WHERE category = {_q(LOOKUP_CATEGORY)}", "gapclass"),
    "top_recommendations": statement(
        f"""SELECT * FROM ranked WHERE contains(what_customers_complain_about, {_q(LOOKUP_TEXT)})
            ORDER BY priority DESC LIMIT 5""", "ranked"),
    "recent_topn": statement(
        """SELECT complaint_id, vin, model, variant, customer_name, dealer_name, complaint_date,
           category, subcategory, ai_category, subcategory AS ai_subcategory,
           (cents / 100)::DECIMAL(5,2) AS ai_confidence, severity, status, description,
           ts AS created_at FROM sc ORDER BY ts DESC, complaint_id DESC LIMIT 20""", "sc"),
    "recent_inspections": statement(
        f"""SELECT 'INS-' || n AS inspection_id,
           'VIN-' || (o_custkey // 10 * 11 + CASE WHEN n % 10 = 0 THEN 0 ELSE 1 END) AS vin,
           'Model ' || o_custkey % {src.MODELS} AS model,
           'Variant ' || o_custkey % {src.VARIANTS} AS variant, dealer_name,
           'Inspector ' || n % {src.INSPECTORS} AS inspector_name,
           o_orderdate::DATE AS inspection_date, overall_result,
           (n % 200 * 0.5)::DECIMAL(5,2) AS risk_score,
           (0.5 + n % 10 * 0.04)::DECIMAL(5,2) AS risk_confidence,
           overall_result <> 'FAIL' AS delivery_cleared, o_orderdate AS created_at
           FROM so JOIN orders ON o_orderkey = n
           ORDER BY o_orderdate DESC, 'INS-' || n DESC LIMIT 20""", "so"),
    "metrics_summary": statement(
        """SELECT (SELECT count(*) FROM c) AS total_complaints,
           (SELECT count(*) FROM i) AS total_inspections,
           (SELECT count(*) FROM d) AS total_deliveries, count(*) AS gap_categories,
           coalesce(sum(complaint_count), 0)::BIGINT AS gap_total_complaints FROM gaps""",
        "c", "i", "d", "gaps"),
    "dealer_risk_counts": statement(
        "SELECT dealer_risk_flag, count(*) AS cnt FROM dash GROUP BY ALL", "dash"),
    "dealer_risk_map": statement(
        """SELECT nullif(count(*) FILTER (WHERE dealer_risk_flag = 'Normal'), 0) AS normal,
           nullif(count(*) FILTER (WHERE dealer_risk_flag = 'Monitor'), 0) AS monitor,
           nullif(count(*) FILTER (WHERE dealer_risk_flag = 'High Risk Dealer'), 0) AS high_risk
           FROM dash""", "dash"),
    "distinct_dealers": statement("SELECT DISTINCT dealer_id FROM dash", "dash"),
    "distinct_categories": statement(
        "SELECT DISTINCT category, subcategory FROM gapclass", "gapclass"),
    "distinct_dealer_names": statement(
        "SELECT DISTINCT dealer_code, dealer_name FROM perf", "perf"),
    "complaint_trends": statement("SELECT * FROM trends", "trends"),
    "dealer_performance": statement("SELECT * FROM perf", "perf"),
    "vehicle_risk_profile": statement("SELECT * FROM profile", "profile"),
    "checklist_gap_analysis": statement("SELECT * FROM gapclass", "gapclass"),
    "summary_cards": statement(
        f"""SELECT * FROM
            (SELECT coalesce(sum(complaint_count), 0)::BIGINT AS total_complaints,
                    coalesce(sum(open_count), 0)::BIGINT AS open_complaints,
                    coalesce(sum(resolved_count), 0)::BIGINT AS resolved_complaints,
                    {_mean('avg_ai_confidence', 2)} AS avg_ai_confidence FROM trends),
            (SELECT count(*) AS total_dealers,
                    coalesce(sum(total_inspections), 0)::BIGINT AS total_inspections,
                    {_mean('complaint_rate_pct', 1)} AS avg_complaint_rate,
                    {_mean('fail_rate_pct', 1)} AS avg_fail_rate FROM perf),
            (SELECT count(*) AS total_vehicles,
                    count(*) FILTER (WHERE risk_level = 'High') AS high_risk,
                    count(*) FILTER (WHERE risk_level = 'Medium') AS medium_risk,
                    count(*) FILTER (WHERE risk_level = 'Low') AS low_risk FROM profile),
            (SELECT count(*) AS total_gaps,
                    count(*) FILTER (WHERE gap_classification = 'Critical Gap')
                        AS critical_gaps,
                    {_mean('pdi_catch_rate_pct', 1)} AS avg_catch_rate FROM gapclass)""",
        "trends", "perf", "profile", "gapclass", stored=True),
    "gap_context": statement(
        """SELECT category, string_agg('- Complaint: ' || coalesce(category, 'None') || '/' || subcategory
               || ' (count=' || complaint_count || ', PDI catch rate=' || pdi_catch_rate_pct
               || '%, gap=' || gap_classification || ')', chr(10) ORDER BY rn) AS context
           FROM (SELECT *, row_number() OVER (PARTITION BY category
                     ORDER BY complaint_count DESC, subcategory) AS rn FROM gapclass)
           WHERE rn <= 15 GROUP BY category""", "gapclass"),
    "stored_gap_context": statement(
        """SELECT category, string_agg('- Complaint: ' || coalesce(category, 'None') || '/' || subcategory
               || ' (count=' || complaint_count || ', PDI catch rate=' || pdi_catch_rate_pct
               || '%, gap=' || gap_classification || ')', chr(10) ORDER BY rn) AS context
           FROM (SELECT *, row_number() OVER (PARTITION BY category
                     ORDER BY complaint_count DESC, subcategory) AS rn FROM gapclass)
           WHERE rn <= 15 GROUP BY category""", "gapclass", stored=True),
    "dashboard_from_states": statement("SELECT * FROM dash_month", "dash_month", stored=True),
    "quarterly_dashboard": statement("SELECT * FROM dash_quarter", "dash_quarter", stored=True),
    "stored_categories": statement(
        "SELECT DISTINCT category, subcategory FROM gapclass", "gapclass", stored=True),
    "stored_dealers": statement("SELECT DISTINCT dealer_id FROM dash", "dash", stored=True),
    "stored_gap_class": statement(
        f"""SELECT * FROM gapclass WHERE category = {_q(LOOKUP_CATEGORY)}
            AND subcategory = {_q(LOOKUP_SUBCATEGORY)}""", "gapclass", stored=True),
    "stored_dealer_risk": statement(
        "SELECT dealer_risk_flag, count(*) AS cnt FROM dash GROUP BY ALL", "dash", stored=True),
    "stored_top_recommendations": statement(
        f"""SELECT * FROM ranked WHERE contains(what_customers_complain_about, {_q(LOOKUP_TEXT)})
            ORDER BY priority DESC LIMIT 5""", "ranked", stored=True),
    "stored_complaints_of": statement(
        f"SELECT {_LINKED} FROM detail WHERE complaint_category = {_q(LOOKUP_CATEGORY)}", "detail", stored=True),
    "risk_score_sql": statement("SELECT vehicle_id, risk_score FROM risk", "risk"),
    "risk_score_function": statement("SELECT vehicle_id, risk_score FROM risk", "risk"),
    "risk_score_model": statement(_MODEL, "scorer"),
    "inspection_score": statement("SELECT * FROM scored", "scored"),
    "inspection_score_clamped": statement(
        """SELECT inspection_id, count(*)::INTEGER AS items_checked,
           (count(*) FILTER (WHERE result = 'FAIL'))::INTEGER AS items_failed,
           (count(*) FILTER (WHERE result = 'QUICK_FIX'))::INTEGER AS items_quick_fix,
           least(100, 15 * items_failed + 5 * items_quick_fix)::DOUBLE AS risk_score,
           0.85::DOUBLE AS risk_confidence,
           CASE WHEN items_failed > 0 THEN 'FAIL' WHEN items_quick_fix > 0
                THEN 'CONDITIONAL_PASS' ELSE 'PASS' END AS overall_result,
           items_failed = 0 AS delivery_cleared FROM form GROUP BY inspection_id""", "form"),
    "recurrence_pairs": statement("SELECT * FROM cases", "cases"),
    "recurrence_rates": statement("SELECT * FROM rates", "rates"),
    "inspection_decision": statement(_DECISION, "scored", "sub", "rates"),
    "default_actions": statement(
        _wide("sub", "coalesce(max(result) FILTER (WHERE key = '@'), 'PASS') AS \"@_result\", "
              "coalesce(max(CASE WHEN result = 'PASS' THEN '' WHEN fix <> '' THEN fix "
              f"WHEN result = 'FAIL' THEN {_q(V.SUBMIT_ACTIONS['FAIL'])} "
              f"ELSE {_q(V.SUBMIT_ACTIONS['QUICK_FIX'])} END) FILTER (WHERE key = '@'), '') "
              "AS \"@_action\""), "sub"),
    "worst_status": statement(
        _wide("(SELECT DISTINCT ON (inspection_id, label) * FROM form "
              "ORDER BY inspection_id, label, idx)",
              _worst(["PASS", "QUICK_FIX", "FAIL"], "_result") + ", "
              + _worst([None, V.FORM_ACTIONS["QUICK_FIX"], V.FORM_ACTIONS["FAIL"]], "_action")),
        "form"),
    "checklist_unpivot": statement("SELECT inspection_id, item, result, action FROM si", "si"),
    "checklist_pivot":
        _wide("(SELECT l_orderkey AS inspection_id, "
              f"{_list(V.CHECKLIST_KEYS)}[l_partkey % {len(V.CHECKLIST_KEYS)} + 1] AS key, "
              "CASE WHEN l_returnflag = 'N' THEN 'QUICK_FIX' WHEN l_returnflag = 'R' "
              "AND l_quantity <= 4 THEN 'FAIL' ELSE 'PASS' END AS result FROM lineitem)",
              _worst(["PASS", "QUICK_FIX", "FAIL"], "_result")),
    "spike_alert": statement("SELECT * FROM alert", "alert"),
    "stream_spike_alert": statement("SELECT * FROM alert", "alert"),
    "stream_ingest": statement("SELECT * FROM c", "c"),
}
