"""Oracle SQL for the intake checks: quarantine, cleansing, sketches, storage, lineage."""

from __future__ import annotations

from lossledger.oracle.base import with_base
from lossledger.plans.intake import GIVEN, LINEAGE, SKETCHED

INTAKE: dict[str, str] = {}

_CLAIM_RULES = [
    ("claim_without_policy", "POLICY_ID IS NULL"), ("claim_without_stage", "CLAIM_STAGE IS NULL"),
    ("unknown_severity", "CLAIM_SEVERITY NOT IN ('Minor', 'Moderate', 'Significant', 'Severe')"),
    ("fraud_score_out_of_range", "FRAUD_SCORE < 0 OR FRAUD_SCORE > 90"), ("reported_before_loss", "LOSS_DATE > REPORTED_DATE"),
    ("changed_after_last_activity", "SEVERITY_CHANGE_DATE > LAST_ACTIVITY_DATE"),
    ("second_claim_on_a_day", "POLICY_ID IS NOT NULL AND LOSS_DATE IS NOT NULL AND COUNT(*) OVER (PARTITION BY POLICY_ID, LOSS_DATE) > 1"),
    ("unknown_vendor", "VENDOR_ID NOT IN (SELECT VENDOR_ID FROM r_vendor)"),
]
_LINE_RULES = [
    ("quantity_out_of_range", "l_quantity < 1 OR l_quantity > 45"), ("unknown_return_flag", "l_returnflag NOT IN ('A', 'N')"),
    ("repeated_line", "COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1"),
    ("order_not_final", "l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')"),
]


def _judged(table: str, rules) -> str:
    return f"SELECT *, list_filter([{', '.join(f'CASE WHEN {cond} THEN {name!r} END' for name, cond in rules)}], lambda x: x IS NOT NULL) AS reasons FROM {table}"


def _counts(rules) -> str:
    one = [f"SELECT '{name}' AS RULE, COUNT(*) FILTER (list_contains(reasons, '{name}')) AS ROWS FROM judged" for name, _ in rules]
    return "\nUNION ALL\n".join([*one, "SELECT 'QUARANTINED', COUNT(*) FILTER (len(reasons) > 0) FROM judged", "SELECT 'KEPT', COUNT(*) FILTER (len(reasons) = 0) FROM judged"])


INTAKE["quarantine_claims_counts"] = with_base(_counts(_CLAIM_RULES), [("judged", _judged("r_claims", _CLAIM_RULES))])
INTAKE["quarantined_claims"] = with_base("SELECT CLAIM_ID, CLAIM_STATUS, array_to_string(reasons, ', ') AS REASONS FROM judged WHERE len(reasons) > 0",
                                         [("judged", _judged("r_claims", _CLAIM_RULES))])
INTAKE["quarantine_line_counts"] = f"WITH judged AS ({_judged('lineitem', _LINE_RULES)})\n{_counts(_LINE_RULES)}"
INTAKE["kept_lines"] = f"""WITH judged AS ({_judged('lineitem', _LINE_RULES)})
SELECT l_linestatus, COUNT(*) AS ROWS, CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS PRICE FROM judged WHERE len(reasons) = 0 GROUP BY 1"""

_TEXT = """
texts AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id,
    CASE WHEN event_id % 19 = 0 THEN '2024-13-45 00:00:00' WHEN event_id % 23 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts,
    CASE WHEN event_id % 29 = 0 THEN 'user-' || CAST(user_id AS VARCHAR) ELSE '  ' || CAST(user_id AS VARCHAR) || ' ' END AS user_id,
    CASE WHEN event_id % 31 = 0 THEN 'N/A' ELSE event_type END AS event_type,
    CASE WHEN event_id % 13 = 0 THEN ' n/a' WHEN event_id % 17 = 0 THEN CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) || ' EUR'
         ELSE CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END AS value FROM events
), clean AS (
  SELECT """ + ", ".join(
    f"CASE WHEN lower(trim({c})) NOT IN ('', 'null', 'none', 'n/a', 'na', '-') THEN trim({c}) END AS {c}" for c in ("event_id", "ts", "user_id", "event_type", "value")) + """ FROM texts
), typed AS (
  SELECT TRY_CAST(event_id AS BIGINT) AS event_id, TRY_CAST(ts AS TIMESTAMP) AS ts, TRY_CAST(user_id AS BIGINT) AS user_id, event_type,
    TRY_CAST(value AS DECIMAL(12,2)) AS value,
    CASE WHEN TRY_CAST(ts AS TIMESTAMP) IS NULL THEN ts END AS rescued_ts, CASE WHEN TRY_CAST(user_id AS BIGINT) IS NULL THEN user_id END AS rescued_user_id,
    CASE WHEN TRY_CAST(value AS DECIMAL(12,2)) IS NULL THEN value END AS rescued_value FROM clean
)"""
INTAKE["cleansed_events"] = f"WITH {_TEXT}\nSELECT * FROM typed"
INTAKE["cleansing_report"] = f"WITH {_TEXT}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS COLUMN_NAME, COUNT(*) AS ROWS, COUNT({c}) AS READ, COUNT(*) - COUNT({c}) - {f} AS MISSING, {f} AS FAILED FROM typed"
    for c, f in (("event_id", "0"), ("ts", "COUNT(rescued_ts)"), ("user_id", "COUNT(rescued_user_id)"), ("event_type", "0"), ("value", "COUNT(rescued_value)")))

INTAKE["distinct_by_sketch"] = with_base("\nUNION ALL\n".join(
    f"SELECT '{name}' AS PERIOD, '{c}' AS COLUMN_NAME, COUNT({c}) AS ROWS, COUNT(DISTINCT {c}) AS EXACT, TRUE AS CLOSE FROM fact_claims WHERE {cond}"
    for name, cond in (("1996", "year(DATE_KEY) = 1996"), ("1997-1998", "year(DATE_KEY) IN (1997, 1998)"), ("ALL", "TRUE")) for c in SKETCHED))

# FIXED VALUES — columns of the given tables
_COLUMNS = {"customer": 5, "events": 6, "lineitem": 11, "nation": 3, "orders": 6, "part": 6, "region": 2, "supplier": 4}
INTAKE["given_storage"] = "WITH t AS (" + "\nUNION ALL\n".join(
    f"SELECT '{t}' AS TABLE_NAME, COUNT(*) AS ROW_COUNT, CAST({_COLUMNS[t]} AS BIGINT) AS COLUMN_COUNT, TRUE AS STORED FROM {t}" for t in GIVEN) + """)
SELECT * FROM t UNION ALL SELECT 'TOTAL', CAST(SUM(ROW_COUNT) AS BIGINT), CAST(SUM(COLUMN_COUNT) AS BIGINT), TRUE FROM t"""

_CTE = {"LINE_OF_BUSINESS": "r_lob", "CATASTROPHE": "r_catastrophe", "POLICY": "r_policy", "INSURED": "r_insured", "CLAIMS": "r_claims", "FINANCIAL_DATA": "r_financial",
        "LITIGATION": "r_litigation", "CLAIMS_EXPENSE": "r_expense", "DIM_CLAIM_TYPE": "dim_claim_type", "DIM_WEATHER_EVENT": "dim_weather_event", "DIM_POLICY": "dim_policy",
        "DIM_LOSS_CAUSE": "dim_loss_cause", "DIM_GEOGRAPHY": "dim_geography", "FACT_CLAIMS": "fact_claims", "FACT_CLAIM_EXPENSE": "fact_expense"}


def _sum(table: str, cols: list[str], distinct: bool, without: str | None) -> str:
    where = {"zero": " WHERE " + " OR ".join(f"{c} <> 0" for c in cols[1:]), "no status": f" WHERE {cols[1]} IS NOT NULL"}.get(without, "") if without else ""
    text = " || '|' || ".join(f"COALESCE(CAST({c} AS VARCHAR), '~')" for c in cols)
    return (f"(SELECT COUNT(*) AS n, CAST(COALESCE(SUM(CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)), 0) AS VARCHAR) AS s "
            f"FROM (SELECT {'DISTINCT ' if distinct else ''}{', '.join(cols)} FROM {_CTE[table]}{where}))")


INTAKE["lineage_reconciliation"] = with_base("\nUNION ALL\n".join(
    f"SELECT '{raw}' AS RAW_TABLE, '{star}' AS STAR_TABLE, '{', '.join(cols)}' AS COLUMNS, a.n AS RAW_ROWS, b.n AS STAR_ROWS, a.s AS RAW_CHECKSUM, "
    f"b.s AS STAR_CHECKSUM, a.n = b.n AND a.s = b.s AS RECONCILED FROM {_sum(raw, cols, d, w)} a, {_sum(star, kept, d, w)} b"
    for raw, cols, star, kept, d, w in LINEAGE))
