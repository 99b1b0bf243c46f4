"""Oracle SQL for the data-quality checks and the explorer profiles."""

from __future__ import annotations

from lossledger.oracle.base import avg_sql, count_if_sql, pct_sql, round_div_sql, sum_money_sql, with_base
from lossledger.plans.quality import RAW_EDGES, RAW_KEYS, STAR_EDGES
from lossledger.plans.star import FACT_CLAIMS_COLUMNS
from lossledger.sources.reference import REQUIRED_SOURCE_TABLES

RAW_CTE = {"LINE_OF_BUSINESS": "r_lob", "INSURED": "r_insured", "VENDOR": "r_vendor",
           "CATASTROPHE": "r_catastrophe", "POLICY": "r_policy", "CLAIMS": "r_claims",
           "CLAIM_ASSIGNMENT": "(SELECT CLAIM_ID AS ASSIGNMENT_ID, CLAIM_ID FROM r_claims)",
           "FINANCIAL_DATA": "r_financial", "CLAIMS_EXPENSE": "r_expense", "LITIGATION": "r_litigation"}
STAR_CTE = {"DIM_DATE": "dim_date", "DIM_CLAIM_TYPE": "dim_claim_type", "DIM_LOSS_CAUSE": "dim_loss_cause",
            "DIM_GEOGRAPHY": "dim_geography", "DIM_POLICY": "dim_policy", "DIM_WEATHER_EVENT": "dim_weather_event",
            "FACT_CLAIMS": "fact_claims", "FACT_CLAIM_EXPENSE": "fact_expense"}

NUMERIC_FACT_COLUMNS = [c for c in FACT_CLAIMS_COLUMNS if c != "DATE_KEY" and c.endswith(("_KEY", "_AMOUNT", "_INCURRED", "_LOSS",
                                                                      "_SCORE", "EXPOSURES", "_COSTS"))
                        or c.startswith("DAYS_")]

Q: dict[str, str] = {}


def _edge(child, fk, parent, pk):
    return (f"SELECT COUNT({fk}) AS CHILD_KEYS, {count_if_sql(f'{fk} IS NULL')} AS NULL_KEYS, "
            f"(SELECT COUNT(*) FROM {child} c WHERE c.{fk} IS NOT NULL "
            f"AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk} = c.{fk})) AS ORPHAN_ROWS FROM {child}")


Q["orphan_keys"] = with_base("\nUNION ALL\n".join(
    f"SELECT '{c}' AS CHILD_TABLE, '{fk}' AS CHILD_COLUMN, '{p}' AS PARENT_TABLE, '{pk}' AS PARENT_COLUMN, "
    f"CHILD_KEYS, NULL_KEYS, ORPHAN_ROWS FROM ({_edge(RAW_CTE[c], fk, RAW_CTE[p], pk)})"
    for c, fk, p, pk in RAW_EDGES))

Q["primary_key_check"] = with_base("\nUNION ALL\n".join(
    f"SELECT '{t}' AS TABLE_NAME, '{k}' AS KEY_COLUMN, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS ROWS, "
    f"COUNT(k) AS DISTINCT_KEYS, {count_if_sql('n > 1')} AS DUPLICATE_KEYS, "
    f"{count_if_sql('k IS NULL')} AS NULL_KEY_GROUPS "
    f"FROM (SELECT {k} AS k, COUNT(*) AS n FROM {RAW_CTE[t]} GROUP BY {k})"
    for t, k in RAW_KEYS))

Q["relationship_map"] = with_base("\nUNION ALL\n".join(
    f"SELECT '{fact}' AS FACT_TABLE, '{fk}' AS FK_COLUMN, '{dim}' AS DIM_TABLE, '{pk}' AS DIM_COLUMN, "
    f"CHILD_KEYS - ORPHAN_ROWS AS MATCHED_ROWS, ORPHAN_ROWS AS UNMATCHED_ROWS, NULL_KEYS "
    f"FROM ({_edge(STAR_CTE[fact], fk, STAR_CTE[dim], pk)})"
    for fact, edges in STAR_EDGES.items() for fk, dim, pk in edges))

Q["fk_coverage"] = with_base(f"""
SELECT COUNT(*) AS TOTAL_CLAIMS, COUNT(DISTINCT CLAIM_KEY) AS UNIQUE_CLAIMS, COUNT(DATE_KEY) AS HAS_DATE,
  COUNT(GEOGRAPHY_KEY) AS HAS_GEOGRAPHY, COUNT(CLAIM_TYPE_KEY) AS HAS_CLAIM_TYPE,
  COUNT(LOSS_CAUSE_KEY) AS HAS_LOSS_CAUSE, COUNT(WEATHER_EVENT_KEY) AS HAS_WEATHER_EVENT,
  COUNT(POLICY_KEY) AS HAS_POLICY, {count_if_sql("FRAUD_INDICATOR")} AS FRAUD_FLAGGED,
  {count_if_sql("IS_WEATHER_RELATED")} AS WEATHER_RELATED
FROM fact_claims""")

_req = " UNION ALL ".join(f"SELECT '{t}' AS TABLE_NAME" for t in REQUIRED_SOURCE_TABLES)
_have = " UNION ALL ".join(f"SELECT '{t}' AS TABLE_NAME, COUNT(*) AS ROW_COUNT FROM {RAW_CTE[t]}"
                           for t in RAW_CTE)
Q["required_tables"] = with_base(f"""
SELECT r.TABLE_NAME, h.ROW_COUNT IS NOT NULL AS FOUND, h.ROW_COUNT
FROM ({_req}) r LEFT JOIN ({_have}) h ON r.TABLE_NAME = h.TABLE_NAME""")


def _checks(table, cte, checks):
    return "\nUNION ALL\n".join(f"SELECT '{table}' AS TABLE_NAME, '{n}' AS CHECK_NAME, CAST({e} AS VARCHAR) AS VALUE "
                                f"FROM {cte}" for n, e in checks)


Q["build_validation"] = with_base("\nUNION ALL\n".join([
    _checks("DIM_DATE", "dim_date", [("ROWS", "COUNT(*)"), ("MIN_DATE", "MIN(DATE_KEY)"),
                                     ("MAX_DATE", "MAX(DATE_KEY)")]),
    _checks("DIM_CLAIM_TYPE", "dim_claim_type", [("ROWS", "COUNT(*)"),
                                                 ("CATEGORIES", "COUNT(DISTINCT CLAIM_CATEGORY)")]),
    _checks("DIM_LOSS_CAUSE", "dim_loss_cause", [("ROWS", "COUNT(*)"),
                                                 ("WEATHER_CAUSES", count_if_sql("IS_WEATHER_RELATED"))]),
    _checks("DIM_GEOGRAPHY", "dim_geography", [("ROWS", "COUNT(*)"), ("REGIONS", "COUNT(DISTINCT REGION)"),
                                               ("STATES", "COUNT(DISTINCT STATE_CODE)")]),
    _checks("DIM_POLICY", "dim_policy", [("ROWS", "COUNT(*)"), ("COVERAGE_TYPES", "COUNT(DISTINCT COVERAGE_TYPE)")]),
    _checks("DIM_WEATHER_EVENT", "dim_weather_event", [("ROWS", "COUNT(*)"),
                                                       ("SEVERITY_TIERS", "COUNT(DISTINCT EVENT_SEVERITY_TIER)")]),
    _checks("FACT_CLAIMS", "fact_claims", [("ROWS", "COUNT(*)"), ("OPEN_CLAIMS", count_if_sql("CLAIM_STATUS = 'Open'")),
                                           ("TOTAL_PAID", sum_money_sql("PAID_AMOUNT"))]),
    _checks("FACT_CLAIM_EXPENSE", "fact_expense", [("ROWS", "COUNT(*)"),
                                                   ("CATEGORIES", "COUNT(DISTINCT EXPENSE_CATEGORY)"),
                                                   ("TOTAL_ACTUAL", sum_money_sql("TOTAL_ACTUAL_EXPENSE"))]),
]))

_x = "PAID_AMOUNT"
_lo = round_div_sql("s.mn * 30 + (s.mx - s.mn) * h.BIN", "30", 2, 2, 0)
_hi = round_div_sql("s.mn * 30 + (s.mx - s.mn) * (h.BIN + 1)", "30", 2, 2, 0)
Q["numeric_histogram"] = with_base(f"""
SELECT h.BIN, {_lo} AS BIN_LOW, {_hi} AS BIN_HIGH, h.COUNT, s.MEAN
FROM (SELECT BIN, COUNT(*) AS COUNT FROM (
        SELECT CAST(CASE WHEN s.mx = s.mn THEN 0
                    ELSE least(29, CAST((x - s.mn) * 30 * 100 AS BIGINT) // CAST((s.mx - s.mn) * 100 AS BIGINT))
                    END AS INTEGER) AS BIN
        FROM (SELECT {_x} AS x FROM fact_claims WHERE {_x} IS NOT NULL) v, stats s)
      GROUP BY BIN) h, stats s""", [("stats", f"SELECT MIN({_x}) AS mn, MAX({_x}) AS mx, {avg_sql(_x, 2)} AS MEAN "
                                              f"FROM fact_claims WHERE {_x} IS NOT NULL")])

Q["category_top_n"] = with_base("""
SELECT CLAIM_CITY AS VALUE, COUNT(*) AS COUNT FROM r_claims WHERE CLAIM_CITY IS NOT NULL
GROUP BY CLAIM_CITY ORDER BY COUNT DESC, VALUE ASC LIMIT 15""")

Q["numeric_profile"] = with_base("\nUNION ALL\n".join(
    f"SELECT '{c}' AS COLUMN_NAME, CAST(MIN({c}) AS DECIMAL(38,6)) AS MIN_VALUE, "
    f"CAST(MAX({c}) AS DECIMAL(38,6)) AS MAX_VALUE, {avg_sql(f'CAST({c} AS DECIMAL(38,2))', 2)} AS AVG_VALUE, "
    f"COUNT(DISTINCT {c}) AS DISTINCT_COUNT FROM fact_claims"
    for c in NUMERIC_FACT_COLUMNS))

Q["null_profile"] = with_base("\nUNION ALL\n".join(
    f"SELECT {i + 1} AS ORDINAL, '{c}' AS COLUMN_NAME, {count_if_sql(f'{c} IS NULL')} AS NULLS, "
    f"{pct_sql(count_if_sql(f'{c} IS NULL'), 'COUNT(*)', 1)} AS NULL_PCT FROM fact_claims"
    for i, c in enumerate(FACT_CLAIMS_COLUMNS)))

_keys = ["DATE_KEY", "GEOGRAPHY_KEY", "CLAIM_TYPE_KEY", "LOSS_CAUSE_KEY", "WEATHER_EVENT_KEY", "POLICY_KEY"]
Q["distinct_counts"] = with_base("SELECT " + ", ".join(f"COUNT(DISTINCT {k}) AS DISTINCT_{k}" for k in _keys)
                                 + " FROM fact_claims")

# -- profiles of a double and of a long column of a given table ---------------------
Q["numeric_profile_events"] = """
SELECT 'value' AS COLUMN_NAME, CAST(MIN(value) AS DECIMAL(38,6)) AS MIN_VALUE, CAST(MAX(value) AS DECIMAL(38,6)) AS MAX_VALUE,
  CAST(ROUND(AVG(value), 2) AS DECIMAL(38,2)) AS AVG_VALUE, COUNT(DISTINCT value) AS DISTINCT_COUNT FROM events
UNION ALL
SELECT 'event_id', CAST(MIN(event_id) AS DECIMAL(38,6)), CAST(MAX(event_id) AS DECIMAL(38,6)),
  CAST(ROUND(CAST(SUM(event_id) AS DECIMAL(38,6)) / COUNT(event_id), 2) AS DECIMAL(38,2)), COUNT(DISTINCT event_id) FROM events"""
Q["histogram_event_value"] = """
WITH s AS (SELECT MIN(value) AS mn, MAX(value) AS mx, ROUND(AVG(value), 6) AS MEAN FROM events),
b AS (SELECT CAST(CASE WHEN mx = mn THEN 0 ELSE least(29, floor((value - mn) * 30 / (mx - mn))) END AS INTEGER) AS BIN, COUNT(*) AS COUNT
      FROM events, s WHERE value IS NOT NULL GROUP BY 1)
SELECT BIN, ROUND(mn + (mx - mn) * BIN / 30, 6) AS BIN_LOW, ROUND(mn + (mx - mn) * (BIN + 1) / 30, 6) AS BIN_HIGH, COUNT, MEAN FROM b, s"""
Q["histogram_event_id"] = """
WITH s AS (SELECT MIN(event_id) AS mn, MAX(event_id) AS mx,
             CAST(ROUND(CAST(SUM(event_id) AS DECIMAL(38,6)) / COUNT(event_id), 2) AS DECIMAL(38,2)) AS MEAN FROM events),
b AS (SELECT CAST(CASE WHEN mx = mn THEN 0 ELSE least(29, ((event_id - mn)::HUGEINT * 30) // (mx - mn)) END AS INTEGER) AS BIN, COUNT(*) AS COUNT
      FROM events, s WHERE event_id IS NOT NULL GROUP BY 1)
SELECT BIN, CAST(ROUND(CAST(mn * 30 + (mx - mn) * BIN AS DECIMAL(36,6)) / 30, 2) AS DECIMAL(38,2)) AS BIN_LOW,
  CAST(ROUND(CAST(mn * 30 + (mx - mn) * (BIN + 1) AS DECIMAL(36,6)) / 30, 2) AS DECIMAL(38,2)) AS BIN_HIGH, COUNT, MEAN FROM b, s"""
