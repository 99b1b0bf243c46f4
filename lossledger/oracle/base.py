"""DuckDB SQL for the raw claims tables and the star schema.

These CTEs restate, in plain SQL over the driver's pre-registered views
(orders, customer, nation, supplier, lineitem, events), the same mapping
that `lossledger.sources.raw` and `lossledger.plans.star` build with Spark.
Each oracle query is `WITH <these CTEs>, <its own> SELECT ...`; DuckDB only
evaluates the CTEs a query references.

Exact-rounding helpers: DuckDB divides decimals as DOUBLE, so averages and
percentages are rounded with integer arithmetic (`round_div_sql`) and typed
DECIMAL(38,k), matching the decimal quotient Spark computes.
"""

from __future__ import annotations

from lossledger.context import DEFAULT_AS_OF
from lossledger.functions.pick import pick_sql, sql_values
from lossledger.sources import reference as ref

AS_OF = f"DATE '{DEFAULT_AS_OF.isoformat()}'"


def round_div_sql(num: str, den: str, k: int, num_scale: int = 2, den_scale: int = 0) -> str:
    """ROUND(num / den, k) half away from zero, exact, as DECIMAL(38,k).

    `num` / `den` are decimal or integer expressions with at most
    `num_scale` / `den_scale` fractional digits; both are scaled to integers
    and divided with integer arithmetic. NULL when den is 0 or NULL."""
    n = f"CAST(({num}) * {10 ** num_scale} AS HUGEINT)"
    d = f"CAST(NULLIF({den}, 0) * {10 ** den_scale} AS HUGEINT)"
    top = f"(ABS({n}) * {10 ** (den_scale + k)})"
    bottom = f"(ABS({d}) * {10 ** num_scale})"
    q = f"(SIGN({n}) * SIGN({d}) * ((2 * {top} + {bottom}) // (2 * {bottom})))"
    unit = "1" if k == 0 else "0." + "0" * (k - 1) + "1"
    return f"CAST(CAST({q} AS DECIMAL(38,0)) * {unit} AS DECIMAL(38,{k}))"


def avg_sql(col: str, k: int, num_scale: int = 2) -> str:
    return round_div_sql(f"SUM({col})", f"COUNT({col})", k, num_scale)


def pct_sql(part: str, whole: str, k: int, part_scale: int = 0, whole_scale: int = 0) -> str:
    return round_div_sql(f"({part}) * 100", whole, k, part_scale, whole_scale)


def count_if_sql(cond: str) -> str:
    return f"CAST(COALESCE(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END), 0) AS BIGINT)"


def sum_money_sql(col: str) -> str:
    return f"CAST(COALESCE(SUM({col}), 0) AS DECIMAL(38,2))"


def _case_bands(expr: str, bands) -> str:
    parts = " ".join(f"WHEN {expr} < {u} THEN '{s}'" for u, s in bands)
    return f"CASE {parts} END"


def _case_map(expr: str, pairs, default="NULL") -> str:
    parts = " ".join(f"WHEN {expr} = '{a}' THEN {b!r}" if isinstance(b, str) else f"WHEN {expr} = '{a}' THEN {b}"
                     for a, b in pairs)
    return f"CASE {parts} ELSE {default} END"


def _sev_from_priority(expr: str) -> str:
    return "CASE " + " ".join(f"WHEN {expr} = '{p}' THEN '{s}'" for p, s in ref.PRIORITY_SEVERITY) + " END"


def _zip5(expr: str) -> str:
    return f"lpad(CAST({expr} AS VARCHAR), 5, '0')"


def _d(base: str, n: str) -> str:
    return f"CAST({base} + CAST({n} AS INTEGER) AS DATE)"


def raw_ctes() -> list[tuple[str, str]]:
    k = "o.o_orderkey"
    claims = f"""
SELECT
  {k} AS CLAIM_ID,
  'CLM-' || lpad(CAST({k} AS VARCHAR), 8, '0') AS CLAIM_NUMBER,
  o.o_custkey AS POLICY_ID,
  o.o_custkey AS INSURED_ID,
  CAST({k} % 15 + 1 AS INTEGER) AS LOB_ID,
  CAST(o.o_orderdate AS DATE) AS LOSS_DATE,
  {_d('CAST(o.o_orderdate AS DATE)', f'{k} % 14 + 1')} AS REPORTED_DATE,
  {_d('CAST(o.o_orderdate AS DATE)', f'{k} % 14 + {k} % 7 + 2')} AS OPEN_DATE,
  CASE WHEN {k} % 100 < 60 THEN {_d('CAST(o.o_orderdate AS DATE)', f'({k} * 7) % 180 + 30')} END AS CLOSE_DATE,
  {pick_sql(ref.CAUSE_SEQUENCE, f'{k} % 15')} AS LOSS_CAUSE,
  'Claim for ' || {pick_sql(ref.CAUSE_DESCRIPTIONS + [ref.CAUSE_DESCRIPTION_DEFAULT] * 12, f'{k} % 15')}
    || ' - Claim #' || CAST({k} AS VARCHAR) AS LOSS_DESCRIPTION,
  ({k} % 100 < 15) AS CAT_INDICATOR,
  CASE WHEN {k} % 100 < 15 THEN CAST({k} % 15 + 1 AS INTEGER) END AS CATASTROPHE_ID,
  ({k} % 100 < 12) AS LITIGATION_INDICATOR,
  {_sev_from_priority('o.o_orderpriority')} AS CLAIM_SEVERITY,
  CASE WHEN {k} % 4 = 0 THEN {pick_sql(ref.SEVERITIES, f'({k} + 1) % 5')} END AS PREVIOUS_SEVERITY,
  CASE WHEN {k} % 4 = 0 THEN {_d(AS_OF, f'-({k} % 60)')} END AS SEVERITY_CHANGE_DATE,
  CASE WHEN {k} % 4 = 0 THEN {pick_sql(ref.CHANGE_STAGES, f'{k} % 6')} END AS SEVERITY_CHANGE_STAGE,
  {_case_bands(f'{k} % 100', ref.STATUS_BANDS)} AS CLAIM_STATUS,
  {pick_sql(ref.CLAIM_STAGES, f'{k} % 12')} AS CLAIM_STAGE,
  {pick_sql(ref.CLAIM_STATES, 'c.c_nationkey % 10')} AS CLAIM_STATE,
  n.n_name AS CLAIM_CITY,
  {_zip5('10000 + (c.c_custkey * 13) % 90000')} AS CLAIM_ZIP,
  ({k} % 100 < 8) AS FRAUD_INDICATOR,
  CAST(CASE WHEN {k} % 100 < 8 THEN 50 + ({k} * 7) % 50 WHEN {k} % 100 < 20 THEN ({k} * 3) % 50 ELSE 0 END
       AS DECIMAL(5,2)) AS FRAUD_SCORE,
  ({k} % 100 < 18) AS SUBROGATION_INDICATOR,
  CAST({k} % 200 + 1 AS INTEGER) AS VENDOR_ID,
  CAST({k} % 5 + 1 AS INTEGER) AS EXPOSURES,
  {_d(AS_OF, f'-({k} % 90)')} AS LAST_ACTIVITY_DATE,
  CAST({_d('CAST(o.o_orderdate AS DATE)', f'{k} % 7')} AS TIMESTAMP) AS CREATED_DATE,
  CAST({_d(AS_OF, f'-({k} % 30)')} AS TIMESTAMP) AS MODIFIED_DATE,
  CAST(o.o_totalprice AS DECIMAL(15,2)) AS ORDER_TOTAL
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey"""

    i = "c_custkey"
    email_first = pick_sql(ref.EMAIL_FIRST + [ref.EMAIL_FIRST_DEFAULT] * 40, f"{i} % 50")
    email_last = pick_sql(ref.EMAIL_LAST + [ref.EMAIL_LAST_DEFAULT] * 47, f"({i} // 50) % 50")
    insured = f"""
SELECT
  {i} AS INSURED_ID,
  'Customer' AS FIRST_NAME,
  c_name AS LAST_NAME,
  CAST(1000 + ({i} * 7) % 9000 AS VARCHAR) || ' ' || {pick_sql(ref.STREETS, f'{i} % 10')} || ' '
    || {pick_sql(ref.STREET_SUFFIXES, f'{i} % 4')} AS ADDRESS,
  n_name AS CITY,
  {pick_sql(ref.CLAIM_STATES, 'c_nationkey % 10')} AS STATE,
  {_zip5(f'10000 + ({i} * 13) % 90000')} AS ZIP_CODE,
  '(' || lpad(CAST(100 + ({i} * 3) % 900 AS VARCHAR), 3, '0') || ') '
    || lpad(CAST(100 + ({i} * 7) % 900 AS VARCHAR), 3, '0') || '-'
    || lpad(CAST(1000 + ({i} * 11) % 9000 AS VARCHAR), 4, '0') AS PHONE,
  lower({email_first} || '.' || {email_last} || CAST({i} + 1 AS VARCHAR) || '@'
    || {pick_sql(ref.EMAIL_DOMAINS, f'{i} % 5')}) AS EMAIL,
  {_d(AS_OF, f'-(18 * 365) - ({i} * 17) % (50 * 365)')} AS DATE_OF_BIRTH,
  CAST({_d(AS_OF, f'-(({i} * 3) % 2000)')} AS TIMESTAMP) AS CREATED_DATE
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

    eff = _d("DATE '2000-01-01'", f"-(({i} * 47) % 1800)")
    term = pick_sql(ref.POLICY_TERMS, f"{i} % 3")
    policy = f"""
SELECT
  {i} AS POLICY_ID,
  'POL-' || lpad(CAST({i} AS VARCHAR), 6, '0') AS POLICY_NUMBER,
  {i} AS INSURED_ID,
  CAST({i} % 15 + 1 AS INTEGER) AS LOB_ID,
  {eff} AS POLICY_EFFECTIVE_DATE,
  CAST({eff} + to_months({term}) AS DATE) AS POLICY_EXPIRATION_DATE,
  CAST({term} AS INTEGER) AS POLICY_TERM_MONTHS,
  {pick_sql(ref.COVERAGE_TYPES, f'{i} % 5')} AS COVERAGE_TYPE,
  CAST({pick_sql(ref.COVERAGE_LIMITS, f'{i} % 4')} AS DECIMAL(15,2)) AS COVERAGE_LIMIT,
  CAST({pick_sql(ref.DEDUCTIBLES, f'{i} % 4')} AS DECIMAL(10,2)) AS DEDUCTIBLE,
  CAST(500 + ({i} * 113) % 4500 AS DECIMAL(10,2)) AS PREMIUM,
  {pick_sql(ref.CLAIM_STATES, f'{i} % 10')} AS POLICY_STATE,
  {_zip5(f'10000 + ({i} * 17) % 90000')} AS POLICY_ZIP,
  'Agent_' || CAST({i} % 50 + 1 AS VARCHAR) AS AGENT_NAME,
  {pick_sql(ref.AGENCIES, f'{i} % 5')} AS AGENCY_NAME,
  CASE WHEN {i} % 7 = 0 THEN 'Cancelled' ELSE 'Active' END AS POLICY_STATUS
FROM customer"""

    lineitem_money = """
SELECT l_orderkey, l_linenumber,
  CAST(l_extendedprice AS DECIMAL(15,2)) AS ext,
  CAST(l_discount AS DECIMAL(4,2)) AS disc,
  CAST(l_tax AS DECIMAL(4,2)) AS tax,
  CAST(l_shipdate AS DATE) AS ship_date
FROM lineitem"""

    financial = f"""
SELECT
  c.CLAIM_ID AS FINANCIAL_ID,
  c.CLAIM_ID,
  CAST(CASE WHEN c.CLAIM_STATUS IN ('Closed', 'Approved') THEN CAST(a.net AS DECIMAL(15,2)) ELSE 0 END
       AS DECIMAL(15,2)) AS PAID_AMOUNT,
  c.ORDER_TOTAL AS RESERVE_AMOUNT,
  CAST(a.gross AS DECIMAL(15,2)) AS INCURRED_LOSS,
  {pick_sql(ref.PAYMENT_TYPES, 'c.CLAIM_ID % 4')} AS PAYMENT_TYPE,
  CASE WHEN c.CLAIM_STATUS IN ('Closed', 'Approved')
       THEN {_d('COALESCE(c.CLOSE_DATE, c.OPEN_DATE)', 'c.CLAIM_ID % 30')} END AS PAYMENT_DATE,
  CAST(CASE WHEN c.SUBROGATION_INDICATOR THEN CAST(a.disc_amt AS DECIMAL(15,2)) ELSE 0 END AS DECIMAL(15,2))
    AS RECOVERY_AMOUNT,
  CAST(CASE WHEN c.SUBROGATION_INDICATOR
            THEN CAST(CAST(a.disc_amt AS DECIMAL(15,2)) * 0.5 AS DECIMAL(15,2)) ELSE 0 END AS DECIMAL(15,2))
    AS SUBROGATION_AMOUNT,
  CAST(a.tax_amt AS DECIMAL(15,2)) AS SALVAGE_AMOUNT,
  c.CREATED_DATE
FROM (SELECT l_orderkey, SUM(ext * (1 - disc)) AS net, SUM(ext) AS gross, SUM(ext * disc) AS disc_amt,
             SUM(ext * tax) AS tax_amt
      FROM r_lineitem GROUP BY l_orderkey) a
JOIN r_claims_base c ON a.l_orderkey = c.CLAIM_ID"""

    expense = f"""
SELECT
  l_orderkey * 10 + l_linenumber AS EXPENSE_ID,
  l_orderkey AS CLAIM_ID,
  CAST(SUM(ext) * 0.10 AS DECIMAL(12,2)) AS LEGAL_FEES,
  CAST(SUM(ext) * 0.05 AS DECIMAL(12,2)) AS ADJUSTOR_COSTS,
  CAST(SUM(ext * disc) AS DECIMAL(12,2)) AS INVESTIGATION_CHARGES,
  CAST(SUM(ext * tax) AS DECIMAL(12,2)) AS ULAE,
  MIN(ship_date) AS EXPENSE_DATE,
  {pick_sql(ref.EXPENSE_CATEGORIES, 'l_linenumber % 4')} AS EXPENSE_CATEGORY
FROM r_lineitem GROUP BY l_orderkey, l_linenumber"""

    k2 = "c.CLAIM_ID"
    litigation = f"""
SELECT
  ROW_NUMBER() OVER (ORDER BY {k2}) AS LITIGATION_ID,
  {k2} AS CLAIM_ID,
  p.POLICY_NUMBER,
  TRUE AS LITIGATION_INDICATOR,
  {pick_sql(ref.ATTORNEYS, f'{k2} % 8')} AS ATTORNEY_ASSIGNED,
  c.CLAIM_STATE || ' ' || {pick_sql(ref.COURTS, f'{k2} % 3')} AS COURT_JURISDICTION,
  {_d('c.OPEN_DATE', f'{k2} % 90 + 30')} AS LAWSUIT_FILED_DATE,
  CASE WHEN c.CLAIM_STATUS = 'Closed' THEN CAST(10000 + ({k2} * 97) % 190000 AS DECIMAL(15,2)) END
    AS SETTLEMENT_AMOUNT,
  CASE WHEN c.CLAIM_STATUS = 'Closed' THEN c.CLOSE_DATE END AS SETTLEMENT_DATE,
  CAST(5000 + ({k2} * 61) % 45000 AS DECIMAL(12,2)) AS DEFENSE_COSTS,
  CASE WHEN c.CLAIM_STATUS = 'Closed' THEN 'Settled' WHEN {k2} % 10 < 3 THEN 'Discovery'
       WHEN {k2} % 10 < 5 THEN 'Mediation' ELSE 'Trial Pending' END AS LITIGATION_STATUS
FROM r_claims c JOIN r_policy p ON c.POLICY_ID = p.POLICY_ID
WHERE c.LITIGATION_INDICATOR"""

    s = "s_suppkey"
    vendor = f"""
SELECT
  {s} AS VENDOR_ID,
  s_name AS VENDOR_NAME,
  {pick_sql(ref.VENDOR_TYPES, f'{s} % 4')} AS VENDOR_TYPE,
  {pick_sql(ref.VENDOR_CITIES, f'{s} % 10')} AS VENDOR_CITY,
  {pick_sql(ref.VENDOR_STATES, f'{s} % 10')} AS VENDOR_STATE,
  {pick_sql(ref.VENDOR_COST_TIERS, f'{s} % 3')} AS VENDOR_COST_TIER,
  CAST(CAST(300 + ({s} * 7) % 200 AS DECIMAL(5,0)) * 0.01 AS DECIMAL(3,2)) AS VENDOR_RATING,
  ({s} % 10 <> 0) AS ACTIVE_FLAG
FROM supplier"""

    lob = "SELECT * FROM (VALUES " + sql_values(ref.LINES_OF_BUSINESS) + \
          ") AS t(LOB_ID, LOB_NAME, LOB_LEAD, LOB_CATEGORY)"
    cat_rows = [(r[0], r[1], r[2], r[3], r[4].isoformat(), r[5].isoformat(), r[6], r[7]) for r in ref.CATASTROPHES]
    cat = ("SELECT CAST(i AS INTEGER) AS CATASTROPHE_ID, code AS CATASTROPHE_CODE, name AS EVENT_NAME, "
           "etype AS EVENT_TYPE, CAST(d1 AS DATE) AS EVENT_DATE, CAST(d2 AS DATE) AS END_DATE, "
           "states AS IMPACTED_STATES, CAST(loss AS DECIMAL(15,2)) AS ESTIMATED_INDUSTRY_LOSS FROM (VALUES "
           + sql_values(cat_rows) + ") AS t(i, code, name, etype, d1, d2, states, loss)")
    return [
        ("r_claims_base", claims),
        ("r_claims", "SELECT * EXCLUDE (ORDER_TOTAL) FROM r_claims_base"),
        ("r_insured", insured),
        ("r_policy", policy),
        ("r_vendor", vendor),
        ("r_lineitem", lineitem_money),
        ("r_financial", financial),
        ("r_expense", expense),
        ("r_litigation", litigation),
        ("r_lob", lob),
        ("r_catastrophe", cat),
    ]


def _budget_case(sev: str, idx: int) -> str:
    parts = " ".join(f"WHEN {sev} = '{row[0]}' THEN {row[idx + 1]}" for row in ref.EXPENSE_BUDGET)
    return f"CAST(CASE {parts} ELSE {ref.EXPENSE_BUDGET_DEFAULT[idx]} END AS INTEGER)"


def star_ctes() -> list[tuple[str, str]]:
    dim_date = """
SELECT d AS DATE_KEY,
  CAST(year(d) AS INTEGER) AS YEAR, CAST(quarter(d) AS INTEGER) AS QUARTER, CAST(month(d) AS INTEGER) AS MONTH,
  strftime(d, '%b') AS MONTH_NAME, CAST(day(d) AS INTEGER) AS DAY_OF_MONTH,
  CAST(dayofweek(d) AS INTEGER) AS DAY_OF_WEEK, strftime(d, '%a') AS DAY_NAME,
  CAST(weekofyear(d) AS INTEGER) AS WEEK_OF_YEAR, dayofweek(d) IN (0, 6) AS IS_WEEKEND,
  strftime(d, '%Y') || '-Q' || CAST(quarter(d) AS VARCHAR) AS YEAR_QUARTER,
  strftime(d, '%Y-%m') AS YEAR_MONTH,
  CAST(date_trunc('month', d) AS DATE) AS FIRST_DAY_OF_MONTH,
  CAST(last_day(d) AS DATE) AS LAST_DAY_OF_MONTH,
  CAST(date_trunc('quarter', d) AS DATE) AS FIRST_DAY_OF_QUARTER
FROM (SELECT CAST(d AS DATE) AS d FROM (
  SELECT unnest(generate_series(CAST(date_trunc('year', lo) AS DATE),
                                CAST(date_trunc('year', hi) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE),
                                INTERVAL 1 DAY)) AS d
  FROM (SELECT MIN(x) AS lo, MAX(x) AS hi
        FROM (SELECT LOSS_DATE AS x FROM r_claims UNION ALL SELECT PAYMENT_DATE FROM r_financial
              UNION ALL SELECT EXPENSE_DATE FROM r_expense))))"""

    dim_claim_type = ("SELECT LOB_ID AS CLAIM_TYPE_KEY, LOB_NAME AS CLAIM_TYPE, LOB_LEAD AS CLAIM_TYPE_LEAD, "
                      "LOB_CATEGORY AS CLAIM_CATEGORY FROM r_lob")
    lc_ref = ("SELECT * FROM (VALUES " + sql_values(ref.LOSS_CAUSES) +
              ") AS t(LOSS_CAUSE, LOSS_CATEGORY, IS_WEATHER_RELATED, WEATHER_CONDITION_MAPPING)")
    dim_loss_cause = f"""
SELECT ROW_NUMBER() OVER (ORDER BY d.LOSS_CAUSE ASC NULLS FIRST) AS LOSS_CAUSE_KEY, d.LOSS_CAUSE,
  r.LOSS_CATEGORY, COALESCE(r.IS_WEATHER_RELATED, FALSE) AS IS_WEATHER_RELATED, r.WEATHER_CONDITION_MAPPING
FROM (SELECT DISTINCT LOSS_CAUSE FROM r_claims WHERE LOSS_CAUSE IS NOT NULL) d
LEFT JOIN ({lc_ref}) r ON d.LOSS_CAUSE = r.LOSS_CAUSE"""
    states = "SELECT * FROM (VALUES " + sql_values(ref.STATES) + ") AS t(STATE_CODE, STATE_NAME, REGION)"
    dim_geography = f"""
SELECT g.GEOGRAPHY_KEY, g.STATE_CODE, COALESCE(s.STATE_NAME, g.STATE_CODE) AS STATE_NAME,
  COALESCE(s.REGION, 'Unknown') AS REGION, g.CITY, g.ZIP_CODE
FROM (SELECT ROW_NUMBER() OVER (ORDER BY STATE_CODE ASC NULLS FIRST, CITY ASC NULLS FIRST,
                                         ZIP_CODE ASC NULLS FIRST) AS GEOGRAPHY_KEY, *
      FROM (SELECT DISTINCT CLAIM_STATE AS STATE_CODE, CLAIM_CITY AS CITY, CLAIM_ZIP AS ZIP_CODE
            FROM r_claims WHERE CLAIM_STATE IS NOT NULL)) g
LEFT JOIN ({states}) s ON g.STATE_CODE = s.STATE_CODE"""
    dim_policy = f"""
SELECT p.POLICY_ID AS POLICY_KEY, p.POLICY_NUMBER, p.INSURED_ID,
  COALESCE(i.FIRST_NAME, '') || ' ' || COALESCE(i.LAST_NAME, '') AS INSURED_NAME,
  p.POLICY_EFFECTIVE_DATE, p.POLICY_EXPIRATION_DATE, p.POLICY_TERM_MONTHS, p.COVERAGE_TYPE, p.COVERAGE_LIMIT,
  p.DEDUCTIBLE, p.PREMIUM, p.POLICY_STATE, p.POLICY_ZIP, p.AGENT_NAME, p.AGENCY_NAME, p.POLICY_STATUS,
  CASE WHEN p.POLICY_EXPIRATION_DATE < {AS_OF} THEN 'Expired' WHEN p.POLICY_EFFECTIVE_DATE > {AS_OF} THEN 'Future'
       ELSE 'Active' END AS POLICY_ACTIVE_STATUS
FROM r_policy p LEFT JOIN r_insured i ON p.INSURED_ID = i.INSURED_ID"""
    dim_weather_event = f"""
SELECT CATASTROPHE_ID AS WEATHER_EVENT_KEY, CATASTROPHE_CODE, EVENT_NAME, EVENT_TYPE AS WEATHER_CONDITION,
  EVENT_DATE, END_DATE,
  CAST(date_diff('day', EVENT_DATE, COALESCE(END_DATE, EVENT_DATE)) + 1 AS INTEGER) AS EVENT_DURATION_DAYS,
  IMPACTED_STATES, ESTIMATED_INDUSTRY_LOSS,
  CASE WHEN EVENT_TYPE IN ('Hurricane') THEN 'Wind/Rain' WHEN EVENT_TYPE IN ('Wildfire') THEN 'Heat/Fire'
       WHEN EVENT_TYPE IN ('Winter Storm', 'Ice Storm') THEN 'Snow/Ice'
       WHEN EVENT_TYPE IN ('Tornado', 'Derecho') THEN 'Wind/Hail'
       WHEN EVENT_TYPE IN ('Flood') THEN 'Rain/Flood'
       WHEN EVENT_TYPE IN ('Severe Storm', 'Hailstorm') THEN 'Wind/Hail' ELSE 'Multiple' END
    AS PRIMARY_WEATHER_DRIVER,
  CASE WHEN ESTIMATED_INDUSTRY_LOSS >= 25000000000 THEN 'Catastrophic'
       WHEN ESTIMATED_INDUSTRY_LOSS >= 10000000000 THEN 'Severe'
       WHEN ESTIMATED_INDUSTRY_LOSS >= 5000000000 THEN 'Major' ELSE 'Moderate' END AS EVENT_SEVERITY_TIER
FROM r_catastrophe"""

    def m0(col):
        return f"CAST(COALESCE(f.{col}, 0) AS DECIMAL(15,2))"

    fact_claims = f"""
SELECT c.CLAIM_ID AS CLAIM_KEY, c.CLAIM_NUMBER, c.LOSS_DATE AS DATE_KEY, g.GEOGRAPHY_KEY,
  c.LOB_ID AS CLAIM_TYPE_KEY, lc.LOSS_CAUSE_KEY, c.CATASTROPHE_ID AS WEATHER_EVENT_KEY, c.POLICY_ID AS POLICY_KEY,
  c.CLAIM_STATUS, c.CLAIM_STAGE, c.CLAIM_SEVERITY, c.EXPOSURES,
  {m0('PAID_AMOUNT')} AS PAID_AMOUNT, {m0('RESERVE_AMOUNT')} AS RESERVE_AMOUNT,
  {m0('INCURRED_LOSS')} AS INCURRED_LOSS, {m0('RECOVERY_AMOUNT')} AS RECOVERY_AMOUNT,
  {m0('SUBROGATION_AMOUNT')} AS SUBROGATION_AMOUNT, {m0('SALVAGE_AMOUNT')} AS SALVAGE_AMOUNT,
  CAST({m0('INCURRED_LOSS')} - {m0('RECOVERY_AMOUNT')} - {m0('SUBROGATION_AMOUNT')} - {m0('SALVAGE_AMOUNT')}
       AS DECIMAL(15,2)) AS NET_INCURRED,
  f.PAYMENT_TYPE, f.PAYMENT_DATE, c.FRAUD_INDICATOR, c.FRAUD_SCORE,
  CASE WHEN c.FRAUD_SCORE >= 60 THEN 'High Risk' WHEN c.FRAUD_SCORE >= 30 THEN 'Medium Risk' ELSE 'No Flag' END
    AS FRAUD_RISK_TIER,
  c.CAT_INDICATOR, c.LITIGATION_INDICATOR, c.SUBROGATION_INDICATOR,
  COALESCE(lc.IS_WEATHER_RELATED, FALSE) AS IS_WEATHER_RELATED, lc.WEATHER_CONDITION_MAPPING,
  CAST(date_diff('day', c.LOSS_DATE, c.REPORTED_DATE) AS INTEGER) AS DAYS_TO_REPORT,
  CAST(date_diff('day', c.REPORTED_DATE, c.OPEN_DATE) AS INTEGER) AS DAYS_TO_OPEN,
  CAST(date_diff('day', c.OPEN_DATE, c.CLOSE_DATE) AS INTEGER) AS DAYS_TO_CLOSE,
  c.LOSS_DATE, c.REPORTED_DATE, c.OPEN_DATE, c.CLOSE_DATE, c.LAST_ACTIVITY_DATE,
  CAST(COALESCE(l.SETTLEMENT_AMOUNT, 0) AS DECIMAL(15,2)) AS LITIGATION_SETTLEMENT_AMOUNT,
  CAST(COALESCE(l.DEFENSE_COSTS, 0) AS DECIMAL(12,2)) AS LITIGATION_DEFENSE_COSTS,
  l.LITIGATION_STATUS
FROM r_claims c
LEFT JOIN r_financial f ON c.CLAIM_ID = f.CLAIM_ID
LEFT JOIN r_litigation l ON c.CLAIM_ID = l.CLAIM_ID
LEFT JOIN dim_geography g ON c.CLAIM_STATE = g.STATE_CODE AND c.CLAIM_CITY = g.CITY AND c.CLAIM_ZIP = g.ZIP_CODE
LEFT JOIN dim_loss_cause lc ON c.LOSS_CAUSE = lc.LOSS_CAUSE"""

    b = [_budget_case("fc.CLAIM_SEVERITY", i) for i in range(4)]
    actual = "(e.LEGAL_FEES + e.ADJUSTOR_COSTS + e.INVESTIGATION_CHARGES + e.ULAE)"
    fact_expense = f"""
SELECT e.EXPENSE_ID AS EXPENSE_KEY, fc.CLAIM_KEY, fc.DATE_KEY, fc.GEOGRAPHY_KEY, fc.CLAIM_TYPE_KEY,
  fc.LOSS_CAUSE_KEY, fc.WEATHER_EVENT_KEY, fc.POLICY_KEY, e.EXPENSE_DATE, e.EXPENSE_CATEGORY,
  e.LEGAL_FEES AS ACTUAL_LEGAL_FEES, e.ADJUSTOR_COSTS AS ACTUAL_ADJUSTOR_COSTS,
  e.INVESTIGATION_CHARGES AS ACTUAL_INVESTIGATION_CHARGES, e.ULAE AS ACTUAL_ULAE,
  CAST({actual} AS DECIMAL(15,2)) AS TOTAL_ACTUAL_EXPENSE,
  {b[0]} AS BUDGETED_LEGAL_FEES, {b[1]} AS BUDGETED_ADJUSTOR_COSTS,
  {b[2]} AS BUDGETED_INVESTIGATION_CHARGES, {b[3]} AS BUDGETED_ULAE,
  CAST(e.LEGAL_FEES - {b[0]} AS DECIMAL(15,2)) AS LEGAL_FEES_VARIANCE,
  CAST({actual} - ({b[0]} + {b[1]} + {b[2]} + {b[3]}) AS DECIMAL(15,2)) AS TOTAL_EXPENSE_VARIANCE,
  fc.CLAIM_SEVERITY, fc.FRAUD_INDICATOR, fc.IS_WEATHER_RELATED
FROM r_expense e JOIN fact_claims fc ON e.CLAIM_ID = fc.CLAIM_KEY"""
    return [
        ("dim_date", dim_date),
        ("dim_claim_type", dim_claim_type),
        ("dim_loss_cause", dim_loss_cause),
        ("dim_geography", dim_geography),
        ("dim_policy", dim_policy),
        ("dim_weather_event", dim_weather_event),
        ("fact_claims", fact_claims),
        ("fact_expense", fact_expense),
    ]


def with_base(select_sql: str, extra_ctes: list[tuple[str, str]] | None = None) -> str:
    """Full oracle SQL: base CTEs + the query's own CTEs + its SELECT."""
    ctes = raw_ctes() + star_ctes() + list(extra_ctes or [])
    body = ",\n".join(f"{name} AS ({sql}\n)" for name, sql in ctes)
    return f"WITH {body}\n{select_sql}"
