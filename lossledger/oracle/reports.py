"""Oracle SQL for the business reports (DuckDB, over the base CTEs)."""

from __future__ import annotations

from lossledger.oracle.base import AS_OF, avg_sql, count_if_sql, pct_sql, round_div_sql, sum_money_sql, with_base


def _r0(col):
    return f"CAST(ROUND(SUM({col}), 0) AS DECIMAL(38,0))"


FC_D = "fact_claims fc JOIN dim_date d ON fc.DATE_KEY = d.DATE_KEY"

REPORTS: dict[str, str] = {}

REPORTS["kpi_summary"] = with_base(f"""
SELECT COUNT(*) AS TOTAL_CLAIMS,
  {count_if_sql("CLAIM_STATUS = 'Open'")} AS OPEN_CLAIMS,
  {count_if_sql("CLAIM_STATUS = 'Closed'")} AS CLOSED_CLAIMS,
  {sum_money_sql("PAID_AMOUNT")} AS TOTAL_PAID,
  {sum_money_sql("RESERVE_AMOUNT")} AS TOTAL_RESERVES,
  {sum_money_sql("NET_INCURRED")} AS NET_INCURRED,
  {sum_money_sql("RECOVERY_AMOUNT + SUBROGATION_AMOUNT + SALVAGE_AMOUNT")} AS TOTAL_RECOVERY,
  {avg_sql("PAID_AMOUNT", 2)} AS AVG_COST,
  {avg_sql("DAYS_TO_CLOSE", 1, 0)} AS AVG_CLOSE_DAYS,
  {count_if_sql("LITIGATION_INDICATOR")} AS LITIGATED,
  {count_if_sql("FRAUD_INDICATOR")} AS FRAUD,
  {count_if_sql("CAT_INDICATOR")} AS CAT,
  {count_if_sql("IS_WEATHER_RELATED")} AS WEATHER,
  {sum_money_sql("INCURRED_LOSS")} AS TOTAL_INCURRED
FROM fact_claims""")

REPORTS["ratios"] = with_base(f"""
SELECT TOTAL_CLAIMS,
  {pct_sql("SETTLED", "TOTAL_CLAIMS", 1)} AS SETTLEMENT_RATIO,
  {pct_sql("PAID", "INCURRED", 1, 2, 2)} AS LOSS_RATIO,
  {pct_sql("PENDING", "TOTAL_CLAIMS", 1)} AS PENDING_RATIO,
  {pct_sql("FRAUD", "TOTAL_CLAIMS", 2)} AS FRAUD_RATE
FROM (SELECT COUNT(*) AS TOTAL_CLAIMS,
        {count_if_sql("CLAIM_STATUS = 'Closed'")} AS SETTLED,
        {count_if_sql("CLAIM_STATUS IN ('Open', 'Pending Review', 'Stalled')")} AS PENDING,
        {count_if_sql("FRAUD_INDICATOR")} AS FRAUD,
        SUM(PAID_AMOUNT) AS PAID, SUM(INCURRED_LOSS) AS INCURRED
      FROM fact_claims)""")

MONTHLY = ("monthly", f"""
SELECT d.YEAR_MONTH, d.YEAR, COUNT(*) AS CLAIMS,
  {count_if_sql("fc.CLAIM_STATUS = 'Open'")} AS OPEN_C,
  {count_if_sql("fc.CLAIM_STATUS = 'Closed'")} AS SETTLED,
  SUM(fc.PAID_AMOUNT) AS PAID, SUM(fc.RESERVE_AMOUNT) AS RESERVES, COUNT(fc.PAID_AMOUNT) AS PAID_N,
  {count_if_sql("fc.FRAUD_INDICATOR")} AS FRAUD
FROM {FC_D} GROUP BY d.YEAR_MONTH, d.YEAR""")
LATEST = ("latest", """
SELECT CM, strftime(CAST(CAST(CM || '-01' AS DATE) - INTERVAL 1 MONTH AS DATE), '%Y-%m') AS PM,
  CAST(year(CAST(CM || '-01' AS DATE)) AS INTEGER) AS CY
FROM (SELECT MAX(YEAR_MONTH) AS CM FROM monthly)""")

REPORTS["month_compare"] = with_base("""
SELECT l.CM AS CURRENT_MONTH, l.PM AS PREVIOUS_MONTH,
  CAST(COALESCE(c.CLAIMS, 0) AS BIGINT) AS CUR_CLAIMS, CAST(COALESCE(p.CLAIMS, 0) AS BIGINT) AS PREV_CLAIMS,
  CAST(COALESCE(c.CLAIMS, 0) - COALESCE(p.CLAIMS, 0) AS BIGINT) AS DELTA_CLAIMS,
  CAST(COALESCE(c.OPEN_C, 0) AS BIGINT) AS CUR_OPEN, CAST(COALESCE(p.OPEN_C, 0) AS BIGINT) AS PREV_OPEN,
  CAST(COALESCE(c.OPEN_C, 0) - COALESCE(p.OPEN_C, 0) AS BIGINT) AS DELTA_OPEN,
  CAST(COALESCE(c.PAID, 0) AS DECIMAL(38,2)) AS CUR_PAID, CAST(COALESCE(p.PAID, 0) AS DECIMAL(38,2)) AS PREV_PAID,
  CAST(COALESCE(c.PAID, 0) - COALESCE(p.PAID, 0) AS DECIMAL(38,2)) AS DELTA_PAID,
  CAST(COALESCE(c.RESERVES, 0) AS DECIMAL(38,2)) AS CUR_RESERVES,
  CAST(COALESCE(p.RESERVES, 0) AS DECIMAL(38,2)) AS PREV_RESERVES,
  CAST(COALESCE(c.RESERVES, 0) - COALESCE(p.RESERVES, 0) AS DECIMAL(38,2)) AS DELTA_RESERVES
FROM latest l LEFT JOIN monthly c ON c.YEAR_MONTH = l.CM LEFT JOIN monthly p ON p.YEAR_MONTH = l.PM""",
                                     [MONTHLY, LATEST])


def _scorecard_sql() -> str:
    periods = {"c": "m.YEAR_MONTH = l.CM", "p": "m.YEAR_MONTH = l.PM", "y": "m.YEAR = l.CY"}
    aggs = []
    for t, cond in periods.items():
        for c in ["CLAIMS", "SETTLED", "PAID", "RESERVES", "PAID_N", "FRAUD"]:
            aggs.append(f"SUM(CASE WHEN {cond} THEN m.{c} END) AS {t}_{c}")
    agg = "SELECT " + ", ".join(aggs) + " FROM monthly m CROSS JOIN latest l"

    def vals(t):
        return [
            f"CAST(COALESCE({t}_CLAIMS, 0) AS DECIMAL(38,0))",
            f"CAST(COALESCE({t}_SETTLED, 0) AS DECIMAL(38,0))",
            f"CAST(ROUND({t}_PAID, 0) AS DECIMAL(38,0))",
            f"CAST(ROUND({t}_RESERVES, 0) AS DECIMAL(38,0))",
            f"CAST({round_div_sql(f'{t}_PAID', f'{t}_PAID_N', 0)} AS DECIMAL(38,0))",
            f"CAST(COALESCE({t}_FRAUD, 0) AS DECIMAL(38,0))",
        ]
    names = ["Claims Filed", "Claims Settled", "Total Paid ($)", "Total Reserves ($)", "Avg Claim Cost ($)",
             "Fraud Flagged"]
    c, p, y = vals("c"), vals("p"), vals("y")
    parts = []
    for i, n in enumerate(names):
        var = (f"CASE WHEN {p[i]} > 0 THEN {round_div_sql(f'({c[i]} - {p[i]}) * 100', p[i], 1, 0, 0)} "
               f"ELSE CAST(0 AS DECIMAL(38,1)) END")
        parts.append(f"SELECT {i + 1} AS METRIC_ORDER, '{n}' AS KEY_METRIC, {c[i]} AS CURRENT_MONTH, "
                     f"{p[i]} AS LAST_MONTH, CAST({var} AS DECIMAL(38,1)) AS VARIANCE_PCT, {y[i]} AS YTD_ACTUAL "
                     f"FROM t")
    return with_base("\nUNION ALL\n".join(parts), [MONTHLY, LATEST, ("t", agg)])


REPORTS["scorecard"] = _scorecard_sql()

REPORTS["monthly_trend"] = with_base(f"""
SELECT * FROM (
  SELECT d.YEAR_MONTH AS MONTH, COUNT(*) AS CLAIMS, {_r0("fc.PAID_AMOUNT")} AS TOTAL_PAID,
    {count_if_sql("fc.CLAIM_STATUS = 'Open'")} AS OPEN_COUNT,
    {count_if_sql("fc.CLAIM_STATUS = 'Closed'")} AS CLOSED_COUNT,
    {avg_sql("fc.PAID_AMOUNT", 0)} AS AVG_PAID,
    {count_if_sql("fc.FRAUD_INDICATOR")} AS FRAUD_COUNT
  FROM {FC_D} GROUP BY d.YEAR_MONTH ORDER BY d.YEAR_MONTH DESC LIMIT 12) ORDER BY MONTH""")

REPORTS["open_closed_trend"] = with_base(f"""
SELECT * FROM (
  SELECT d.YEAR_MONTH AS MONTH,
    {count_if_sql("fc.CLAIM_STATUS = 'Open'")} AS OPEN_COUNT,
    {count_if_sql("fc.CLAIM_STATUS = 'Closed'")} AS CLOSED_COUNT
  FROM {FC_D} GROUP BY d.YEAR_MONTH ORDER BY d.YEAR_MONTH DESC LIMIT 12) ORDER BY MONTH""")

REPORTS["quarter_severity"] = with_base(f"""
SELECT d.YEAR_QUARTER AS QUARTER, fc.CLAIM_SEVERITY, COUNT(*) AS CNT
FROM {FC_D} GROUP BY d.YEAR_QUARTER, fc.CLAIM_SEVERITY""")

REPORTS["waterfall"] = with_base(f"""
SELECT * FROM (
  SELECT 1 AS STEP_ORDER, 'Incurred Loss' AS STEP, IL AS AMOUNT FROM t
  UNION ALL SELECT 2, 'Recovery', CAST(-REC AS DECIMAL(38,2)) FROM t
  UNION ALL SELECT 3, 'Subrogation', CAST(-SUB AS DECIMAL(38,2)) FROM t
  UNION ALL SELECT 4, 'Salvage', CAST(-SAL AS DECIMAL(38,2)) FROM t
  UNION ALL SELECT 5, 'Net Incurred', NI FROM t)""",
                                 [("t", f"""SELECT {sum_money_sql("INCURRED_LOSS")} AS IL,
  {sum_money_sql("RECOVERY_AMOUNT")} AS REC, {sum_money_sql("SUBROGATION_AMOUNT")} AS SUB,
  {sum_money_sql("SALVAGE_AMOUNT")} AS SAL, {sum_money_sql("NET_INCURRED")} AS NI FROM fact_claims""")])

REPORTS["status_funnel"] = with_base(f"""
SELECT CLAIM_STATUS, COUNT, {pct_sql("COUNT", "MAX(COUNT) OVER ()", 1)} AS PCT_OF_FIRST
FROM (SELECT CLAIM_STATUS, COUNT(*) AS COUNT FROM fact_claims GROUP BY CLAIM_STATUS)""")

REPORTS["severity_share"] = with_base(f"""
SELECT CLAIM_SEVERITY, COUNT, AVG_PAID, {pct_sql("COUNT", "SUM(COUNT) OVER ()", 1)} AS PCT
FROM (SELECT CLAIM_SEVERITY, COUNT(*) AS COUNT, {avg_sql("PAID_AMOUNT", 0)} AS AVG_PAID
      FROM fact_claims GROUP BY CLAIM_SEVERITY)""")

REPORTS["top_loss_causes"] = with_base(f"""
SELECT lc.LOSS_CAUSE, lc.LOSS_CATEGORY, COUNT(*) AS COUNT, {_r0("fc.PAID_AMOUNT")} AS TOTAL_PAID
FROM fact_claims fc JOIN dim_loss_cause lc ON fc.LOSS_CAUSE_KEY = lc.LOSS_CAUSE_KEY
GROUP BY lc.LOSS_CAUSE, lc.LOSS_CATEGORY ORDER BY COUNT DESC, lc.LOSS_CAUSE LIMIT 8""")

REPORTS["fraud_top_causes"] = with_base(f"""
SELECT lc.LOSS_CAUSE, COUNT(*) AS FRAUD_COUNT, {avg_sql("fc.FRAUD_SCORE", 1)} AS AVG_SCORE
FROM fact_claims fc JOIN dim_loss_cause lc ON fc.LOSS_CAUSE_KEY = lc.LOSS_CAUSE_KEY
WHERE fc.FRAUD_INDICATOR GROUP BY lc.LOSS_CAUSE ORDER BY FRAUD_COUNT DESC, lc.LOSS_CAUSE LIMIT 10""")

_SEV = ["Minor", "Moderate", "Significant", "Severe", "Catastrophic"]
REPORTS["region_severity_pivot"] = with_base(
    "SELECT g.REGION, " + ", ".join(f"{count_if_sql(f'fc.CLAIM_SEVERITY = {chr(39)}{s}{chr(39)}')} AS \"{s}\""
                                    for s in _SEV)
    + " FROM fact_claims fc JOIN dim_geography g ON fc.GEOGRAPHY_KEY = g.GEOGRAPHY_KEY GROUP BY g.REGION")

REPORTS["claim_type_financials"] = with_base(f"""
SELECT ct.CLAIM_TYPE, ct.CLAIM_CATEGORY, COUNT(*) AS CLAIMS, {sum_money_sql("fc.PAID_AMOUNT")} AS PAID,
  {sum_money_sql("fc.RESERVE_AMOUNT")} AS RESERVES, {_r0("fc.PAID_AMOUNT")} AS TOTAL_PAID,
  {avg_sql("fc.PAID_AMOUNT", 0)} AS AVG_PAID
FROM fact_claims fc JOIN dim_claim_type ct ON fc.CLAIM_TYPE_KEY = ct.CLAIM_TYPE_KEY
GROUP BY ct.CLAIM_TYPE, ct.CLAIM_CATEGORY""")

REPORTS["category_rollup"] = with_base(f"""
SELECT 'type' AS LEVEL, ct.CLAIM_CATEGORY, ct.CLAIM_TYPE, COUNT(*) AS COUNT, {_r0("fc.PAID_AMOUNT")} AS TOTAL_PAID
FROM fact_claims fc JOIN dim_claim_type ct ON fc.CLAIM_TYPE_KEY = ct.CLAIM_TYPE_KEY
GROUP BY ct.CLAIM_CATEGORY, ct.CLAIM_TYPE
UNION ALL
SELECT 'category', ct.CLAIM_CATEGORY, NULL, COUNT(*), {_r0("fc.PAID_AMOUNT")}
FROM fact_claims fc JOIN dim_claim_type ct ON fc.CLAIM_TYPE_KEY = ct.CLAIM_TYPE_KEY
GROUP BY ct.CLAIM_CATEGORY""")

REPORTS["region_performance"] = with_base(f"""
SELECT *, {pct_sql("FRAUD_COUNT", "TOTAL_CLAIMS", 1)} AS FRAUD_RATE_PCT,
  {pct_sql("SETTLED", "TOTAL_CLAIMS", 1)} AS SETTLED_PCT
FROM (SELECT g.REGION, COUNT(*) AS TOTAL_CLAIMS,
        {count_if_sql("fc.CLAIM_STATUS = 'Closed'")} AS SETTLED,
        {count_if_sql("fc.CLAIM_STATUS = 'Open'")} AS OPEN_CLAIMS,
        {_r0("fc.PAID_AMOUNT")} AS TOTAL_PAID,
        {avg_sql("fc.PAID_AMOUNT", 0)} AS AVG_PAID,
        {avg_sql("fc.DAYS_TO_CLOSE", 1, 0)} AS AVG_CLOSE_DAYS,
        {count_if_sql("fc.FRAUD_INDICATOR")} AS FRAUD_COUNT
      FROM fact_claims fc JOIN dim_geography g ON fc.GEOGRAPHY_KEY = g.GEOGRAPHY_KEY GROUP BY g.REGION)""")

REPORTS["close_days_by_severity"] = with_base(f"""
SELECT CLAIM_SEVERITY, {avg_sql("DAYS_TO_CLOSE", 1, 0)} AS AVG_DAYS,
  CAST(MIN(DAYS_TO_CLOSE) AS INTEGER) AS MIN_DAYS, CAST(MAX(DAYS_TO_CLOSE) AS INTEGER) AS MAX_DAYS,
  COUNT(*) AS CLOSED_CLAIMS
FROM fact_claims WHERE DAYS_TO_CLOSE IS NOT NULL GROUP BY CLAIM_SEVERITY""")

REPORTS["fraud_kpi"] = with_base(f"""
SELECT *, {pct_sql("FRAUD_FLAGGED", "TOTAL_CLAIMS", 2)} AS FRAUD_RATE_PCT FROM (
  SELECT COUNT(*) AS TOTAL_CLAIMS, {count_if_sql("FRAUD_INDICATOR")} AS FRAUD_FLAGGED,
    {count_if_sql("FRAUD_INDICATOR AND CLAIM_STATUS = 'Open'")} AS FRAUD_OPEN,
    {avg_sql("CASE WHEN FRAUD_INDICATOR THEN FRAUD_SCORE END", 2)} AS AVG_FRAUD_SCORE,
    CAST(ROUND(COALESCE(SUM(CASE WHEN FRAUD_INDICATOR THEN PAID_AMOUNT END), 0), 0) AS DECIMAL(38,0)) AS FRAUD_PAID
  FROM fact_claims)""")

REPORTS["fraud_tiers"] = with_base(f"""
SELECT FRAUD_RISK_TIER, COUNT(*) AS CLAIM_COUNT, {avg_sql("FRAUD_SCORE", 2)} AS AVG_FRAUD_SCORE,
  {_r0("PAID_AMOUNT")} AS TOTAL_PAID, {avg_sql("PAID_AMOUNT", 2)} AS AVG_PAID
FROM fact_claims GROUP BY FRAUD_RISK_TIER""")

REPORTS["fraud_score_buckets"] = with_base("""
SELECT CASE WHEN FRAUD_SCORE IS NULL THEN 'Unknown' WHEN FRAUD_SCORE < 10 THEN '0-9'
  WHEN FRAUD_SCORE < 20 THEN '10-19' WHEN FRAUD_SCORE < 30 THEN '20-29' WHEN FRAUD_SCORE < 40 THEN '30-39'
  WHEN FRAUD_SCORE < 50 THEN '40-49' WHEN FRAUD_SCORE < 60 THEN '50-59' WHEN FRAUD_SCORE < 70 THEN '60-69'
  WHEN FRAUD_SCORE < 80 THEN '70-79' WHEN FRAUD_SCORE < 90 THEN '80-89' ELSE '90-100' END AS SCORE_RANGE,
  COUNT(*) AS COUNT
FROM fact_claims GROUP BY SCORE_RANGE""")

REPORTS["fraud_rate_by_region"] = with_base(f"""
SELECT g.REGION, COUNT(*) AS FRAUD_COUNT,
  {pct_sql("COUNT(*)", "(SELECT COUNT(*) FROM fact_claims fc2 JOIN dim_geography g2 ON fc2.GEOGRAPHY_KEY = g2.GEOGRAPHY_KEY WHERE g2.REGION = g.REGION)", 1)} AS FRAUD_RATE
FROM fact_claims fc JOIN dim_geography g ON fc.GEOGRAPHY_KEY = g.GEOGRAPHY_KEY
WHERE fc.FRAUD_INDICATOR GROUP BY g.REGION""")

REPORTS["severity_financials"] = with_base(f"""
SELECT CLAIM_SEVERITY, {avg_sql("PAID_AMOUNT", 0)} AS AVG_PAID, {avg_sql("RESERVE_AMOUNT", 0)} AS AVG_RESERVE
FROM fact_claims GROUP BY CLAIM_SEVERITY""")

REPORTS["expense_actual_vs_budget"] = with_base(f"""
SELECT EXPENSE_CATEGORY, {sum_money_sql("TOTAL_ACTUAL_EXPENSE")} AS ACTUAL,
  CAST(COALESCE(SUM(BUDGETED_LEGAL_FEES + BUDGETED_ADJUSTOR_COSTS + BUDGETED_INVESTIGATION_CHARGES
                    + BUDGETED_ULAE), 0) AS BIGINT) AS BUDGETED
FROM fact_expense GROUP BY EXPENSE_CATEGORY""")

REPORTS["paid_by_payment_month"] = with_base(f"""
SELECT d.FIRST_DAY_OF_MONTH AS MONTH, {sum_money_sql("fc.PAID_AMOUNT")} AS MONTHLY_PAID
FROM fact_claims fc JOIN dim_date d ON fc.PAYMENT_DATE = d.DATE_KEY
WHERE fc.PAYMENT_DATE IS NOT NULL GROUP BY d.FIRST_DAY_OF_MONTH""")

REPORTS["weather_kpi"] = with_base(f"""
SELECT *, {pct_sql("WEATHER_CLAIMS", "TOTAL_CLAIMS", 1)} AS WEATHER_PCT FROM (
  SELECT COUNT(*) AS TOTAL_CLAIMS, {count_if_sql("IS_WEATHER_RELATED")} AS WEATHER_CLAIMS,
    {count_if_sql("CAT_INDICATOR")} AS CAT_CLAIMS,
    CAST(COALESCE(SUM(CASE WHEN IS_WEATHER_RELATED THEN PAID_AMOUNT ELSE 0 END), 0) AS DECIMAL(38,2))
      AS WEATHER_PAID
  FROM fact_claims)""")

for _key, _col in [("weather_by_condition", "WEATHER_CONDITION"), ("weather_by_tier", "EVENT_SEVERITY_TIER")]:
    REPORTS[_key] = with_base(f"""
SELECT we.{_col}, COUNT(*) AS COUNT, {_r0("fc.PAID_AMOUNT")} AS TOTAL_PAID
FROM fact_claims fc JOIN dim_weather_event we ON fc.WEATHER_EVENT_KEY = we.WEATHER_EVENT_KEY
WHERE fc.IS_WEATHER_RELATED GROUP BY we.{_col}""")

REPORTS["event_impact"] = with_base("""
SELECT we.EVENT_NAME, we.WEATHER_CONDITION, we.EVENT_DATE, we.EVENT_SEVERITY_TIER, we.ESTIMATED_INDUSTRY_LOSS,
  COUNT(fc.CLAIM_KEY) AS IMPACTED_CLAIMS, CAST(ROUND(SUM(fc.PAID_AMOUNT), 0) AS DECIMAL(38,0)) AS TOTAL_PAID
FROM dim_weather_event we LEFT JOIN fact_claims fc ON we.WEATHER_EVENT_KEY = fc.WEATHER_EVENT_KEY
GROUP BY we.EVENT_NAME, we.WEATHER_CONDITION, we.EVENT_DATE, we.EVENT_SEVERITY_TIER, we.ESTIMATED_INDUSTRY_LOSS""")

REPORTS["severity_changes"] = with_base(f"""
SELECT SEVERITY_CHANGE_STAGE AS STAGE, COUNT(*) AS SEVERITY_CHANGES,
  {count_if_sql("PREVIOUS_SEVERITY < CLAIM_SEVERITY")} AS ESCALATED,
  {count_if_sql("PREVIOUS_SEVERITY > CLAIM_SEVERITY")} AS DE_ESCALATED
FROM r_claims
WHERE SEVERITY_CHANGE_DATE >= CAST({AS_OF} - INTERVAL 1 MONTH AS DATE) AND SEVERITY_CHANGE_STAGE IS NOT NULL
GROUP BY SEVERITY_CHANGE_STAGE""")

REPORTS["approval_by_state"] = with_base(f"""
SELECT *, {pct_sql("APPROVED_COUNT", "TOTAL_CLAIMS", 2)} AS APPROVED_PCT,
  {pct_sql("REJECTED_COUNT", "TOTAL_CLAIMS", 2)} AS REJECTED_PCT
FROM (SELECT CLAIM_STATE AS GEOGRAPHY, COUNT(*) AS TOTAL_CLAIMS,
        {count_if_sql("CLAIM_STATUS = 'Approved'")} AS APPROVED_COUNT,
        {count_if_sql("CLAIM_STATUS = 'Rejected'")} AS REJECTED_COUNT
      FROM r_claims GROUP BY CLAIM_STATE)""")

REPORTS["backlog_by_state"] = with_base(f"""
SELECT CLAIM_STATE AS REGION, COUNT(*) AS BACKLOG_COUNT,
  {avg_sql(f"date_diff('day', OPEN_DATE, {AS_OF})", 0, 0)} AS AVG_AGE_DAYS
FROM r_claims WHERE CLAIM_STATUS IN ('Open', 'Pending Review', 'Stalled') AND CLOSE_DATE IS NULL
GROUP BY CLAIM_STATE""")

REPORTS["stalled_by_stage"] = with_base(f"""
SELECT CLAIM_STAGE AS STAGE, COUNT(*) AS STALLED_CLAIMS,
  {avg_sql(f"date_diff('day', LAST_ACTIVITY_DATE, {AS_OF})", 0, 0)} AS AVG_DAYS_STALLED
FROM r_claims
WHERE CLAIM_STATUS = 'Stalled' AND LAST_ACTIVITY_DATE >= CAST({AS_OF} - INTERVAL 3 MONTH AS DATE)
GROUP BY CLAIM_STAGE""")

REPORTS["expense_by_severity"] = with_base(f"""
SELECT CLAIM_SEVERITY, COUNT(*) AS CLAIMS, {avg_sql("TOTAL_ACTUAL_EXPENSE", 2)} AS AVG_ACTUAL,
  {avg_sql("TOTAL_EXPENSE_VARIANCE", 2)} AS AVG_VARIANCE,
  {count_if_sql("TOTAL_EXPENSE_VARIANCE > 0")} AS OVER_BUDGET,
  {count_if_sql("TOTAL_EXPENSE_VARIANCE <= 0")} AS UNDER_BUDGET
FROM fact_expense GROUP BY CLAIM_SEVERITY""")

REPORTS["weather_split"] = with_base(f"""
SELECT IS_WEATHER_RELATED, COUNT(*) AS CLAIMS, {avg_sql("PAID_AMOUNT", 2)} AS AVG_PAID,
  {avg_sql("INCURRED_LOSS", 2)} AS AVG_INCURRED, {count_if_sql("FRAUD_INDICATOR")} AS FRAUD_COUNT,
  COUNT(WEATHER_EVENT_KEY) AS CAT_LINKED
FROM fact_claims GROUP BY IS_WEATHER_RELATED""")

REPORTS["stage_backlog"] = with_base(f"""
SELECT CLAIM_STAGE, COUNT(*) AS CLAIMS, {count_if_sql("CLAIM_STATUS = 'Stalled'")} AS STALLED,
  {count_if_sql("CLAIM_STATUS IN ('Open', 'Pending Review', 'Stalled')")} AS PENDING
FROM fact_claims GROUP BY CLAIM_STAGE""")

REPORTS["agency_stage"] = with_base(f"""
SELECT p.AGENCY_NAME, fc.CLAIM_STAGE, COUNT(*) AS CLAIMS, {count_if_sql("fc.CLAIM_STATUS = 'Rejected'")} AS REJECTED
FROM fact_claims fc JOIN dim_policy p ON fc.POLICY_KEY = p.POLICY_KEY GROUP BY p.AGENCY_NAME, fc.CLAIM_STAGE""")

REPORTS["backlog_by_region"] = with_base(f"""
SELECT g.REGION, COUNT(*) AS BACKLOG_COUNT,
  {avg_sql(f"date_diff('day', fc.OPEN_DATE, {AS_OF})", 0, 0)} AS AVG_AGE_DAYS
FROM fact_claims fc JOIN dim_geography g ON fc.GEOGRAPHY_KEY = g.GEOGRAPHY_KEY
WHERE fc.CLAIM_STATUS IN ('Open', 'Pending Review', 'Stalled') AND fc.CLOSE_DATE IS NULL GROUP BY g.REGION""")

REPORTS["subrogation_pending"] = with_base(f"""
SELECT g.REGION, COUNT(*) AS CLAIMS, {sum_money_sql("fc.SUBROGATION_AMOUNT")} AS SUBROGATION,
  {sum_money_sql("fc.RECOVERY_AMOUNT")} AS RECOVERY
FROM fact_claims fc JOIN dim_geography g ON fc.GEOGRAPHY_KEY = g.GEOGRAPHY_KEY
WHERE fc.CLAIM_STATUS = 'Closed' AND fc.SUBROGATION_INDICATOR GROUP BY g.REGION""")

REPORTS["status_counts"] = with_base("SELECT CLAIM_STATUS, COUNT(*) AS COUNT FROM fact_claims GROUP BY CLAIM_STATUS")

REPORTS["fraud_tier_rules"] = with_base("""
SELECT 'score' AS RULE, CASE WHEN FRAUD_SCORE >= 60 THEN 'High Risk' WHEN FRAUD_SCORE >= 30 THEN 'Medium Risk'
  ELSE 'No Flag' END AS FRAUD_RISK_TIER, COUNT(*) AS CLAIM_COUNT FROM fact_claims GROUP BY 2
UNION ALL
SELECT 'indicator', CASE WHEN COALESCE(FRAUD_INDICATOR, FALSE) AND FRAUD_SCORE >= 80 THEN 'High Risk'
  WHEN COALESCE(FRAUD_INDICATOR, FALSE) AND FRAUD_SCORE >= 50 THEN 'Medium Risk'
  WHEN COALESCE(FRAUD_INDICATOR, FALSE) THEN 'Low Risk' ELSE 'No Flag' END, COUNT(*) FROM fact_claims GROUP BY 2""")
