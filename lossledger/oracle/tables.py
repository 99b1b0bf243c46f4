"""Oracle SQL for the table-level queries."""

from __future__ import annotations

from lossledger.functions.pick import sql_values
from lossledger.oracle.base import AS_OF, with_base
from lossledger.plans.star import FACT_CLAIMS_COLUMNS
from lossledger.sources import reference as ref

TABLES: dict[str, str] = {}

TABLES["fact_claims"] = with_base("SELECT * FROM fact_claims")
TABLES["fact_expense"] = with_base("SELECT * FROM fact_expense")
TABLES["dim_geography"] = with_base("SELECT * FROM dim_geography")
TABLES["dim_loss_cause"] = with_base("SELECT * FROM dim_loss_cause")
TABLES["dim_policy"] = with_base("SELECT * FROM dim_policy")

TABLES["dim_date"] = with_base("SELECT * FROM dim_date")

TABLES["insurance_details"] = with_base("""
SELECT i.INSURED_ID, i.FIRST_NAME, i.LAST_NAME, i.PHONE, i.EMAIL, p.POLICY_ID, p.POLICY_NUMBER, p.POLICY_STATUS,
  p.POLICY_EFFECTIVE_DATE, p.POLICY_EXPIRATION_DATE, p.COVERAGE_TYPE, p.COVERAGE_LIMIT, p.DEDUCTIBLE, p.PREMIUM,
  l.LOB_ID, l.LOB_NAME, l.LOB_CATEGORY, i.ADDRESS AS INSURED_ADDRESS, i.CITY AS INSURED_CITY,
  i.STATE AS INSURED_STATE, i.ZIP_CODE AS INSURED_ZIP,
  CAST(NULL AS VARCHAR) AS INSURED_PROPERTY_ADDRESS,
  CASE WHEN l.LOB_NAME IN ('Homeowners', 'Commercial Property') THEN c.CLAIM_CITY END AS INSURED_PROPERTY_CITY,
  CASE WHEN l.LOB_NAME IN ('Homeowners', 'Commercial Property') THEN c.CLAIM_STATE END AS INSURED_PROPERTY_STATE,
  CASE WHEN l.LOB_NAME IN ('Homeowners', 'Commercial Property') THEN c.CLAIM_ZIP END AS INSURED_PROPERTY_ZIP,
  c.CLAIM_ID, c.CLAIM_NUMBER, c.CLAIM_STATUS, c.LOSS_DATE, c.LOSS_CAUSE, c.CLAIM_STATE, c.CLAIM_CITY, c.CLAIM_ZIP,
  c.CAT_INDICATOR, c.CATASTROPHE_ID, cat.EVENT_NAME AS CATASTROPHE_EVENT_NAME,
  cat.EVENT_TYPE AS CATASTROPHE_EVENT_TYPE, cat.IMPACTED_STATES AS CATASTROPHE_IMPACTED_STATES,
  f.RESERVE_AMOUNT, f.PAID_AMOUNT, f.INCURRED_LOSS, f.RECOVERY_AMOUNT, f.SUBROGATION_AMOUNT
FROM r_insured i
JOIN r_policy p ON i.INSURED_ID = p.INSURED_ID
JOIN r_lob l ON p.LOB_ID = l.LOB_ID
LEFT JOIN r_claims c ON p.POLICY_ID = c.POLICY_ID
LEFT JOIN r_catastrophe cat ON c.CATASTROPHE_ID = cat.CATASTROPHE_ID
LEFT JOIN r_financial f ON c.CLAIM_ID = f.CLAIM_ID""")

TABLES["surrogate_keys"] = with_base("SELECT * FROM r_litigation")

_lc_ref = ("SELECT * FROM (VALUES " + sql_values(ref.LOSS_CAUSES) +
           ") AS t(LOSS_CAUSE, LOSS_CATEGORY, IS_WEATHER_RELATED, WEATHER_CONDITION_MAPPING)")
TABLES["semi_join"] = with_base(f"""
SELECT ROW_NUMBER() OVER (ORDER BY r.LOSS_CAUSE) AS LOSS_CAUSE_KEY, r.LOSS_CAUSE, r.LOSS_CATEGORY,
  r.IS_WEATHER_RELATED, r.WEATHER_CONDITION_MAPPING
FROM ({_lc_ref}) r WHERE r.LOSS_CAUSE IN (SELECT DISTINCT LOSS_CAUSE FROM r_claims)""")

_geo_cols = ["GEOGRAPHY_KEY", "STATE_CODE", "STATE_NAME", "REGION", "CITY", "ZIP_CODE"]
TABLES["join_preview"] = with_base(
    "SELECT " + ", ".join(f"a.{c}" for c in FACT_CLAIMS_COLUMNS) + ", "
    + ", ".join(f"b.{c} AS DIM_{c}" for c in _geo_cols)
    + " FROM fact_claims a JOIN dim_geography b ON a.GEOGRAPHY_KEY = b.GEOGRAPHY_KEY ORDER BY a.CLAIM_KEY LIMIT 10")

TABLES["table_preview"] = with_base(
    "SELECT * FROM fact_claims ORDER BY PAID_AMOUNT DESC, CLAIM_KEY ASC LIMIT 10")

TABLES["conditional_update"] = with_base(f"""
SELECT CLAIM_ID, CLAIM_STATUS,
  CASE WHEN CLAIM_STATUS = 'Stalled' THEN CAST({AS_OF} + CAST(-(CLAIM_ID % 80) - 10 AS INTEGER) AS DATE)
       ELSE LAST_ACTIVITY_DATE END AS LAST_ACTIVITY_DATE
FROM r_claims""")

_counts = [("LINE_OF_BUSINESS", "r_lob"), ("INSURED", "r_insured"), ("VENDOR", "r_vendor"),
           ("CATASTROPHE", "r_catastrophe"), ("POLICY", "r_policy"), ("CLAIMS", "r_claims"),
           ("CLAIM_ASSIGNMENT", "r_claims"), ("FINANCIAL_DATA", "r_financial"), ("CLAIMS_EXPENSE", "r_expense"),
           ("LITIGATION", "r_litigation"), ("DIM_DATE", "dim_date"), ("DIM_CLAIM_TYPE", "dim_claim_type"),
           ("DIM_LOSS_CAUSE", "dim_loss_cause"), ("DIM_GEOGRAPHY", "dim_geography"), ("DIM_POLICY", "dim_policy"),
           ("DIM_WEATHER_EVENT", "dim_weather_event"), ("FACT_CLAIMS", "fact_claims"),
           ("FACT_CLAIM_EXPENSE", "fact_expense")]
TABLES["table_row_counts"] = with_base("\nUNION ALL ".join(
    f"SELECT '{n}' AS TABLE_NAME, COUNT(*) AS ROW_COUNT FROM {t}" for n, t in _counts))
