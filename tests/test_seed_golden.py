"""Golden test: the seed generators reproduce the documented seed totals
(10,000 claims), and the star schema + reports on seed data give them."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lossledger.context import Context
from lossledger.plans import reports as R
from tests.seeds import SeedTables


@pytest.fixture(scope="module")
def seed(spark):
    return Context(spark, "", as_of=dt.date(2026, 4, 1), tables=SeedTables)


def test_seed_row_counts(seed):
    r = seed.raw
    counts = {t: r.by_name(t).count() for t in r.RAW_TABLES}
    assert counts == {"LINE_OF_BUSINESS": 15, "INSURED": 8000, "VENDOR": 200, "CATASTROPHE": 15, "POLICY": 40,
                      "CLAIMS": 10000, "CLAIM_ASSIGNMENT": 10000, "FINANCIAL_DATA": 10000,
                      "CLAIMS_EXPENSE": 10000, "LITIGATION": 1200}


def test_seed_status_and_severity(seed):
    c = seed.raw.claims()
    status = {r[0]: r[1] for r in c.groupBy("CLAIM_STATUS").count().collect()}
    assert status == {"Closed": 4500, "Approved": 1000, "Rejected": 1000, "Open": 1000, "Stalled": 1500,
                      "Pending Review": 1000}
    sev = {r[0]: r[1] for r in c.groupBy("CLAIM_SEVERITY").count().collect()}
    assert set(sev.values()) == {2000}
    lo, hi = c.agg(F.min("LOSS_DATE"), F.max("LOSS_DATE")).first()
    assert (lo, hi) == (dt.date(2020, 1, 1), dt.date(2026, 3, 11))


def test_seed_kpis(seed):
    k = R.kpi_summary(seed).first().asDict()
    assert k["TOTAL_CLAIMS"] == 10000
    assert (k["FRAUD"], k["CAT"], k["LITIGATED"], k["WEATHER"]) == (800, 1500, 1200, 3334)
    assert k["TOTAL_PAID"] == Decimal("272987000.00")
    assert k["TOTAL_RESERVES"] == Decimal("511690000.00")
    assert k["TOTAL_INCURRED"] == Decimal("537315000.00")
    assert k["NET_INCURRED"] == Decimal("481176200.00")
    assert k["AVG_COST"] == Decimal("27298.70")
    assert k["AVG_CLOSE_DAYS"] == Decimal("107.9")
    w = R.waterfall(seed).collect()
    amounts = {r["STEP"]: r["AMOUNT"] for r in w}
    assert amounts["Recovery"] == Decimal("-17551100.00")
    assert amounts["Subrogation"] == Decimal("-13592700.00")
    assert amounts["Salvage"] == Decimal("-24995000.00")


def test_seed_close_days_and_subrogation(seed):
    fc = seed.star.fact_claims()
    n, lo, hi = fc.where(F.col("DAYS_TO_CLOSE").isNotNull()).agg(
        F.count("*"), F.min("DAYS_TO_CLOSE"), F.max("DAYS_TO_CLOSE")).first()
    assert (n, lo, hi) == (6000, 10, 206)
    assert fc.where("SUBROGATION_INDICATOR").count() == 1800
    assert fc.where(F.col("PAYMENT_DATE").isNotNull()).count() == 5500


def test_seed_regions(seed):
    rows = {r["REGION"]: (r["TOTAL_CLAIMS"], r["FRAUD_COUNT"]) for r in R.region_performance(seed).collect()}
    assert rows == {"Midwest": (3000, 200), "Southeast": (3000, 200), "Northeast": (2000, 200),
                    "South": (1000, 100), "West": (1000, 100)}
    assert seed.star.dim_geography().count() == 10000


def test_seed_expense_totals(seed):
    fe = seed.star.fact_claim_expense()
    tot, var = fe.agg(F.sum("TOTAL_ACTUAL_EXPENSE"), F.sum("TOTAL_EXPENSE_VARIANCE")).first()
    assert tot == Decimal("89253500.00")
    assert var == Decimal("-211746500.00")


def test_seed_severity_change_rows(seed):
    c = seed.raw.claims().where(F.col("SEVERITY_CHANGE_STAGE").isNotNull())
    up = c.where(F.col("PREVIOUS_SEVERITY") < F.col("CLAIM_SEVERITY")).count()
    down = c.where(F.col("PREVIOUS_SEVERITY") > F.col("CLAIM_SEVERITY")).count()
    assert (c.count(), up, down) == (2500, 1000, 1500)


def test_seed_fraud_tier_rules(seed):
    tiers = {(r["RULE"], r["FRAUD_RISK_TIER"]): r["CLAIM_COUNT"] for r in R.fraud_tier_rules(seed).collect()}
    assert tiers == {("indicator", "High Risk"): 300, ("indicator", "Medium Risk"): 500,
                     ("indicator", "No Flag"): 9200, ("score", "High Risk"): 600, ("score", "Medium Risk"): 900,
                     ("score", "No Flag"): 8500}


def test_seed_dates_beyond_2025(seed):
    c, f = seed.raw.claims(), seed.raw.financial_data()
    cut = dt.date(2025, 12, 31)
    assert c.where(F.col("LOSS_DATE") > cut).count() == 308
    pay = f.where(F.col("PAYMENT_DATE").isNotNull())
    lo, hi = pay.agg(F.min("PAYMENT_DATE"), F.max("PAYMENT_DATE")).first()
    assert (lo, hi) == (dt.date(2020, 2, 1), dt.date(2026, 10, 10))
    assert pay.where(F.col("PAYMENT_DATE") > cut).count() == 438
