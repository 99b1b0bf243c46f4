"""Seed-data generators of the claims model (G-1 … G-9).

Each table is produced by `spark.range(n)` (row number `seq`, ids = seq + 1)
and column rules of the original generator, so any size can be generated in
parallel. "Today" is the `as_of` parameter. `SeedTables` exposes the same
interface as `RawTables`, so the star schema and every report run unchanged
on seed data (the golden test checks the documented seed totals).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossledger.functions.money import money
from lossledger.functions.pick import pick
from lossledger.functions.rules import status_from_band
from lossledger.operators.keys import sequential_key
from lossledger.sources import reference as ref

SEED_START = dt.date(2020, 1, 1)
POLICY_START = dt.date(2025, 1, 1)


def _d(base, n: Column) -> Column:
    base = F.lit(base) if isinstance(base, dt.date) else base
    return F.date_add(base, n.cast("int"))


class SeedTables:
    RAW_TABLES = ["LINE_OF_BUSINESS", "INSURED", "VENDOR", "CATASTROPHE", "POLICY", "CLAIMS", "CLAIM_ASSIGNMENT",
                  "FINANCIAL_DATA", "CLAIMS_EXPENSE", "LITIGATION"]

    def __init__(self, ctx, n_insured=8000, n_vendor=200, n_policy=40, n_claims=10000, touch_ups=True):
        self.ctx, self.spark = ctx, ctx.spark
        self.n = dict(insured=n_insured, vendor=n_vendor, policy=n_policy, claims=n_claims)
        self.touch_ups = touch_ups

    def _m(self, key, build):
        return self.ctx.memo(("seed", key), build)

    @property
    def _today(self) -> Column:
        return F.lit(self.ctx.as_of)

    def _rows(self, n: int) -> DataFrame:
        return self.spark.range(n).withColumnRenamed("id", "seq")

    def line_of_business(self) -> DataFrame:
        return self._m("lob", lambda: ref.line_of_business(self.spark))

    def catastrophe(self) -> DataFrame:
        return self._m("cat", lambda: ref.catastrophe(self.spark))

    # G-1
    def insured(self) -> DataFrame:
        def build():
            s = F.col("seq")
            first = pick(ref.FIRST_NAMES, s % 50)
            last = pick(ref.LAST_NAMES, F.floor(s / 50) % 50)
            email = F.lower(F.concat(pick(ref.EMAIL_FIRST + [ref.EMAIL_FIRST_DEFAULT] * 40, s % 50), F.lit("."),
                                     pick(ref.EMAIL_LAST + [ref.EMAIL_LAST_DEFAULT] * 47, F.floor(s / 50) % 50),
                                     (s + 1).cast("string"), F.lit("@"), pick(ref.EMAIL_DOMAINS, s % 5)))
            return self._rows(self.n["insured"]).select(
                (s + 1).cast("int").alias("INSURED_ID"), first.alias("FIRST_NAME"), last.alias("LAST_NAME"),
                F.concat((1000 + (s * 7) % 9000).cast("string"), F.lit(" "), pick(ref.STREETS, s % 10), F.lit(" "),
                         pick(ref.STREET_SUFFIXES, s % 4)).alias("ADDRESS"),
                pick(ref.CITIES, s % 24).alias("CITY"), pick(ref.CLAIM_STATES, s % 10).alias("STATE"),
                F.lpad((10000 + (s * 13) % 90000).cast("string"), 5, "0").alias("ZIP_CODE"),
                F.concat(F.lit("("), F.lpad((100 + (s * 3) % 900).cast("string"), 3, "0"), F.lit(") "),
                         F.lpad((100 + (s * 7) % 900).cast("string"), 3, "0"), F.lit("-"),
                         F.lpad((1000 + (s * 11) % 9000).cast("string"), 4, "0")).alias("PHONE"),
                email.alias("EMAIL"),
                _d(self._today, -(18 * 365) - (s * 17) % (50 * 365)).alias("DATE_OF_BIRTH"),
                _d(self._today, -((s * 3) % 2000)).cast("timestamp_ntz").alias("CREATED_DATE"))
        return self._m("insured", build)

    # G-2
    def vendor(self) -> DataFrame:
        def build():
            s = F.col("seq")
            t = s % 4
            name = F.element_at(F.array(*[F.array(*[F.lit(v) for v in names]) for names in ref.VENDOR_NAMES]),
                                (t + 1).cast("int"))
            return self._rows(self.n["vendor"]).select(
                (s + 1).cast("int").alias("VENDOR_ID"),
                F.concat(F.element_at(name, (F.floor(s / 4) % 10 + 1).cast("int")), F.lit("_"),
                         (s + 1).cast("string")).alias("VENDOR_NAME"),
                pick(ref.VENDOR_TYPES, t).alias("VENDOR_TYPE"), pick(ref.VENDOR_CITIES, s % 10).alias("VENDOR_CITY"),
                pick(ref.VENDOR_STATES, s % 10).alias("VENDOR_STATE"),
                pick(ref.VENDOR_COST_TIERS, s % 3).alias("VENDOR_COST_TIER"),
                money((300 + (s * 7) % 200).cast("decimal(5,0)") / 100, 3, 2).alias("VENDOR_RATING"),
                (s % 10 != 0).alias("ACTIVE_FLAG"))
        return self._m("vendor", build)

    # G-3
    def policy(self) -> DataFrame:
        def build():
            s = F.col("seq")
            eff = _d(POLICY_START, -((s * 47) % 1800))
            term = pick(ref.POLICY_TERMS, s % 3)
            return self._rows(self.n["policy"]).select(
                (s + 1).cast("int").alias("POLICY_ID"),
                F.concat(F.lit("POL-"), F.lpad((s + 1).cast("string"), 6, "0")).alias("POLICY_NUMBER"),
                (s * 200 + 1).cast("int").alias("INSURED_ID"), (s % 15 + 1).cast("int").alias("LOB_ID"),
                eff.alias("POLICY_EFFECTIVE_DATE"), F.add_months(eff, term).alias("POLICY_EXPIRATION_DATE"),
                term.alias("POLICY_TERM_MONTHS"), pick(ref.COVERAGE_TYPES, s % 5).alias("COVERAGE_TYPE"),
                money(pick(ref.COVERAGE_LIMITS, s % 4)).alias("COVERAGE_LIMIT"),
                money(pick(ref.DEDUCTIBLES, s % 4), 10, 2).alias("DEDUCTIBLE"),
                money(500 + (s * 113) % 4500, 10, 2).alias("PREMIUM"),
                pick(ref.CLAIM_STATES, s % 10).alias("POLICY_STATE"),
                F.lpad((10000 + (s * 17) % 90000).cast("string"), 5, "0").alias("POLICY_ZIP"),
                F.concat(F.lit("Agent_"), (s % 50 + 1).cast("string")).alias("AGENT_NAME"),
                pick(ref.AGENCIES, s % 5).alias("AGENCY_NAME"),
                F.when(s % 7 == 0, "Cancelled").otherwise("Active").alias("POLICY_STATUS"))
        return self._m("policy", build)

    # G-4 (+ G-5 touch-ups)
    def claims(self) -> DataFrame:
        def build():
            s = F.col("seq")
            r = s % 100
            day = (s * 23) % 2262
            changed = s % 4 == 0
            df = self._rows(self.n["claims"]).select(
                (s + 1).cast("int").alias("CLAIM_ID"),
                F.concat(F.lit("CLM-"), F.lpad((s + 1).cast("string"), 8, "0")).alias("CLAIM_NUMBER"),
                (s % 40 + 1).cast("int").alias("POLICY_ID"), (s % 8000 + 1).cast("int").alias("INSURED_ID"),
                (s % 15 + 1).cast("int").alias("LOB_ID"),
                _d(SEED_START, day).alias("LOSS_DATE"),
                _d(SEED_START, day + s % 14 + 1).alias("REPORTED_DATE"),
                _d(SEED_START, day + s % 14 + s % 7 + 2).alias("OPEN_DATE"),
                F.when(r < 60, _d(SEED_START, day + (s * 7) % 180 + 30)).alias("CLOSE_DATE"),
                pick(ref.CAUSE_SEQUENCE, s % 15).alias("LOSS_CAUSE"),
                F.concat(F.lit("Claim for "),
                         pick(ref.CAUSE_DESCRIPTIONS + [ref.CAUSE_DESCRIPTION_DEFAULT] * 12, s % 15),
                         F.lit(" - Claim #"), (s + 1).cast("string")).alias("LOSS_DESCRIPTION"),
                (r < 15).alias("CAT_INDICATOR"), F.when(r < 15, (s % 15 + 1).cast("int")).alias("CATASTROPHE_ID"),
                (r < 12).alias("LITIGATION_INDICATOR"),
                pick(ref.SEVERITIES, s % 5).alias("CLAIM_SEVERITY"),
                F.when(changed, pick(ref.SEVERITIES, (s + 1) % 5)).alias("PREVIOUS_SEVERITY"),
                F.when(changed, _d(self._today, -(s % 60))).alias("SEVERITY_CHANGE_DATE"),
                F.when(changed, pick(ref.CHANGE_STAGES, s % 6)).alias("SEVERITY_CHANGE_STAGE"),
                status_from_band(s).alias("CLAIM_STATUS"), pick(ref.CLAIM_STAGES, s % 12).alias("CLAIM_STAGE"),
                pick(ref.CLAIM_STATES, s % 10).alias("CLAIM_STATE"), pick(ref.CITIES, s % 24).alias("CLAIM_CITY"),
                F.lpad((10000 + (s * 13) % 90000).cast("string"), 5, "0").alias("CLAIM_ZIP"),
                (r < 8).alias("FRAUD_INDICATOR"),
                F.when(r < 8, 50 + (s * 7) % 50).when(r < 20, (s * 3) % 50).otherwise(0).cast("decimal(5,2)")
                .alias("FRAUD_SCORE"),
                (r < 18).alias("SUBROGATION_INDICATOR"), (s % 200 + 1).cast("int").alias("VENDOR_ID"),
                (s % 5 + 1).cast("int").alias("EXPOSURES"),
                _d(self._today, -(s % 90)).alias("LAST_ACTIVITY_DATE"),
                _d(SEED_START, day + s % 7).cast("timestamp_ntz").alias("CREATED_DATE"),
                _d(self._today, -(s % 30)).cast("timestamp_ntz").alias("MODIFIED_DATE"))
            if not self.touch_ups:
                return df
            cid = F.col("CLAIM_ID")
            return (df.withColumn("SEVERITY_CHANGE_DATE",
                                  F.when(F.col("PREVIOUS_SEVERITY").isNotNull() & (cid <= 800),
                                         _d(self._today, -(cid % 28))).otherwise(F.col("SEVERITY_CHANGE_DATE")))
                    .withColumn("LAST_ACTIVITY_DATE",
                                F.when(F.col("CLAIM_STATUS") == "Stalled", _d(self._today, -(cid % 80) - 10))
                                .otherwise(F.col("LAST_ACTIVITY_DATE"))))
        return self._m("claims", build)

    # G-6
    def claim_assignment(self) -> DataFrame:
        def build():
            k = F.col("CLAIM_ID")
            return self.claims().select(
                k.alias("ASSIGNMENT_ID"), k,
                F.concat(F.lit("Adjustor_"), (k % 100 + 1).cast("string")).alias("ADJUSTOR_NAME"),
                (k % 100 + 1).cast("int").alias("ADJUSTOR_ID"), pick(ref.TEAMS, k % 6).alias("TEAM_NAME"),
                pick(ref.DEPARTMENT_HEADS, k % 6).alias("DEPARTMENT_HEAD"), F.col("OPEN_DATE").alias("START_DATE"),
                F.col("CLOSE_DATE").alias("END_DATE"),
                F.when(F.col("CLOSE_DATE").isNotNull(), "Completed").otherwise("Active").alias("ASSIGNMENT_STATUS"))
        return self._m("assignment", build)

    # G-7
    def financial_data(self) -> DataFrame:
        def build():
            k = F.col("CLAIM_ID")
            paid = F.col("CLAIM_STATUS").isin("Closed", "Approved")
            sub = F.col("SUBROGATION_INDICATOR")
            z = F.lit(0).cast("decimal(15,2)")
            return self.claims().select(
                k.alias("FINANCIAL_ID"), k,
                F.when(paid, money(1000 + (k * 97) % 99000)).otherwise(z).alias("PAID_AMOUNT"),
                money(5000 + (k * 73) % 95000).alias("RESERVE_AMOUNT"),
                money(5000 + (k * 83) % 100000).alias("INCURRED_LOSS"),
                pick(ref.PAYMENT_TYPES, k % 4).alias("PAYMENT_TYPE"),
                F.when(paid, _d(F.coalesce("CLOSE_DATE", "OPEN_DATE"), k % 30)).alias("PAYMENT_DATE"),
                F.when(sub, money((k * 41) % 20000)).otherwise(z).alias("RECOVERY_AMOUNT"),
                F.when(sub, money((k * 37) % 15000)).otherwise(z).alias("SUBROGATION_AMOUNT"),
                money((k * 29) % 5000).alias("SALVAGE_AMOUNT"), "CREATED_DATE")
        return self._m("financial", build)

    # G-8
    def claims_expense(self) -> DataFrame:
        def build():
            k = F.col("CLAIM_ID")
            return self.claims().select(
                k.alias("EXPENSE_ID"), k,
                F.when(F.col("LITIGATION_INDICATOR"), money(5000 + (k * 89) % 45000, 12, 2))
                .otherwise(money((k * 23) % 2000, 12, 2)).alias("LEGAL_FEES"),
                money(500 + (k * 67) % 4500, 12, 2).alias("ADJUSTOR_COSTS"),
                F.when(F.col("FRAUD_INDICATOR"), money(2000 + (k * 53) % 8000, 12, 2))
                .otherwise(money((k * 19) % 1000, 12, 2)).alias("INVESTIGATION_CHARGES"),
                money(200 + (k * 31) % 1800, 12, 2).alias("ULAE"),
                _d(F.col("OPEN_DATE"), k % 60).alias("EXPENSE_DATE"),
                pick(ref.EXPENSE_CATEGORIES, k % 4).alias("EXPENSE_CATEGORY"))
        return self._m("expense", build)

    # G-9
    def litigation(self, with_id: bool = True) -> DataFrame:
        def build_core():
            c = self.claims().where(F.col("LITIGATION_INDICATOR"))
            j = c.join(self.policy().select("POLICY_ID", "POLICY_NUMBER"), "POLICY_ID")
            k = F.col("CLAIM_ID")
            closed = F.col("CLAIM_STATUS") == "Closed"
            return j.select(
                k, "POLICY_NUMBER", F.lit(True).alias("LITIGATION_INDICATOR"),
                pick(ref.ATTORNEYS, k % 8).alias("ATTORNEY_ASSIGNED"),
                F.concat(F.col("CLAIM_STATE"), F.lit(" "), pick(ref.COURTS, k % 3)).alias("COURT_JURISDICTION"),
                _d(F.col("OPEN_DATE"), k % 90 + 30).alias("LAWSUIT_FILED_DATE"),
                F.when(closed, money(10000 + (k * 97) % 190000)).alias("SETTLEMENT_AMOUNT"),
                F.when(closed, F.col("CLOSE_DATE")).alias("SETTLEMENT_DATE"),
                money(5000 + (k * 61) % 45000, 12, 2).alias("DEFENSE_COSTS"),
                F.when(closed, "Settled").when(k % 10 < 3, "Discovery").when(k % 10 < 5, "Mediation")
                .otherwise("Trial Pending").alias("LITIGATION_STATUS"))
        core = self._m("litigation_core", build_core)
        if not with_id:
            return core
        return self._m("litigation", lambda: sequential_key(core, ["CLAIM_ID"], "LITIGATION_ID")
                       .select("LITIGATION_ID", *core.columns))

    def by_name(self, name: str) -> DataFrame:
        return {"LINE_OF_BUSINESS": self.line_of_business, "INSURED": self.insured, "VENDOR": self.vendor,
                "CATASTROPHE": self.catastrophe, "POLICY": self.policy, "CLAIMS": self.claims,
                "CLAIM_ASSIGNMENT": self.claim_assignment, "FINANCIAL_DATA": self.financial_data,
                "CLAIMS_EXPENSE": self.claims_expense, "LITIGATION": self.litigation}[name]()
