"""Raw claims tables derived from the driver's TPC-H-style tables.

The mapping gives every raw table of the claims model a source whose size
grows with the input:

  CLAIMS            orders ⋈ customer ⋈ nation (one claim per order, k = o_orderkey)
  FINANCIAL_DATA    lineitem aggregated per order ⋈ CLAIMS
  CLAIMS_EXPENSE    lineitem aggregated per (order, line number)
  LITIGATION        CLAIMS ⋈ POLICY, litigated claims only
  POLICY, INSURED   customer (⋈ nation)
  VENDOR            supplier
  CLAIM_ASSIGNMENT  CLAIMS
  LINE_OF_BUSINESS, CATASTROPHE   literal reference tables

Money is cast to DECIMAL(15,2) (discount and tax to DECIMAL(4,2)) before any
arithmetic. Derived column rules follow the generator formulas of the claims
model with `k` standing for the generator's row number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossledger.functions.money import money
from lossledger.functions.pick import pick
from lossledger.functions.rules import status_from_band
from lossledger.operators.keys import sequential_key
from lossledger.sources import reference as ref


def _zip5(n: Column) -> Column:
    return F.lpad(n.cast("string"), 5, "0")


def _days(base: Column, n: Column) -> Column:
    return F.date_add(base, n.cast("int"))


def _amount(total: str, digits: int) -> Column:
    """A whole-number total as the decimal it stands for."""
    return (F.col(total).cast("decimal(20,0)") * F.lit(10 ** -digits).cast(f"decimal({digits},{digits})")).alias(total)


class RawTables:
    def __init__(self, ctx):
        self.ctx = ctx
        self.spark = ctx.spark

    # tables written by `materialize` (internal key -> directory name)
    STORED = {"insured": "INSURED", "policy": "POLICY", "vendor": "VENDOR", "claims_base": "CLAIMS_BASE",
              "assignment": "CLAIM_ASSIGNMENT", "financial": "FINANCIAL_DATA", "expense": "CLAIMS_EXPENSE",
              "litigation_core": "LITIGATION_CORE", "litigation": "LITIGATION"}

    # tables of claim rows that a store deals by claim
    BY_CLAIM = ("claims_base", "financial", "expense")

    # -- helpers ---------------------------------------------------------
    def _m(self, key, build):
        if self.ctx.raw_dir and key in self.STORED:
            path = f"{self.ctx.raw_dir}/{self.STORED[key]}"
            if not (self.ctx.fused and key != "claims_base" and not self.ctx.store.has(path)):
                by = ["CLAIM_ID"] if key in self.BY_CLAIM else None
                return self.ctx.memo(("raw", key), lambda: self.ctx.stored(path, build, by))
        return self.ctx.memo(("raw", key), build)

    def materialize(self, out_dir: str) -> None:
        """Write the derived raw tables once (each a parquet table); a Context
        with raw_dir=out_dir then reads them instead of re-deriving them, which
        also cuts the lineage for every later job."""
        getters = {"insured": self.insured, "policy": self.policy, "vendor": self.vendor,
                   "claims_base": self._claims_base, "assignment": self.claim_assignment,
                   "financial": self.financial_data, "expense": self.claims_expense,
                   "litigation_core": lambda: self.litigation(with_id=False),
                   "litigation": lambda: self.litigation(with_id=True)}
        # dependency order; each written table replaces its lazy definition,
        # so later tables (financials, litigation, assignments) read the
        # written claims instead of re-deriving the orders/customer join
        for key, name in self.STORED.items():
            path = f"{out_dir}/{name}"
            getters[key]().write.mode("overwrite").parquet(path)
            self.ctx._cache[("raw", key)] = self.spark.read.parquet(path)

    @property
    def _as_of(self) -> Column:
        return F.lit(self.ctx.as_of)

    # -- literal tables --------------------------------------------------
    def line_of_business(self) -> DataFrame:
        return self._m("lob", lambda: ref.line_of_business(self.spark))

    def catastrophe(self) -> DataFrame:
        return self._m("cat", lambda: ref.catastrophe(self.spark))

    # -- customers -> insured / policy -----------------------------------
    def _customer_geo(self) -> DataFrame:
        """customer ⋈ nation; nation is the fixed 25-row TPC-H table, so the
        broadcast is bounded."""
        def build():
            c = self.ctx.table("customer").select("c_custkey", "c_name", "c_nationkey")
            n = self.ctx.table("nation").select("n_nationkey", "n_name")
            return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).drop("n_nationkey")
        return self._m("customer_geo", build)

    def insured(self) -> DataFrame:
        def build():
            c = self._customer_geo()
            i = F.col("c_custkey")
            email = F.lower(F.concat(
                pick(ref.EMAIL_FIRST + [ref.EMAIL_FIRST_DEFAULT] * 40, i % 50), F.lit("."),
                pick(ref.EMAIL_LAST + [ref.EMAIL_LAST_DEFAULT] * 47, F.floor(i / 50) % 50),
                (i + 1).cast("string"), F.lit("@"), pick(ref.EMAIL_DOMAINS, i % 5)))
            return c.select(
                i.alias("INSURED_ID"),
                F.lit("Customer").alias("FIRST_NAME"),
                F.col("c_name").alias("LAST_NAME"),
                F.concat((1000 + (i * 7) % 9000).cast("string"), F.lit(" "), pick(ref.STREETS, i % 10),
                         F.lit(" "), pick(ref.STREET_SUFFIXES, i % 4)).alias("ADDRESS"),
                F.col("n_name").alias("CITY"),
                pick(ref.CLAIM_STATES, F.col("c_nationkey") % 10).alias("STATE"),
                _zip5(10000 + (i * 13) % 90000).alias("ZIP_CODE"),
                F.concat(F.lit("("), F.lpad((100 + (i * 3) % 900).cast("string"), 3, "0"), F.lit(") "),
                         F.lpad((100 + (i * 7) % 900).cast("string"), 3, "0"), F.lit("-"),
                         F.lpad((1000 + (i * 11) % 9000).cast("string"), 4, "0")).alias("PHONE"),
                email.alias("EMAIL"),
                _days(self._as_of, -(18 * 365) - (i * 17) % (50 * 365)).alias("DATE_OF_BIRTH"),
                _days(self._as_of, -((i * 3) % 2000)).cast("timestamp_ntz").alias("CREATED_DATE"),
            )
        return self._m("insured", build)

    def policy(self) -> DataFrame:
        def build():
            c = self.ctx.table("customer").select("c_custkey")
            i = F.col("c_custkey")
            eff = _days(F.lit("2000-01-01").cast("date"), -((i * 47) % 1800))
            term = pick(ref.POLICY_TERMS, i % 3)
            return c.select(
                i.alias("POLICY_ID"),
                F.concat(F.lit("POL-"), F.lpad(i.cast("string"), 6, "0")).alias("POLICY_NUMBER"),
                i.alias("INSURED_ID"),
                (i % 15 + 1).cast("int").alias("LOB_ID"),
                eff.alias("POLICY_EFFECTIVE_DATE"),
                F.add_months(eff, term).alias("POLICY_EXPIRATION_DATE"),
                term.alias("POLICY_TERM_MONTHS"),
                pick(ref.COVERAGE_TYPES, i % 5).alias("COVERAGE_TYPE"),
                money(pick(ref.COVERAGE_LIMITS, i % 4)).alias("COVERAGE_LIMIT"),
                money(pick(ref.DEDUCTIBLES, i % 4), 10, 2).alias("DEDUCTIBLE"),
                money(500 + (i * 113) % 4500, 10, 2).alias("PREMIUM"),
                pick(ref.CLAIM_STATES, i % 10).alias("POLICY_STATE"),
                _zip5(10000 + (i * 17) % 90000).alias("POLICY_ZIP"),
                F.concat(F.lit("Agent_"), (i % 50 + 1).cast("string")).alias("AGENT_NAME"),
                pick(ref.AGENCIES, i % 5).alias("AGENCY_NAME"),
                F.when(i % 7 == 0, "Cancelled").otherwise("Active").alias("POLICY_STATUS"),
            )
        return self._m("policy", build)

    def vendor(self) -> DataFrame:
        def build():
            s = self.ctx.table("supplier").select("s_suppkey", "s_name")
            i = F.col("s_suppkey")
            return s.select(
                i.alias("VENDOR_ID"),
                F.col("s_name").alias("VENDOR_NAME"),
                pick(ref.VENDOR_TYPES, i % 4).alias("VENDOR_TYPE"),
                pick(ref.VENDOR_CITIES, i % 10).alias("VENDOR_CITY"),
                pick(ref.VENDOR_STATES, i % 10).alias("VENDOR_STATE"),
                pick(ref.VENDOR_COST_TIERS, i % 3).alias("VENDOR_COST_TIER"),
                money(F.lit(3).cast("decimal(3,0)") + ((i * 7) % 200).cast("decimal(5,0)") / 100, 3, 2)
                .alias("VENDOR_RATING"),
                (i % 10 != 0).alias("ACTIVE_FLAG"),
            )
        return self._m("vendor", build)

    # -- claims ----------------------------------------------------------
    def _claims_base(self) -> DataFrame:
        """CLAIMS plus the order total used for the reserve amount."""
        def build():
            o = self.ctx.table("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
                                                "o_orderpriority")
            cg = self._customer_geo().select("c_custkey", "c_nationkey", "n_name")
            j = o.join(cg, o.o_custkey == cg.c_custkey)
            if self.ctx.buckets:  # dealt for its table before the columns that follow from others are added
                j = j.repartition(self.ctx.buckets, "o_orderkey")
            k = F.col("o_orderkey")
            r = k % 100
            loss = F.to_date("o_orderdate")
            sev = F.col("o_orderpriority")
            severity = None
            for prio, name in ref.PRIORITY_SEVERITY:
                severity = F.when(sev == prio, name) if severity is None else severity.when(sev == prio, name)
            changed = (k % 4 == 0)
            cat = r < 15
            fraud = r < 8
            fraud_score = (F.when(fraud, 50 + (k * 7) % 50).when(r < 20, (k * 3) % 50).otherwise(0)
                           .cast("decimal(5,2)"))
            cause_idx = k % 15
            desc = F.concat(F.lit("Claim for "),
                            pick(ref.CAUSE_DESCRIPTIONS + [ref.CAUSE_DESCRIPTION_DEFAULT] * 12, cause_idx),
                            F.lit(" - Claim #"), k.cast("string"))
            return j.select(
                k.alias("CLAIM_ID"),
                F.concat(F.lit("CLM-"), F.lpad(k.cast("string"), 8, "0")).alias("CLAIM_NUMBER"),
                F.col("o_custkey").alias("POLICY_ID"),
                F.col("o_custkey").alias("INSURED_ID"),
                (k % 15 + 1).cast("int").alias("LOB_ID"),
                loss.alias("LOSS_DATE"),
                _days(loss, k % 14 + 1).alias("REPORTED_DATE"),
                _days(loss, k % 14 + k % 7 + 2).alias("OPEN_DATE"),
                F.when(r < 60, _days(loss, (k * 7) % 180 + 30)).alias("CLOSE_DATE"),
                pick(ref.CAUSE_SEQUENCE, cause_idx).alias("LOSS_CAUSE"),
                desc.alias("LOSS_DESCRIPTION"),
                cat.alias("CAT_INDICATOR"),
                F.when(cat, (k % 15 + 1).cast("int")).alias("CATASTROPHE_ID"),
                (r < 12).alias("LITIGATION_INDICATOR"),
                severity.alias("CLAIM_SEVERITY"),
                F.when(changed, pick(ref.SEVERITIES, (k + 1) % 5)).alias("PREVIOUS_SEVERITY"),
                F.when(changed, _days(self._as_of, -(k % 60))).alias("SEVERITY_CHANGE_DATE"),
                F.when(changed, pick(ref.CHANGE_STAGES, k % 6)).alias("SEVERITY_CHANGE_STAGE"),
                status_from_band(k).alias("CLAIM_STATUS"),
                pick(ref.CLAIM_STAGES, k % 12).alias("CLAIM_STAGE"),
                pick(ref.CLAIM_STATES, F.col("c_nationkey") % 10).alias("CLAIM_STATE"),
                F.col("n_name").alias("CLAIM_CITY"),
                _zip5(10000 + (F.col("c_custkey") * 13) % 90000).alias("CLAIM_ZIP"),
                fraud.alias("FRAUD_INDICATOR"),
                fraud_score.alias("FRAUD_SCORE"),
                (r < 18).alias("SUBROGATION_INDICATOR"),
                (k % 200 + 1).cast("int").alias("VENDOR_ID"),
                (k % 5 + 1).cast("int").alias("EXPOSURES"),
                _days(self._as_of, -(k % 90)).alias("LAST_ACTIVITY_DATE"),
                _days(loss, k % 7).cast("timestamp_ntz").alias("CREATED_DATE"),
                _days(self._as_of, -(k % 30)).cast("timestamp_ntz").alias("MODIFIED_DATE"),
                money("o_totalprice").alias("_ORDER_TOTAL"),
            )
        return self._m("claims_base", build)

    def claims(self) -> DataFrame:
        return self._m("claims", lambda: self._claims_base().drop("_ORDER_TOTAL"))

    def claim_assignment(self) -> DataFrame:
        def build():
            c = self.claims()
            k = F.col("CLAIM_ID")
            return c.select(
                k.alias("ASSIGNMENT_ID"),
                k,
                F.concat(F.lit("Adjustor_"), (k % 100 + 1).cast("string")).alias("ADJUSTOR_NAME"),
                (k % 100 + 1).cast("int").alias("ADJUSTOR_ID"),
                pick(ref.TEAMS, k % 6).alias("TEAM_NAME"),
                pick(ref.DEPARTMENT_HEADS, k % 6).alias("DEPARTMENT_HEAD"),
                F.col("OPEN_DATE").alias("START_DATE"),
                F.col("CLOSE_DATE").alias("END_DATE"),
                F.when(F.col("CLOSE_DATE").isNotNull(), "Completed").otherwise("Active").alias("ASSIGNMENT_STATUS"),
            )
        return self._m("assignment", build)

    # -- money tables from line items ------------------------------------
    def _lineitem_money(self) -> DataFrame:
        """Line items with their amounts as whole numbers: ext in cents, disc and tax in hundredths. Sums of them and
        of their products (1/10,000) are exact in 64 bits wherever the result fits its money column, and rows and
        partial sums are a third as wide in a shuffle as those of wide decimals."""
        hundredths = lambda c, p: (money(c, p, 2) * 100).cast("long")
        li = self.ctx.table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount",
                                               "l_tax", "l_shipdate")
        return li.select(
            "l_orderkey", "l_linenumber",
            hundredths("l_extendedprice", 15).alias("ext"),
            hundredths("l_discount", 4).alias("disc"),
            hundredths("l_tax", 4).alias("tax"),
            F.to_date("l_shipdate").alias("ship_date"),
        )

    def financial_data(self) -> DataFrame:
        def build():
            # partial aggregation per order happens before the shuffle
            per_order = (self._lineitem_money()
                         .groupBy("l_orderkey")
                         .agg(F.sum("ext").alias("gross"),
                              F.sum(F.col("ext") * F.col("disc")).alias("disc_amt"),
                              F.sum(F.col("ext") * F.col("tax")).alias("tax_amt")))
            c = self._claims_base().select("CLAIM_ID", "CLAIM_STATUS", "SUBROGATION_INDICATOR", "CLOSE_DATE",
                                           "OPEN_DATE", "CREATED_DATE", "_ORDER_TOTAL")
            # exactly the sum of ext * (100 - disc), which so needs no sum of its own in the shuffle
            per_order = per_order.withColumn("net", F.col("gross") * 100 - F.col("disc_amt"))
            per_order = per_order.select("l_orderkey", _amount("gross", 2), *[_amount(a, 4) for a in ("net", "disc_amt", "tax_amt")])
            j = per_order.join(c, per_order.l_orderkey == c.CLAIM_ID)
            k = F.col("CLAIM_ID")
            paid_status = F.col("CLAIM_STATUS").isin("Closed", "Approved")
            subro = F.col("SUBROGATION_INDICATOR")
            recovery = F.when(subro, money("disc_amt")).otherwise(F.lit(0).cast("decimal(15,2)"))
            return j.select(
                k.alias("FINANCIAL_ID"),
                k,
                F.when(paid_status, money("net")).otherwise(F.lit(0)).cast("decimal(15,2)").alias("PAID_AMOUNT"),
                F.col("_ORDER_TOTAL").alias("RESERVE_AMOUNT"),
                money("gross").alias("INCURRED_LOSS"),
                pick(ref.PAYMENT_TYPES, k % 4).alias("PAYMENT_TYPE"),
                F.when(paid_status, _days(F.coalesce("CLOSE_DATE", "OPEN_DATE"), k % 30)).alias("PAYMENT_DATE"),
                recovery.alias("RECOVERY_AMOUNT"),
                F.when(subro, money(recovery * F.lit(0.5).cast("decimal(1,1)")))
                .otherwise(F.lit(0)).cast("decimal(15,2)").alias("SUBROGATION_AMOUNT"),
                money("tax_amt").alias("SALVAGE_AMOUNT"),
                F.col("CREATED_DATE"),
            )
        return self._m("financial", build)

    def claims_expense(self) -> DataFrame:
        def build():
            # dealt by order alone, which serves the join to the claim that may follow as well
            by_order = [*([self.ctx.buckets] if self.ctx.buckets else []), "l_orderkey"]
            per_line = (self._lineitem_money().repartition(*by_order)
                        .groupBy("l_orderkey", "l_linenumber")
                        .agg(F.sum("ext").alias("gross"),
                             F.sum(F.col("ext") * F.col("disc")).alias("inv"),
                             F.sum(F.col("ext") * F.col("tax")).alias("ulae"),
                             F.min("ship_date").alias("first_ship")))
            d12 = "decimal(12,2)"
            per_line = per_line.select("l_orderkey", "l_linenumber", _amount("gross", 2), _amount("inv", 4), _amount("ulae", 4), "first_ship")
            return per_line.select(
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("EXPENSE_ID"),
                F.col("l_orderkey").alias("CLAIM_ID"),
                (F.col("gross") * F.lit(0.10).cast("decimal(3,2)")).cast(d12).alias("LEGAL_FEES"),
                (F.col("gross") * F.lit(0.05).cast("decimal(3,2)")).cast(d12).alias("ADJUSTOR_COSTS"),
                F.col("inv").cast(d12).alias("INVESTIGATION_CHARGES"),
                F.col("ulae").cast(d12).alias("ULAE"),
                F.col("first_ship").alias("EXPENSE_DATE"),
                pick(ref.EXPENSE_CATEGORIES, F.col("l_linenumber") % 4).alias("EXPENSE_CATEGORY"),
            )
        return self._m("expense", build)

    # -- litigation --------------------------------------------------------
    def litigation(self, with_id: bool = True) -> DataFrame:
        """Litigated claims joined to their policy. `with_id=False` skips the
        LITIGATION_ID numbering (a global ordering) for callers that do not
        read the id, such as the claims fact."""
        def build_core():
            c = self.claims().filter(F.col("LITIGATION_INDICATOR"))
            p = self.policy().select("POLICY_ID", "POLICY_NUMBER")
            j = c.join(p, "POLICY_ID")
            k = F.col("CLAIM_ID")
            closed = F.col("CLAIM_STATUS") == "Closed"
            return j.select(
                k,
                "POLICY_NUMBER",
                F.lit(True).alias("LITIGATION_INDICATOR"),
                pick(ref.ATTORNEYS, k % 8).alias("ATTORNEY_ASSIGNED"),
                F.concat(F.col("CLAIM_STATE"), F.lit(" "), pick(ref.COURTS, k % 3)).alias("COURT_JURISDICTION"),
                _days(F.col("OPEN_DATE"), k % 90 + 30).alias("LAWSUIT_FILED_DATE"),
                F.when(closed, money(10000 + (k * 97) % 190000)).alias("SETTLEMENT_AMOUNT"),
                F.when(closed, F.col("CLOSE_DATE")).alias("SETTLEMENT_DATE"),
                money(5000 + (k * 61) % 45000, 12, 2).alias("DEFENSE_COSTS"),
                F.when(closed, "Settled").when(k % 10 < 3, "Discovery").when(k % 10 < 5, "Mediation")
                .otherwise("Trial Pending").alias("LITIGATION_STATUS"),
            )
        core = self._m("litigation_core", build_core)
        if not with_id:
            return core

        def build():
            keyed = sequential_key(core, ["CLAIM_ID"], "LITIGATION_ID")
            return keyed.select("LITIGATION_ID", *core.columns)
        return self._m("litigation", build)

    # -- everything, by reference table name ------------------------------
    def by_name(self, name: str) -> DataFrame:
        return {
            "LINE_OF_BUSINESS": self.line_of_business,
            "INSURED": self.insured,
            "VENDOR": self.vendor,
            "CATASTROPHE": self.catastrophe,
            "POLICY": self.policy,
            "CLAIMS": self.claims,
            "CLAIM_ASSIGNMENT": self.claim_assignment,
            "FINANCIAL_DATA": self.financial_data,
            "CLAIMS_EXPENSE": self.claims_expense,
            "LITIGATION": self.litigation,
        }[name]()

    RAW_TABLES = ["LINE_OF_BUSINESS", "INSURED", "VENDOR", "CATASTROPHE", "POLICY", "CLAIMS", "CLAIM_ASSIGNMENT",
                  "FINANCIAL_DATA", "CLAIMS_EXPENSE", "LITIGATION"]
