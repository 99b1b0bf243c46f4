"""Star schema: six dimensions and two facts.

Build choices where the two published versions of the model disagree:
the calendar spans the data; the fraud rule is a parameter; unknown loss causes are kept with a
NULL category; geography is de-duplicated before numbering; policy status has
Active / Expired / Future at `as_of`; a claim without a catastrophe has a NULL
weather-event key; money is coalesced to 0; days-to-open runs from the
reported date.

Join strategy: dimension tables that come from fixed reference lists are
broadcast explicitly (their row count is fixed). Data-derived dimensions
(geography) and the claim-level tables are equi-joined and left to Catalyst
and AQE, which turn a join into a broadcast only after measuring the side at
run time; otherwise the join stays a shuffle join, so nothing unbounded is
ever shipped to every executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossledger.functions import calendar as cal
from lossledger.functions.rules import event_severity_tier, fraud_risk_tier, primary_weather_driver
from lossledger.operators.keys import sequential_key
from lossledger.sources import reference as ref

STAR_TABLES = ["DIM_DATE", "DIM_CLAIM_TYPE", "DIM_LOSS_CAUSE", "DIM_GEOGRAPHY", "DIM_POLICY",
               "DIM_WEATHER_EVENT", "FACT_CLAIMS", "FACT_CLAIM_EXPENSE"]

FACT_CLAIMS_COLUMNS = [
    "CLAIM_KEY", "CLAIM_NUMBER", "DATE_KEY", "GEOGRAPHY_KEY", "CLAIM_TYPE_KEY", "LOSS_CAUSE_KEY",
    "WEATHER_EVENT_KEY", "POLICY_KEY", "CLAIM_STATUS", "CLAIM_STAGE", "CLAIM_SEVERITY", "EXPOSURES",
    "PAID_AMOUNT", "RESERVE_AMOUNT", "INCURRED_LOSS", "RECOVERY_AMOUNT", "SUBROGATION_AMOUNT",
    "SALVAGE_AMOUNT", "NET_INCURRED", "PAYMENT_TYPE", "PAYMENT_DATE", "FRAUD_INDICATOR", "FRAUD_SCORE",
    "FRAUD_RISK_TIER", "CAT_INDICATOR", "LITIGATION_INDICATOR", "SUBROGATION_INDICATOR",
    "IS_WEATHER_RELATED", "WEATHER_CONDITION_MAPPING", "DAYS_TO_REPORT", "DAYS_TO_OPEN", "DAYS_TO_CLOSE",
    "LOSS_DATE", "REPORTED_DATE", "OPEN_DATE", "CLOSE_DATE", "LAST_ACTIVITY_DATE",
    "LITIGATION_SETTLEMENT_AMOUNT", "LITIGATION_DEFENSE_COSTS", "LITIGATION_STATUS",
]

FACT_EXPENSE_COLUMNS = [
    "EXPENSE_KEY", "CLAIM_KEY", "DATE_KEY", "GEOGRAPHY_KEY", "CLAIM_TYPE_KEY", "LOSS_CAUSE_KEY",
    "WEATHER_EVENT_KEY", "POLICY_KEY", "EXPENSE_DATE", "EXPENSE_CATEGORY", "ACTUAL_LEGAL_FEES",
    "ACTUAL_ADJUSTOR_COSTS", "ACTUAL_INVESTIGATION_CHARGES", "ACTUAL_ULAE", "TOTAL_ACTUAL_EXPENSE",
    "BUDGETED_LEGAL_FEES", "BUDGETED_ADJUSTOR_COSTS", "BUDGETED_INVESTIGATION_CHARGES", "BUDGETED_ULAE",
    "LEGAL_FEES_VARIANCE", "TOTAL_EXPENSE_VARIANCE", "CLAIM_SEVERITY", "FRAUD_INDICATOR", "IS_WEATHER_RELATED",
]

#: The columns of CLAIMS that a fact row is made of.
CLAIM_COLUMNS = ["CLAIM_ID", "CLAIM_NUMBER", "LOSS_DATE", "LOB_ID", "LOSS_CAUSE", "CATASTROPHE_ID", "POLICY_ID", "CLAIM_STATUS",
                 "CLAIM_STAGE", "CLAIM_SEVERITY", "EXPOSURES", "FRAUD_INDICATOR", "FRAUD_SCORE", "CAT_INDICATOR",
                 "LITIGATION_INDICATOR", "SUBROGATION_INDICATOR", "REPORTED_DATE", "OPEN_DATE", "CLOSE_DATE",
                 "LAST_ACTIVITY_DATE", "CLAIM_STATE", "CLAIM_CITY", "CLAIM_ZIP"]

#: Rows of a written fact file: about so many at most; down to so few, a file for each core.
FILE_ROWS, LEAST_ROWS = 250_000, 100

#: What an expense line takes from its claim's fact row.
EXPENSE_FROM_CLAIM = ["CLAIM_KEY", "DATE_KEY", "GEOGRAPHY_KEY", "CLAIM_TYPE_KEY", "LOSS_CAUSE_KEY", "WEATHER_EVENT_KEY",
                      "POLICY_KEY", "CLAIM_SEVERITY", "FRAUD_INDICATOR", "IS_WEATHER_RELATED"]


def date_dimension(days: DataFrame, col: str = "DATE_KEY") -> DataFrame:
    """Calendar columns for a one-column DataFrame of dates."""
    d = F.col(col)
    return days.select(
        d.alias("DATE_KEY"),
        F.year(d).alias("YEAR"),
        F.quarter(d).alias("QUARTER"),
        F.month(d).alias("MONTH"),
        cal.month_name(d).alias("MONTH_NAME"),
        F.dayofmonth(d).alias("DAY_OF_MONTH"),
        cal.day_of_week0(d).alias("DAY_OF_WEEK"),
        cal.day_name(d).alias("DAY_NAME"),
        F.weekofyear(d).alias("WEEK_OF_YEAR"),
        cal.day_of_week0(d).isin(0, 6).alias("IS_WEEKEND"),
        cal.year_quarter(d).alias("YEAR_QUARTER"),
        cal.year_month(d).alias("YEAR_MONTH"),
        cal.first_of_month(d).alias("FIRST_DAY_OF_MONTH"),
        F.last_day(d).alias("LAST_DAY_OF_MONTH"),
        cal.first_of_quarter(d).alias("FIRST_DAY_OF_QUARTER"),
    )


def date_spine(dates: DataFrame) -> DataFrame:
    """One row per day from 1 January of the first year to 31 December of the
    last year among the dates given (one column). The day list comes from
    the one-row bounds with `sequence`: its length is the calendar span, not
    the data size."""
    d = F.col(dates.columns[0])
    bounds = dates.agg(F.min(d).alias("lo"), F.max(d).alias("hi")).where(F.col("lo").isNotNull())
    return bounds.select(F.explode(F.sequence(
        F.trunc("lo", "year"), F.date_add(F.add_months(F.trunc("hi", "year"), 12), -1))).alias("DATE_KEY"))


class StarSchema:
    def __init__(self, ctx):
        self.ctx = ctx
        self.spark = ctx.spark
        self.raw = ctx.star_sources

    def _m(self, key, build):
        if self.ctx.star_dir:
            return self.ctx.memo(("star", key), lambda: self.ctx.stored(f"{self.ctx.star_dir}/{key}", build))
        return self.ctx.memo(("star", key), build)

    # -- dimensions --------------------------------------------------------
    def dim_date(self) -> DataFrame:
        """Every calendar year that a loss, payment or expense date falls in,
        so a report that joins facts to it on any of them drops none."""
        def build():
            dates = (self.raw.claims().select(F.col("LOSS_DATE").alias("d"))
                     .unionByName(self.raw.financial_data().select(F.col("PAYMENT_DATE").alias("d")))
                     .unionByName(self.raw.claims_expense().select(F.col("EXPENSE_DATE").alias("d"))))
            return date_dimension(date_spine(dates))
        return self._m("DIM_DATE", build)

    def dim_claim_type(self) -> DataFrame:
        def build():
            lob = self.raw.line_of_business()
            return lob.select(F.col("LOB_ID").alias("CLAIM_TYPE_KEY"), F.col("LOB_NAME").alias("CLAIM_TYPE"),
                              F.col("LOB_LEAD").alias("CLAIM_TYPE_LEAD"),
                              F.col("LOB_CATEGORY").alias("CLAIM_CATEGORY"))
        return self._m("DIM_CLAIM_TYPE", build)

    def dim_loss_cause(self) -> DataFrame:
        """Distinct causes seen in CLAIMS, categorised by the 15-row reference
        list (broadcast: fixed size); a cause missing from the list is kept
        (category NULL) so no fact row loses its key. Numbered with the
        two-phase operator: the number of distinct causes comes from the data,
        so no single-task window is assumed safe."""
        def build():
            causes = self.raw.claims().select("LOSS_CAUSE").where(F.col("LOSS_CAUSE").isNotNull()).distinct()
            lc = causes.join(F.broadcast(ref.loss_causes(self.spark)), "LOSS_CAUSE", "left")
            lc = lc.withColumn("IS_WEATHER_RELATED", F.coalesce("IS_WEATHER_RELATED", F.lit(False)))
            keyed = sequential_key(lc, ["LOSS_CAUSE"], "LOSS_CAUSE_KEY")
            return keyed.select("LOSS_CAUSE_KEY", "LOSS_CAUSE", "LOSS_CATEGORY", "IS_WEATHER_RELATED",
                                "WEATHER_CONDITION_MAPPING")
        return self._m("DIM_LOSS_CAUSE", build)

    def dim_geography(self) -> DataFrame:
        """DISTINCT (state, city, zip) first, then numbered in that order
        (two-phase numbering, no single-task window)."""
        def build():
            geo = (self.raw.claims()
                   .where(F.col("CLAIM_STATE").isNotNull())
                   .select(F.col("CLAIM_STATE").alias("STATE_CODE"), F.col("CLAIM_CITY").alias("CITY"),
                           F.col("CLAIM_ZIP").alias("ZIP_CODE"))
                   .distinct())
            keyed = sequential_key(geo, ["STATE_CODE", "CITY", "ZIP_CODE"], "GEOGRAPHY_KEY")
            st = F.broadcast(ref.states(self.spark))
            j = keyed.join(st, "STATE_CODE", "left")
            return j.select("GEOGRAPHY_KEY", "STATE_CODE",
                            F.coalesce("STATE_NAME", "STATE_CODE").alias("STATE_NAME"),
                            F.coalesce("REGION", F.lit("Unknown")).alias("REGION"), "CITY", "ZIP_CODE")
        return self._m("DIM_GEOGRAPHY", build)

    def dim_policy(self) -> DataFrame:
        def build():
            p = self.raw.policy()
            i = self.raw.insured().select("INSURED_ID", "FIRST_NAME", "LAST_NAME")
            j = p.join(i, "INSURED_ID", "left")
            as_of = F.lit(self.ctx.as_of)
            status = (F.when(F.col("POLICY_EXPIRATION_DATE") < as_of, "Expired")
                      .when(F.col("POLICY_EFFECTIVE_DATE") > as_of, "Future")
                      .otherwise("Active"))
            return j.select(
                F.col("POLICY_ID").alias("POLICY_KEY"), "POLICY_NUMBER", "INSURED_ID",
                F.concat(F.coalesce("FIRST_NAME", F.lit("")), F.lit(" "), F.coalesce("LAST_NAME", F.lit("")))
                .alias("INSURED_NAME"),
                "POLICY_EFFECTIVE_DATE", "POLICY_EXPIRATION_DATE", "POLICY_TERM_MONTHS", "COVERAGE_TYPE",
                "COVERAGE_LIMIT", "DEDUCTIBLE", "PREMIUM", "POLICY_STATE", "POLICY_ZIP", "AGENT_NAME",
                "AGENCY_NAME", "POLICY_STATUS", status.alias("POLICY_ACTIVE_STATUS"))
        return self._m("DIM_POLICY", build)

    def dim_weather_event(self) -> DataFrame:
        return self._m("DIM_WEATHER_EVENT", lambda: weather_event_rows(self.raw.catastrophe(),
                                                                        self.ctx.catastrophic_loss))

    # -- facts -------------------------------------------------------------
    def fact_claims(self) -> DataFrame:
        return self._m("FACT_CLAIMS", lambda: build_fact_claims(
            self.raw.claims(), self.raw.financial_data(), self.raw.litigation(with_id=False),
            self.dim_geography(), self.dim_loss_cause(), self.ctx.fraud_rule,
            by_days_of(self.raw.claims()) if self.ctx.star_dir else None))

    def fact_claim_expense(self) -> DataFrame:
        return self._m("FACT_CLAIM_EXPENSE", lambda: build_fact_expense(
            self.raw.claims_expense(), self.fact_claims(), self.spark, by_date if self.ctx.star_dir else None))

    def claims_to_deal(self) -> DataFrame:
        """FACT_CLAIMS for a reader that deals it by claim: where no query has written it, it is built there, by claim,
        and not dealt by day first."""
        if self.ctx.store is None or self.ctx.store.has(f"{self.ctx.star_dir}/FACT_CLAIMS"):
            return self.fact_claims()
        return build_fact_claims(self.raw.claims(), self.raw.financial_data(), self.raw.litigation(with_id=False),
                                 self.dim_geography(), self.dim_loss_cause(), self.ctx.fraud_rule)

    def expense_to_merge(self, arrange=None, claims: DataFrame | None = None) -> DataFrame:
        """FACT_CLAIM_EXPENSE for a merge: where no query has written it, it stays inside the merge's plan, dealt by
        `arrange` as in `build_fact_claims`. `claims` is the claims fact, if the caller has it by claim."""
        if self.ctx.store is None or self.ctx.store.has(f"{self.ctx.star_dir}/FACT_CLAIM_EXPENSE"):
            return self.fact_claim_expense()
        return build_fact_expense(self.raw.claims_expense(), claims if claims is not None else self.fact_claims(), self.spark, arrange)

    def by_name(self, name: str) -> DataFrame:
        return {
            "DIM_DATE": self.dim_date, "DIM_CLAIM_TYPE": self.dim_claim_type,
            "DIM_LOSS_CAUSE": self.dim_loss_cause, "DIM_GEOGRAPHY": self.dim_geography,
            "DIM_POLICY": self.dim_policy, "DIM_WEATHER_EVENT": self.dim_weather_event,
            "FACT_CLAIMS": self.fact_claims, "FACT_CLAIM_EXPENSE": self.fact_claim_expense,
        }[name]()

    def write(self, out_dir: str) -> None:
        """Materialise the star under out_dir/<TABLE>: dimensions first; the
        facts are then built from the *written* dimensions, whose file sizes
        Spark knows when it picks the joins.

        Facts are partitioned by ranges of DATE_KEY (a day with many claims is
        split by the claim key) and sorted: each
        file then covers a narrow range of days, and a pushed-down date filter
        skips the files and row groups of other days."""
        for name in STAR_TABLES[:6]:
            self.by_name(name).write.mode("overwrite").parquet(f"{out_dir}/{name}")
        read = {n: self.spark.read.parquet(f"{out_dir}/{n}") for n in STAR_TABLES[:6]}
        fact = build_fact_claims(self.raw.claims(), self.raw.financial_data(), self.raw.litigation(with_id=False),
                                 read["DIM_GEOGRAPHY"], read["DIM_LOSS_CAUSE"], self.ctx.fraud_rule,
                                 by_days_of(self.raw.claims()))
        fact.write.mode("overwrite").parquet(f"{out_dir}/FACT_CLAIMS")
        written = self.spark.read.parquet(f"{out_dir}/FACT_CLAIMS")
        build_fact_expense(self.raw.claims_expense(), written, arrange=by_date).write.mode("overwrite").parquet(
            f"{out_dir}/FACT_CLAIM_EXPENSE")


def by_date(fact: DataFrame) -> DataFrame:
    """The fact's rows range-partitioned and sorted by date, then claim."""
    return fact.repartitionByRange("DATE_KEY", "CLAIM_KEY").sortWithinPartitions("DATE_KEY", "CLAIM_KEY")


def by_days_of(claims: DataFrame):
    """The claims fact's rows dealt to files by ranges of days and sorted, as `by_date` does, without its sample.

    A range partitioning samples its bounds from the rows it moves, so the joins before it run twice. Here the bounds
    come from the claims' rows per day: a day begins where the days before it end, in rows, and a day of several
    files is spread over them by a hash of the claim. The table of days is broadcast and numbered in one task; it is
    as long as the calendar, not as the data."""
    days = claims.groupBy(F.col("LOSS_DATE").alias("_day")).agg(F.count(F.lit(1)).alias("_rows"))
    total = claims.count()
    cores = claims.sparkSession.sparkContext.defaultParallelism
    size = min(FILE_ROWS, max(LEAST_ROWS, -(-total // cores)))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = days.select("_day", "_rows", before.alias("_before")).select(
        "_day", F.floor(F.col("_before") / size).alias("_first"), F.floor((F.col("_before") + F.col("_rows") - 1) / size).alias("_last"))

    def arrange(fact: DataFrame) -> DataFrame:
        dealt = fact.join(F.broadcast(files), F.col("DATE_KEY").eqNullSafe(F.col("_day")), "left")
        file = F.col("_first") + F.pmod(F.xxhash64("CLAIM_KEY"), F.col("_last") - F.col("_first") + 1)
        dealt = dealt.withColumn("_file", F.coalesce(file, F.lit(0)).cast("int")).drop("_day", "_first", "_last")
        return (dealt.repartitionById(max(1, -(-total // size)), "_file").drop("_file")
                .sortWithinPartitions("DATE_KEY", "CLAIM_KEY"))

    return arrange


def weather_event_rows(cat: DataFrame, catastrophic_loss: int) -> DataFrame:
    """DIM_WEATHER_EVENT columns from CATASTROPHE rows (also used by the
    incremental MERGE of that dimension)."""
    return cat.select(
        F.col("CATASTROPHE_ID").alias("WEATHER_EVENT_KEY"), "CATASTROPHE_CODE", "EVENT_NAME",
        F.col("EVENT_TYPE").alias("WEATHER_CONDITION"), "EVENT_DATE", "END_DATE",
        (F.datediff(F.coalesce("END_DATE", "EVENT_DATE"), "EVENT_DATE") + 1).alias("EVENT_DURATION_DAYS"),
        "IMPACTED_STATES", "ESTIMATED_INDUSTRY_LOSS",
        primary_weather_driver(F.col("EVENT_TYPE")).alias("PRIMARY_WEATHER_DRIVER"),
        event_severity_tier(F.col("ESTIMATED_INDUSTRY_LOSS"), catastrophic_loss).alias("EVENT_SEVERITY_TIER"),
    )


def geography_keys(claims: DataFrame, dim_geo: DataFrame) -> DataFrame:
    """(CLAIM_ID, GEOGRAPHY_KEY) by a narrow lookup: only the claim id and the
    three address columns travel to the (state, city, zip) join; the wide
    claim rows stay partitioned by claim id. Geography keys are unique per
    address, so there is at most one row per claim."""
    addr = claims.select("CLAIM_ID", "CLAIM_STATE", "CLAIM_CITY", "CLAIM_ZIP")
    g = dim_geo.select("GEOGRAPHY_KEY", "STATE_CODE", "CITY", "ZIP_CODE")
    j = addr.join(g, (addr.CLAIM_STATE == g.STATE_CODE) & (addr.CLAIM_CITY == g.CITY)
                  & (addr.CLAIM_ZIP == g.ZIP_CODE))
    return j.select("CLAIM_ID", "GEOGRAPHY_KEY")


def build_fact_claims(claims: DataFrame, financial: DataFrame, litigation: DataFrame,
                      dim_geo: DataFrame, dim_cause: DataFrame, fraud_rule: str = "score", arrange=None) -> DataFrame:
    """FACT_CLAIMS: one row per claim (all left joins on unique keys, so the
    row count equals CLAIMS). The financial, litigation and geography-key
    inputs are all keyed by claim id, so the wide claim rows are shuffled
    once, by claim id, and every join reuses that partitioning. `arrange`
    (`by_days_of` for a written table) moves the rows before the columns that
    follow from others are added, so those are not shuffled."""
    return _fact_from(claims, financial, litigation, geography_keys(claims, dim_geo), dim_cause, fraud_rule, arrange)


def _fact_from(claims, financial, litigation, geo_keys, dim_cause, fraud_rule, arrange):
    c = claims.alias("c")
    f = financial.select("CLAIM_ID", "PAID_AMOUNT", "RESERVE_AMOUNT", "INCURRED_LOSS", "RECOVERY_AMOUNT",
                         "SUBROGATION_AMOUNT", "SALVAGE_AMOUNT", "PAYMENT_TYPE", "PAYMENT_DATE").alias("f")
    lit = litigation.select("CLAIM_ID", "SETTLEMENT_AMOUNT", "DEFENSE_COSTS", "LITIGATION_STATUS").alias("l")
    # data-derived dimension: AQE broadcasts it only after measuring its size
    lc = dim_cause.select("LOSS_CAUSE_KEY", "LOSS_CAUSE", "IS_WEATHER_RELATED", "WEATHER_CONDITION_MAPPING").alias("lc")
    j = (c.join(f, F.col("c.CLAIM_ID") == F.col("f.CLAIM_ID"), "left")
         .join(lit, F.col("c.CLAIM_ID") == F.col("l.CLAIM_ID"), "left"))
    j = j.join(geo_keys.alias("g"), F.col("c.CLAIM_ID") == F.col("g.CLAIM_ID"), "left")
    geo_key = F.col("g.GEOGRAPHY_KEY")
    j = j.join(lc, F.col("c.LOSS_CAUSE") == F.col("lc.LOSS_CAUSE"), "left")
    zero = F.lit(0).cast("decimal(15,2)")

    def m0(name):
        return F.coalesce(F.col(f"f.{name}"), zero).cast("decimal(15,2)")

    rows = j.select(
        F.col("c.CLAIM_ID").alias("CLAIM_KEY"), F.col("c.CLAIM_NUMBER"), F.col("c.LOSS_DATE").alias("DATE_KEY"),
        geo_key.alias("GEOGRAPHY_KEY"), F.col("c.LOB_ID").alias("CLAIM_TYPE_KEY"), F.col("lc.LOSS_CAUSE_KEY"),
        F.col("c.CATASTROPHE_ID").alias("WEATHER_EVENT_KEY"), F.col("c.POLICY_ID").alias("POLICY_KEY"),
        F.col("c.CLAIM_STATUS"), F.col("c.CLAIM_STAGE"), F.col("c.CLAIM_SEVERITY"), F.col("c.EXPOSURES"),
        m0("PAID_AMOUNT").alias("PAID_AMOUNT"), m0("RESERVE_AMOUNT").alias("RESERVE_AMOUNT"),
        m0("INCURRED_LOSS").alias("INCURRED_LOSS"), m0("RECOVERY_AMOUNT").alias("RECOVERY_AMOUNT"),
        m0("SUBROGATION_AMOUNT").alias("SUBROGATION_AMOUNT"), m0("SALVAGE_AMOUNT").alias("SALVAGE_AMOUNT"),
        F.col("f.PAYMENT_TYPE"), F.col("f.PAYMENT_DATE"), F.col("c.FRAUD_INDICATOR"), F.col("c.FRAUD_SCORE"),
        F.col("c.CAT_INDICATOR"), F.col("c.LITIGATION_INDICATOR"), F.col("c.SUBROGATION_INDICATOR"),
        F.coalesce(F.col("lc.IS_WEATHER_RELATED"), F.lit(False)).alias("IS_WEATHER_RELATED"),
        F.col("lc.WEATHER_CONDITION_MAPPING"),
        F.col("c.REPORTED_DATE"), F.col("c.OPEN_DATE"), F.col("c.CLOSE_DATE"),
        F.col("c.LAST_ACTIVITY_DATE"),
        F.coalesce(F.col("l.SETTLEMENT_AMOUNT"), zero).alias("LITIGATION_SETTLEMENT_AMOUNT"),
        F.coalesce(F.col("l.DEFENSE_COSTS"), F.lit(0).cast("decimal(12,2)")).alias("LITIGATION_DEFENSE_COSTS"),
        F.col("l.LITIGATION_STATUS"),
    )
    rows = arrange(rows) if arrange else rows
    net = F.col("INCURRED_LOSS") - F.col("RECOVERY_AMOUNT") - F.col("SUBROGATION_AMOUNT") - F.col("SALVAGE_AMOUNT")
    derived = {
        "NET_INCURRED": net.cast("decimal(15,2)"), "LOSS_DATE": F.col("DATE_KEY"),
        "FRAUD_RISK_TIER": fraud_risk_tier(F.col("FRAUD_SCORE"), F.col("FRAUD_INDICATOR"), fraud_rule),
        "DAYS_TO_REPORT": F.datediff("REPORTED_DATE", "DATE_KEY"), "DAYS_TO_OPEN": F.datediff("OPEN_DATE", "REPORTED_DATE"),
        "DAYS_TO_CLOSE": F.datediff("CLOSE_DATE", "OPEN_DATE"),
    }
    return rows.select(*[derived[c].alias(c) if c in derived else F.col(c) for c in FACT_CLAIMS_COLUMNS])


def budget_columns(severity):
    """Budget per expense line by claim severity, with the default for an
    unknown severity, as a CASE over the fixed budget table (five rows, so a
    CASE keeps it inside the scan stage instead of a join)."""
    cols = []
    for idx, name in enumerate(["BUDGETED_LEGAL_FEES", "BUDGETED_ADJUSTOR_COSTS",
                                "BUDGETED_INVESTIGATION_CHARGES", "BUDGETED_ULAE"]):
        expr = None
        for row in ref.EXPENSE_BUDGET:
            expr = (F.when(severity == row[0], row[idx + 1]) if expr is None
                    else expr.when(severity == row[0], row[idx + 1]))
        cols.append(expr.otherwise(ref.EXPENSE_BUDGET_DEFAULT[idx]).cast("int").alias(name))
    return cols


def build_fact_expense(expense: DataFrame, fact_claims: DataFrame, spark=None, arrange=None, more=()) -> DataFrame:
    """FACT_CLAIM_EXPENSE: expense lines inner-joined to their claim fact row
    (many expenses per claim; both sides shuffle on the claim key). `arrange`
    as in `build_fact_claims`; `more` are columns of `expense` to keep."""
    fc = fact_claims.select(*EXPENSE_FROM_CLAIM)
    j = expense.join(fc, expense.CLAIM_ID == fc.CLAIM_KEY).drop("CLAIM_ID")
    j = arrange(j) if arrange else j
    b = budget_columns(F.col("CLAIM_SEVERITY"))
    actual = (F.col("LEGAL_FEES") + F.col("ADJUSTOR_COSTS") + F.col("INVESTIGATION_CHARGES") + F.col("ULAE"))
    with_budget = j.select("*", *b)
    budget_total = (F.col("BUDGETED_LEGAL_FEES") + F.col("BUDGETED_ADJUSTOR_COSTS")
                    + F.col("BUDGETED_INVESTIGATION_CHARGES") + F.col("BUDGETED_ULAE"))
    return with_budget.select(
        F.col("EXPENSE_ID").alias("EXPENSE_KEY"), "CLAIM_KEY", "DATE_KEY", "GEOGRAPHY_KEY", "CLAIM_TYPE_KEY",
        "LOSS_CAUSE_KEY", "WEATHER_EVENT_KEY", "POLICY_KEY", "EXPENSE_DATE", "EXPENSE_CATEGORY",
        F.col("LEGAL_FEES").alias("ACTUAL_LEGAL_FEES"), F.col("ADJUSTOR_COSTS").alias("ACTUAL_ADJUSTOR_COSTS"),
        F.col("INVESTIGATION_CHARGES").alias("ACTUAL_INVESTIGATION_CHARGES"), F.col("ULAE").alias("ACTUAL_ULAE"),
        actual.cast("decimal(15,2)").alias("TOTAL_ACTUAL_EXPENSE"),
        "BUDGETED_LEGAL_FEES", "BUDGETED_ADJUSTOR_COSTS", "BUDGETED_INVESTIGATION_CHARGES", "BUDGETED_ULAE",
        (F.col("LEGAL_FEES") - F.col("BUDGETED_LEGAL_FEES")).cast("decimal(15,2)").alias("LEGAL_FEES_VARIANCE"),
        (actual - budget_total).cast("decimal(15,2)").alias("TOTAL_EXPENSE_VARIANCE"),
        "CLAIM_SEVERITY", "FRAUD_INDICATOR", "IS_WEATHER_RELATED", *more,
    )
