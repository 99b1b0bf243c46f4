"""Business reports over the star schema (dashboard, fraud, weather, backlog).

Every report is one DataFrame plan over the fact table(s): one scan with
conditional aggregates instead of several filtered scans; dimension lookups
on small reference dims are broadcast; month-relative reports aggregate per
month first and pick months from that small result. All computed columns are
aliased and explicitly typed (counts BIGINT, money DECIMAL(38,2), rounded
values DECIMAL(38,k)).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.functions.money import avg_round, count_if, pct, round_div, sum_money
from lossledger.functions.rules import fraud_score_bucket, severity_rank
from lossledger.sources.reference import SEVERITIES


def _r0(c) -> F.Column:
    """ROUND(SUM(money), 0) as DECIMAL(38,0)."""
    return F.round(F.sum(c), 0).cast("decimal(38,0)")


def _rollup_through(fact: DataFrame, fk: str, dim: DataFrame, dim_cols: list[str], own_cols: list[str],
                    partials: list, finals: list) -> DataFrame:
    """Aggregate the fact per foreign key first (exact partial counts/sums),
    join the reduced rows to the dimension (inner, like the reports' joins),
    then finish the aggregation per dimension attribute. A dimension too big
    to broadcast then meets one row per key instead of every fact row."""
    pre = fact.groupBy(fk, *own_cols).agg(*partials)
    j = pre.join(dim.select(fk, *dim_cols), fk)
    return j.groupBy(*dim_cols, *own_cols).agg(*finals)


def _claims_by_month(ctx) -> DataFrame:
    s = ctx.star
    d = F.broadcast(s.dim_date().select("DATE_KEY", "YEAR_MONTH", "YEAR"))
    return s.fact_claims().join(d, "DATE_KEY")


# -- B-1 / B-34 ---------------------------------------------------------------
def kpi_summary(ctx) -> DataFrame:
    fc = ctx.star.fact_claims()
    st = F.col("CLAIM_STATUS")
    return fc.agg(
        F.count(F.lit(1)).alias("TOTAL_CLAIMS"),
        count_if(st == "Open").alias("OPEN_CLAIMS"),
        count_if(st == "Closed").alias("CLOSED_CLAIMS"),
        sum_money("PAID_AMOUNT").alias("TOTAL_PAID"),
        sum_money("RESERVE_AMOUNT").alias("TOTAL_RESERVES"),
        sum_money("NET_INCURRED").alias("NET_INCURRED"),
        sum_money(F.col("RECOVERY_AMOUNT") + F.col("SUBROGATION_AMOUNT") + F.col("SALVAGE_AMOUNT"))
        .alias("TOTAL_RECOVERY"),
        avg_round("PAID_AMOUNT", 2).alias("AVG_COST"),
        avg_round("DAYS_TO_CLOSE", 1).alias("AVG_CLOSE_DAYS"),
        count_if(F.col("LITIGATION_INDICATOR")).alias("LITIGATED"),
        count_if(F.col("FRAUD_INDICATOR")).alias("FRAUD"),
        count_if(F.col("CAT_INDICATOR")).alias("CAT"),
        count_if(F.col("IS_WEATHER_RELATED")).alias("WEATHER"),
        sum_money("INCURRED_LOSS").alias("TOTAL_INCURRED"),
    )


# -- B-2 ----------------------------------------------------------------------
def ratios(ctx) -> DataFrame:
    fc = ctx.star.fact_claims()
    st = F.col("CLAIM_STATUS")
    k = fc.agg(
        F.count(F.lit(1)).alias("TOTAL_CLAIMS"),
        count_if(st == "Closed").alias("SETTLED"),
        count_if(st.isin("Open", "Pending Review", "Stalled")).alias("PENDING"),
        count_if(F.col("FRAUD_INDICATOR")).alias("FRAUD"),
        F.sum("PAID_AMOUNT").alias("PAID"),
        F.sum("INCURRED_LOSS").alias("INCURRED"),
    )
    return k.select(
        "TOTAL_CLAIMS",
        pct(F.col("SETTLED"), F.col("TOTAL_CLAIMS"), 1).alias("SETTLEMENT_RATIO"),
        pct(F.col("PAID"), F.col("INCURRED"), 1).alias("LOSS_RATIO"),
        pct(F.col("PENDING"), F.col("TOTAL_CLAIMS"), 1).alias("PENDING_RATIO"),
        pct(F.col("FRAUD"), F.col("TOTAL_CLAIMS"), 2).alias("FRAUD_RATE"),
    )


# -- per-month base for B-3 / B-4 -------------------------------------------------
def _monthly(ctx) -> DataFrame:
    st = F.col("CLAIM_STATUS")
    return _claims_by_month(ctx).groupBy("YEAR_MONTH", "YEAR").agg(
        F.count(F.lit(1)).alias("CLAIMS"),
        count_if(st == "Open").alias("OPEN_C"),
        count_if(st == "Closed").alias("SETTLED"),
        F.sum("PAID_AMOUNT").alias("PAID"),
        F.sum("RESERVE_AMOUNT").alias("RESERVES"),
        F.count("PAID_AMOUNT").alias("PAID_N"),
        count_if(F.col("FRAUD_INDICATOR")).alias("FRAUD"),
    )


def _latest_months(monthly: DataFrame) -> DataFrame:
    """One row: the latest month with claims and the month before it."""
    latest = monthly.agg(F.max("YEAR_MONTH").alias("CM"))
    first = F.to_date(F.concat(F.col("CM"), F.lit("-01")))
    return latest.select("CM", F.date_format(F.add_months(first, -1), "yyyy-MM").alias("PM"),
                         F.year(first).alias("CY"))


# -- B-3 ----------------------------------------------------------------------
def month_compare(ctx) -> DataFrame:
    m = _monthly(ctx)
    lm = F.broadcast(_latest_months(m))
    cur = m.alias("c")
    j = (lm.join(cur, F.col("c.YEAR_MONTH") == F.col("CM"), "left")
         .join(m.alias("p"), F.col("p.YEAR_MONTH") == F.col("PM"), "left"))

    def z(c):
        return F.coalesce(F.col(c), F.lit(0))

    def zm(c):
        return F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,2)")

    return j.select(
        F.col("CM").alias("CURRENT_MONTH"), F.col("PM").alias("PREVIOUS_MONTH"),
        z("c.CLAIMS").cast("long").alias("CUR_CLAIMS"), z("p.CLAIMS").cast("long").alias("PREV_CLAIMS"),
        (z("c.CLAIMS") - z("p.CLAIMS")).cast("long").alias("DELTA_CLAIMS"),
        z("c.OPEN_C").cast("long").alias("CUR_OPEN"), z("p.OPEN_C").cast("long").alias("PREV_OPEN"),
        (z("c.OPEN_C") - z("p.OPEN_C")).cast("long").alias("DELTA_OPEN"),
        zm("c.PAID").alias("CUR_PAID"), zm("p.PAID").alias("PREV_PAID"),
        (zm("c.PAID") - zm("p.PAID")).cast("decimal(38,2)").alias("DELTA_PAID"),
        zm("c.RESERVES").alias("CUR_RESERVES"), zm("p.RESERVES").alias("PREV_RESERVES"),
        (zm("c.RESERVES") - zm("p.RESERVES")).cast("decimal(38,2)").alias("DELTA_RESERVES"),
    )


# -- B-4 ----------------------------------------------------------------------
SCORECARD_METRICS = ["Claims Filed", "Claims Settled", "Total Paid ($)", "Total Reserves ($)",
                     "Avg Claim Cost ($)", "Fraud Flagged"]


def scorecard(ctx) -> DataFrame:
    """Six metrics for the latest month, the month before and the year to
    date (year of the latest month), with variance % vs last month (0 when
    last month is not positive). One scan, aggregated per month first."""
    m = _monthly(ctx)
    lm = F.broadcast(_latest_months(m))
    j = m.crossJoin(lm)
    sel = {"cur": F.col("YEAR_MONTH") == F.col("CM"), "prev": F.col("YEAR_MONTH") == F.col("PM"),
           "ytd": F.col("YEAR") == F.col("CY")}
    aggs = []
    for tag, cond in sel.items():
        for c in ["CLAIMS", "SETTLED", "PAID", "RESERVES", "PAID_N", "FRAUD"]:
            aggs.append(F.sum(F.when(cond, F.col(c))).alias(f"{tag}_{c}"))
    t = j.agg(*aggs)

    def period(tag):
        n = F.coalesce(F.col(f"{tag}_CLAIMS"), F.lit(0))
        return [
            n.cast("decimal(38,0)"),
            F.coalesce(F.col(f"{tag}_SETTLED"), F.lit(0)).cast("decimal(38,0)"),
            F.round(F.col(f"{tag}_PAID"), 0).cast("decimal(38,0)"),
            F.round(F.col(f"{tag}_RESERVES"), 0).cast("decimal(38,0)"),
            round_div(F.col(f"{tag}_PAID"), F.col(f"{tag}_PAID_N"), 0).cast("decimal(38,0)"),
            F.coalesce(F.col(f"{tag}_FRAUD"), F.lit(0)).cast("decimal(38,0)"),
        ]
    cur, prev, ytd = period("cur"), period("prev"), period("ytd")
    rows = []
    for i, name in enumerate(SCORECARD_METRICS):
        var = F.when(prev[i] > 0, round_div((cur[i] - prev[i]) * 100, prev[i], 1)) \
            .otherwise(F.lit(0).cast("decimal(38,1)"))
        rows.append(F.struct(F.lit(i + 1).alias("METRIC_ORDER"), F.lit(name).alias("KEY_METRIC"),
                             cur[i].alias("CURRENT_MONTH"), prev[i].alias("LAST_MONTH"),
                             var.cast("decimal(38,1)").alias("VARIANCE_PCT"), ytd[i].alias("YTD_ACTUAL")))
    return t.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# -- B-5 / B-6 -------------------------------------------------------------------
def monthly_trend(ctx, months: int = 12) -> DataFrame:
    st = F.col("CLAIM_STATUS")
    g = _claims_by_month(ctx).groupBy("YEAR_MONTH").agg(
        F.count(F.lit(1)).alias("CLAIMS"),
        _r0("PAID_AMOUNT").alias("TOTAL_PAID"),
        count_if(st == "Open").alias("OPEN_COUNT"),
        count_if(st == "Closed").alias("CLOSED_COUNT"),
        avg_round("PAID_AMOUNT", 0).alias("AVG_PAID"),
        count_if(F.col("FRAUD_INDICATOR")).alias("FRAUD_COUNT"),
    )
    return (g.orderBy(F.col("YEAR_MONTH").desc()).limit(months)
            .withColumnRenamed("YEAR_MONTH", "MONTH").orderBy("MONTH"))


def open_closed_trend(ctx, months: int = 12) -> DataFrame:
    st = F.col("CLAIM_STATUS")
    g = _claims_by_month(ctx).groupBy("YEAR_MONTH").agg(
        count_if(st == "Open").alias("OPEN_COUNT"), count_if(st == "Closed").alias("CLOSED_COUNT"))
    return (g.orderBy(F.col("YEAR_MONTH").desc()).limit(months)
            .withColumnRenamed("YEAR_MONTH", "MONTH").orderBy("MONTH"))


# -- B-7 ----------------------------------------------------------------------
def quarter_severity(ctx) -> DataFrame:
    s = ctx.star
    d = F.broadcast(s.dim_date().select("DATE_KEY", "YEAR_QUARTER"))
    return (s.fact_claims().join(d, "DATE_KEY").groupBy("YEAR_QUARTER", "CLAIM_SEVERITY")
            .agg(F.count(F.lit(1)).alias("CNT")).withColumnRenamed("YEAR_QUARTER", "QUARTER"))


# -- B-8 ----------------------------------------------------------------------
def waterfall(ctx) -> DataFrame:
    t = ctx.star.fact_claims().agg(
        sum_money("INCURRED_LOSS").alias("IL"), sum_money("RECOVERY_AMOUNT").alias("REC"),
        sum_money("SUBROGATION_AMOUNT").alias("SUB"), sum_money("SALVAGE_AMOUNT").alias("SAL"),
        sum_money("NET_INCURRED").alias("NI"))
    steps = [("Incurred Loss", "IL", 1), ("Recovery", "REC", -1), ("Subrogation", "SUB", -1),
             ("Salvage", "SAL", -1), ("Net Incurred", "NI", 1)]
    rows = [F.struct(F.lit(i + 1).alias("STEP_ORDER"), F.lit(name).alias("STEP"),
                     (F.col(c) * sign).cast("decimal(38,2)").alias("AMOUNT"))
            for i, (name, c, sign) in enumerate(steps)]
    return t.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# -- B-9 ----------------------------------------------------------------------
def status_funnel(ctx) -> DataFrame:
    g = ctx.star.fact_claims().groupBy("CLAIM_STATUS").agg(F.count(F.lit(1)).alias("COUNT"))
    top = F.broadcast(g.agg(F.max("COUNT").alias("_TOP")))
    return g.crossJoin(top).select("CLAIM_STATUS", "COUNT", pct(F.col("COUNT"), F.col("_TOP"), 1)
                                   .alias("PCT_OF_FIRST"))


# -- B-10 ---------------------------------------------------------------------
def severity_share(ctx) -> DataFrame:
    g = ctx.star.fact_claims().groupBy("CLAIM_SEVERITY").agg(
        F.count(F.lit(1)).alias("COUNT"), avg_round("PAID_AMOUNT", 0).alias("AVG_PAID"))
    tot = F.broadcast(g.agg(F.sum("COUNT").alias("_TOTAL")))
    return g.crossJoin(tot).select("CLAIM_SEVERITY", "COUNT", "AVG_PAID",
                                   pct(F.col("COUNT"), F.col("_TOTAL"), 1).alias("PCT"))


# -- B-11 / B-21 -------------------------------------------------------------------
def top_loss_causes(ctx, k: int = 8) -> DataFrame:
    """Top-k causes by claim count (ties broken by cause name): aggregate
    the fact per cause key, then attach the (broadcast) cause names."""
    s = ctx.star
    lc = s.dim_loss_cause().select("LOSS_CAUSE_KEY", "LOSS_CAUSE", "LOSS_CATEGORY")
    g = (s.fact_claims().groupBy("LOSS_CAUSE_KEY")
         .agg(F.count(F.lit(1)).alias("COUNT"), _r0("PAID_AMOUNT").alias("TOTAL_PAID")))
    g = g.join(lc, "LOSS_CAUSE_KEY").select("LOSS_CAUSE", "LOSS_CATEGORY", "COUNT", "TOTAL_PAID")
    return g.orderBy(F.col("COUNT").desc(), F.col("LOSS_CAUSE").asc()).limit(k)


def fraud_top_causes(ctx, k: int = 10) -> DataFrame:
    s = ctx.star
    lc = s.dim_loss_cause().select("LOSS_CAUSE_KEY", "LOSS_CAUSE")
    f = s.fact_claims().where(F.col("FRAUD_INDICATOR")).join(lc, "LOSS_CAUSE_KEY")
    g = f.groupBy("LOSS_CAUSE").agg(F.count(F.lit(1)).alias("FRAUD_COUNT"),
                                    avg_round("FRAUD_SCORE", 1).alias("AVG_SCORE"))
    return g.orderBy(F.col("FRAUD_COUNT").desc(), F.col("LOSS_CAUSE").asc()).limit(k)


# -- B-12 ---------------------------------------------------------------------
def region_severity_pivot(ctx) -> DataFrame:
    s = ctx.star
    g = _rollup_through(s.fact_claims(), "GEOGRAPHY_KEY", s.dim_geography(), ["REGION"], ["CLAIM_SEVERITY"],
                        [F.count(F.lit(1)).alias("_n")], [F.sum("_n").alias("_n")])
    p = g.groupBy("REGION").pivot("CLAIM_SEVERITY", SEVERITIES).agg(F.sum("_n"))
    return p.select("REGION", *[F.coalesce(F.col(v), F.lit(0)).cast("long").alias(v) for v in SEVERITIES])


# -- B-13 ---------------------------------------------------------------------
def claim_type_financials(ctx) -> DataFrame:
    s = ctx.star
    ct = F.broadcast(s.dim_claim_type().select("CLAIM_TYPE_KEY", "CLAIM_TYPE", "CLAIM_CATEGORY"))
    j = s.fact_claims().join(ct, "CLAIM_TYPE_KEY")
    return j.groupBy("CLAIM_TYPE", "CLAIM_CATEGORY").agg(
        F.count(F.lit(1)).alias("CLAIMS"),
        sum_money("PAID_AMOUNT").alias("PAID"),
        sum_money("RESERVE_AMOUNT").alias("RESERVES"),
        _r0("PAID_AMOUNT").alias("TOTAL_PAID"),
        avg_round("PAID_AMOUNT", 0).alias("AVG_PAID"),
    )


# -- B-14 ---------------------------------------------------------------------
def category_rollup(ctx) -> DataFrame:
    """Category -> claim type tree: ROLLUP without the grand total."""
    s = ctx.star
    ct = F.broadcast(s.dim_claim_type().select("CLAIM_TYPE_KEY", "CLAIM_TYPE", "CLAIM_CATEGORY"))
    j = s.fact_claims().join(ct, "CLAIM_TYPE_KEY")
    r = j.rollup("CLAIM_CATEGORY", "CLAIM_TYPE").agg(
        F.grouping_id().alias("_GID"), F.count(F.lit(1)).alias("COUNT"), _r0("PAID_AMOUNT").alias("TOTAL_PAID"))
    return (r.where(F.col("_GID") < 3)
            .select(F.when(F.col("_GID") == 0, "type").otherwise("category").alias("LEVEL"),
                    "CLAIM_CATEGORY", "CLAIM_TYPE", "COUNT", "TOTAL_PAID"))


# -- B-15 ---------------------------------------------------------------------
def region_performance(ctx) -> DataFrame:
    s = ctx.star
    st = F.col("CLAIM_STATUS")
    partials = [F.count(F.lit(1)).alias("_n"), count_if(st == "Closed").alias("_settled"),
                count_if(st == "Open").alias("_open"), F.sum("PAID_AMOUNT").alias("_paid"),
                F.count("PAID_AMOUNT").alias("_paid_n"), F.sum("DAYS_TO_CLOSE").alias("_dtc"),
                F.count("DAYS_TO_CLOSE").alias("_dtc_n"), count_if(F.col("FRAUD_INDICATOR")).alias("_fraud")]
    finals = [F.sum("_n").cast("long").alias("TOTAL_CLAIMS"), F.sum("_settled").cast("long").alias("SETTLED"),
              F.sum("_open").cast("long").alias("OPEN_CLAIMS"),
              F.round(F.sum("_paid"), 0).cast("decimal(38,0)").alias("TOTAL_PAID"),
              round_div(F.sum("_paid"), F.sum("_paid_n"), 0).alias("AVG_PAID"),
              round_div(F.sum("_dtc"), F.sum("_dtc_n"), 1).alias("AVG_CLOSE_DAYS"),
              F.sum("_fraud").cast("long").alias("FRAUD_COUNT")]
    a = _rollup_through(s.fact_claims(), "GEOGRAPHY_KEY", s.dim_geography(), ["REGION"], [], partials, finals)
    return a.select("*", pct(F.col("FRAUD_COUNT"), F.col("TOTAL_CLAIMS"), 1).alias("FRAUD_RATE_PCT"),
                    pct(F.col("SETTLED"), F.col("TOTAL_CLAIMS"), 1).alias("SETTLED_PCT"))


# -- B-16 ---------------------------------------------------------------------
def close_days_by_severity(ctx) -> DataFrame:
    fc = ctx.star.fact_claims().where(F.col("DAYS_TO_CLOSE").isNotNull())
    return fc.groupBy("CLAIM_SEVERITY").agg(
        avg_round("DAYS_TO_CLOSE", 1).alias("AVG_DAYS"),
        F.min("DAYS_TO_CLOSE").cast("int").alias("MIN_DAYS"),
        F.max("DAYS_TO_CLOSE").cast("int").alias("MAX_DAYS"),
        F.count(F.lit(1)).alias("CLOSED_CLAIMS"))


# -- B-17 ---------------------------------------------------------------------
def fraud_kpi(ctx) -> DataFrame:
    fc = ctx.star.fact_claims()
    fr = F.col("FRAUD_INDICATOR")
    a = fc.agg(
        F.count(F.lit(1)).alias("TOTAL_CLAIMS"),
        count_if(fr).alias("FRAUD_FLAGGED"),
        count_if(fr & (F.col("CLAIM_STATUS") == "Open")).alias("FRAUD_OPEN"),
        avg_round(F.when(fr, F.col("FRAUD_SCORE")), 2).alias("AVG_FRAUD_SCORE"),
        F.round(F.coalesce(F.sum(F.when(fr, F.col("PAID_AMOUNT"))), F.lit(0)), 0).cast("decimal(38,0)")
        .alias("FRAUD_PAID"),
    )
    return a.select("*", pct(F.col("FRAUD_FLAGGED"), F.col("TOTAL_CLAIMS"), 2).alias("FRAUD_RATE_PCT"))


# -- B-18 ---------------------------------------------------------------------
def fraud_tiers(ctx) -> DataFrame:
    return ctx.star.fact_claims().groupBy("FRAUD_RISK_TIER").agg(
        F.count(F.lit(1)).alias("CLAIM_COUNT"),
        avg_round("FRAUD_SCORE", 2).alias("AVG_FRAUD_SCORE"),
        _r0("PAID_AMOUNT").alias("TOTAL_PAID"),
        avg_round("PAID_AMOUNT", 2).alias("AVG_PAID"))


# -- B-19 ---------------------------------------------------------------------
def fraud_score_buckets(ctx) -> DataFrame:
    fc = ctx.star.fact_claims()
    return (fc.groupBy(fraud_score_bucket(F.col("FRAUD_SCORE")).alias("SCORE_RANGE"))
            .agg(F.count(F.lit(1)).alias("COUNT")))


# -- B-20 ---------------------------------------------------------------------
def fraud_rate_by_region(ctx) -> DataFrame:
    """Fraud count and rate per region in one group-by (the correlated
    per-region subquery becomes a conditional count); regions without
    fraud are left out, as in the original."""
    s = ctx.star
    a = _rollup_through(s.fact_claims(), "GEOGRAPHY_KEY", s.dim_geography(), ["REGION"], [],
                        [count_if(F.col("FRAUD_INDICATOR")).alias("_f"), F.count(F.lit(1)).alias("_n")],
                        [F.sum("_f").cast("long").alias("FRAUD_COUNT"), F.sum("_n").alias("_ALL")])
    return a.where(F.col("FRAUD_COUNT") > 0).select(
        "REGION", "FRAUD_COUNT", pct(F.col("FRAUD_COUNT"), F.col("_ALL"), 1).alias("FRAUD_RATE"))


# -- B-22 ---------------------------------------------------------------------
def severity_financials(ctx) -> DataFrame:
    return ctx.star.fact_claims().groupBy("CLAIM_SEVERITY").agg(
        avg_round("PAID_AMOUNT", 0).alias("AVG_PAID"), avg_round("RESERVE_AMOUNT", 0).alias("AVG_RESERVE"))


# -- B-23 ---------------------------------------------------------------------
def expense_actual_vs_budget(ctx) -> DataFrame:
    fe = ctx.star.fact_claim_expense()
    budget = (F.col("BUDGETED_LEGAL_FEES") + F.col("BUDGETED_ADJUSTOR_COSTS")
              + F.col("BUDGETED_INVESTIGATION_CHARGES") + F.col("BUDGETED_ULAE"))
    return fe.groupBy("EXPENSE_CATEGORY").agg(
        sum_money("TOTAL_ACTUAL_EXPENSE").alias("ACTUAL"),
        F.coalesce(F.sum(budget), F.lit(0)).cast("long").alias("BUDGETED"))


# -- B-24 ---------------------------------------------------------------------
def paid_by_payment_month(ctx) -> DataFrame:
    """Role-playing date: the date dimension joined on the payment date."""
    s = ctx.star
    d = F.broadcast(s.dim_date().select(F.col("DATE_KEY").alias("PAYMENT_DATE"), "FIRST_DAY_OF_MONTH"))
    j = s.fact_claims().where(F.col("PAYMENT_DATE").isNotNull()).join(d, "PAYMENT_DATE")
    return j.groupBy(F.col("FIRST_DAY_OF_MONTH").alias("MONTH")).agg(sum_money("PAID_AMOUNT").alias("MONTHLY_PAID"))


# -- B-25 ---------------------------------------------------------------------
def weather_kpi(ctx) -> DataFrame:
    fc = ctx.star.fact_claims()
    w = F.col("IS_WEATHER_RELATED")
    a = fc.agg(F.count(F.lit(1)).alias("TOTAL_CLAIMS"), count_if(w).alias("WEATHER_CLAIMS"),
               count_if(F.col("CAT_INDICATOR")).alias("CAT_CLAIMS"),
               F.coalesce(F.sum(F.when(w, F.col("PAID_AMOUNT")).otherwise(0)), F.lit(0)).cast("decimal(38,2)")
               .alias("WEATHER_PAID"))
    return a.select("*", pct(F.col("WEATHER_CLAIMS"), F.col("TOTAL_CLAIMS"), 1).alias("WEATHER_PCT"))


# -- B-26 ---------------------------------------------------------------------
def _weather_claims(ctx, col: str) -> DataFrame:
    s = ctx.star
    we = F.broadcast(s.dim_weather_event().select("WEATHER_EVENT_KEY", col))
    j = s.fact_claims().where(F.col("IS_WEATHER_RELATED")).join(we, "WEATHER_EVENT_KEY")
    return j.groupBy(col).agg(F.count(F.lit(1)).alias("COUNT"), _r0("PAID_AMOUNT").alias("TOTAL_PAID"))


def weather_by_condition(ctx) -> DataFrame:
    return _weather_claims(ctx, "WEATHER_CONDITION")


def weather_by_tier(ctx) -> DataFrame:
    return _weather_claims(ctx, "EVENT_SEVERITY_TIER")


# -- B-27 ---------------------------------------------------------------------
def event_impact(ctx) -> DataFrame:
    """Every catastrophe event with its claim count (0 when none): the fact
    is aggregated per event key first (map-side partial aggregation, so a
    hot event key costs no skew), then left-joined from the dimension."""
    s = ctx.star
    per_event = (s.fact_claims().where(F.col("WEATHER_EVENT_KEY").isNotNull())
                 .groupBy("WEATHER_EVENT_KEY")
                 .agg(F.count("CLAIM_KEY").alias("_N"), F.sum("PAID_AMOUNT").alias("_P")))
    we = s.dim_weather_event()
    j = we.join(per_event, "WEATHER_EVENT_KEY", "left")
    return j.select("EVENT_NAME", "WEATHER_CONDITION", "EVENT_DATE", "EVENT_SEVERITY_TIER",
                    "ESTIMATED_INDUSTRY_LOSS", F.coalesce("_N", F.lit(0)).cast("long").alias("IMPACTED_CLAIMS"),
                    F.round("_P", 0).cast("decimal(38,0)").alias("TOTAL_PAID"))


# -- B-28 ---------------------------------------------------------------------
def severity_changes(ctx, ordering: str = "text") -> DataFrame:
    """Severity changes in the month before as_of, by stage. ordering="text"
    compares severity names alphabetically (the original's behaviour);
    ordering="risk" uses Minor < Moderate < Significant < Severe < Catastrophic."""
    c = ctx.raw.claims()
    since = F.add_months(F.lit(ctx.as_of), -1)
    f = c.where((F.col("SEVERITY_CHANGE_DATE") >= since) & F.col("SEVERITY_CHANGE_STAGE").isNotNull())
    prev, cur = F.col("PREVIOUS_SEVERITY"), F.col("CLAIM_SEVERITY")
    if ordering == "risk":
        prev, cur = severity_rank(prev), severity_rank(cur)
    return f.groupBy(F.col("SEVERITY_CHANGE_STAGE").alias("STAGE")).agg(
        F.count(F.lit(1)).alias("SEVERITY_CHANGES"),
        count_if(prev < cur).alias("ESCALATED"),
        count_if(prev > cur).alias("DE_ESCALATED"))


# -- B-29 ---------------------------------------------------------------------
def approval_by_state(ctx) -> DataFrame:
    c = ctx.raw.claims()
    st = F.col("CLAIM_STATUS")
    a = c.groupBy(F.col("CLAIM_STATE").alias("GEOGRAPHY")).agg(
        F.count(F.lit(1)).alias("TOTAL_CLAIMS"), count_if(st == "Approved").alias("APPROVED_COUNT"),
        count_if(st == "Rejected").alias("REJECTED_COUNT"))
    return a.select("*", pct(F.col("APPROVED_COUNT"), F.col("TOTAL_CLAIMS"), 2).alias("APPROVED_PCT"),
                    pct(F.col("REJECTED_COUNT"), F.col("TOTAL_CLAIMS"), 2).alias("REJECTED_PCT"))


# -- B-30 ---------------------------------------------------------------------
def backlog_by_state(ctx) -> DataFrame:
    c = ctx.raw.claims().where(F.col("CLAIM_STATUS").isin("Open", "Pending Review", "Stalled")
                               & F.col("CLOSE_DATE").isNull())
    age = F.datediff(F.lit(ctx.as_of), F.col("OPEN_DATE"))
    return c.groupBy(F.col("CLAIM_STATE").alias("REGION")).agg(
        F.count(F.lit(1)).alias("BACKLOG_COUNT"), avg_round(age, 0).alias("AVG_AGE_DAYS"))


# -- B-31 ---------------------------------------------------------------------
def stalled_by_stage(ctx) -> DataFrame:
    since = F.add_months(F.lit(ctx.as_of), -3)
    c = ctx.raw.claims().where((F.col("CLAIM_STATUS") == "Stalled") & (F.col("LAST_ACTIVITY_DATE") >= since))
    idle = F.datediff(F.lit(ctx.as_of), F.col("LAST_ACTIVITY_DATE"))
    return c.groupBy(F.col("CLAIM_STAGE").alias("STAGE")).agg(
        F.count(F.lit(1)).alias("STALLED_CLAIMS"), avg_round(idle, 0).alias("AVG_DAYS_STALLED"))


# -- B-32 ---------------------------------------------------------------------
def expense_by_severity(ctx) -> DataFrame:
    fe = ctx.star.fact_claim_expense()
    v = F.col("TOTAL_EXPENSE_VARIANCE")
    return fe.groupBy("CLAIM_SEVERITY").agg(
        F.count(F.lit(1)).alias("CLAIMS"),
        avg_round("TOTAL_ACTUAL_EXPENSE", 2).alias("AVG_ACTUAL"),
        avg_round("TOTAL_EXPENSE_VARIANCE", 2).alias("AVG_VARIANCE"),
        count_if(v > 0).alias("OVER_BUDGET"), count_if(v <= 0).alias("UNDER_BUDGET"))


# -- B-33 ---------------------------------------------------------------------
def weather_split(ctx) -> DataFrame:
    return ctx.star.fact_claims().groupBy("IS_WEATHER_RELATED").agg(
        F.count(F.lit(1)).alias("CLAIMS"),
        avg_round("PAID_AMOUNT", 2).alias("AVG_PAID"),
        avg_round("INCURRED_LOSS", 2).alias("AVG_INCURRED"),
        count_if(F.col("FRAUD_INDICATOR")).alias("FRAUD_COUNT"),
        F.count("WEATHER_EVENT_KEY").alias("CAT_LINKED"))


# -- §2.15: plain group-bys the business asked for ---------------------------------
def stage_backlog(ctx) -> DataFrame:
    """Open work by claim stage: stalled and open counts per stage."""
    st = F.col("CLAIM_STATUS")
    return ctx.star.fact_claims().groupBy("CLAIM_STAGE").agg(
        F.count(F.lit(1)).alias("CLAIMS"), count_if(st == "Stalled").alias("STALLED"),
        count_if(st.isin("Open", "Pending Review", "Stalled")).alias("PENDING"))


def agency_stage(ctx) -> DataFrame:
    """Claims by agency × stage (agency lives in the policy dimension, which
    grows with the customers: the fact is reduced per policy first)."""
    s = ctx.star
    return _rollup_through(s.fact_claims(), "POLICY_KEY", s.dim_policy(), ["AGENCY_NAME"], ["CLAIM_STAGE"],
                           [F.count(F.lit(1)).alias("_n"), count_if(F.col("CLAIM_STATUS") == "Rejected").alias("_r")],
                           [F.sum("_n").cast("long").alias("CLAIMS"), F.sum("_r").cast("long").alias("REJECTED")])


def backlog_by_region(ctx) -> DataFrame:
    s = ctx.star
    f = s.fact_claims().where(F.col("CLAIM_STATUS").isin("Open", "Pending Review", "Stalled")
                              & F.col("CLOSE_DATE").isNull())
    age = F.datediff(F.lit(ctx.as_of), F.col("OPEN_DATE"))
    return _rollup_through(f, "GEOGRAPHY_KEY", s.dim_geography(), ["REGION"], [],
                           [F.count(F.lit(1)).alias("_n"), F.sum(age).alias("_age"), F.count(age).alias("_age_n")],
                           [F.sum("_n").cast("long").alias("BACKLOG_COUNT"),
                            round_div(F.sum("_age"), F.sum("_age_n"), 0).alias("AVG_AGE_DAYS")])


def subrogation_pending(ctx) -> DataFrame:
    """Closed claims with subrogation: count and amounts by region."""
    s = ctx.star
    f = s.fact_claims().where((F.col("CLAIM_STATUS") == "Closed") & F.col("SUBROGATION_INDICATOR"))
    return _rollup_through(f, "GEOGRAPHY_KEY", s.dim_geography(), ["REGION"], [],
                           [F.count(F.lit(1)).alias("_n"), F.sum("SUBROGATION_AMOUNT").alias("_s"),
                            F.sum("RECOVERY_AMOUNT").alias("_r")],
                           [F.sum("_n").cast("long").alias("CLAIMS"),
                            F.coalesce(F.sum("_s"), F.lit(0)).cast("decimal(38,2)").alias("SUBROGATION"),
                            F.coalesce(F.sum("_r"), F.lit(0)).cast("decimal(38,2)").alias("RECOVERY")])



# -- A-2 / P-2 ------------------------------------------------------------------------
def status_counts(ctx) -> DataFrame:
    """Claims per status (plain hash group-by)."""
    return ctx.star.fact_claims().groupBy("CLAIM_STATUS").agg(F.count(F.lit(1)).alias("COUNT"))


def fraud_tier_rules(ctx) -> DataFrame:
    """Claims per fraud tier under both published rules, in one scan: the
    score rule (>=60 High, >=30 Medium, else No Flag) and the indicator rule
    (flagged claims only: >=80 High, >=50 Medium, else Low)."""
    from lossledger.functions.rules import fraud_risk_tier
    fc = ctx.star.fact_claims()
    score, flag = F.col("FRAUD_SCORE"), F.col("FRAUD_INDICATOR")
    pairs = F.explode(F.array(
        F.struct(F.lit("score").alias("RULE"), fraud_risk_tier(score, flag, "score").alias("FRAUD_RISK_TIER")),
        F.struct(F.lit("indicator").alias("RULE"), fraud_risk_tier(score, flag, "indicator").alias("FRAUD_RISK_TIER"))))
    return (fc.select(pairs.alias("p")).select("p.*").groupBy("RULE", "FRAUD_RISK_TIER")
            .agg(F.count(F.lit(1)).alias("CLAIM_COUNT")))
