"""Reports kept from the claims feed, and the profit and loss over the calendar."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossledger.functions.money import pct, round_div
from lossledger.operators.deltas import applied, images, totals
from lossledger.plans.incremental import claim_change_feed, extended_dimensions
from lossledger.plans.star import build_fact_claims, date_spine
from lossledger.shared import written

GROUP = ["CLAIM_STATUS", "GEOGRAPHY_KEY"]


def _measures():
    return {"PAID": F.col("PAID_AMOUNT"), "DAYS": F.col("DAYS_TO_CLOSE"), "CLOSED_N": F.when(F.col("DAYS_TO_CLOSE").isNotNull(), 1).otherwise(0),
            "FRAUD": F.when(F.col("FRAUD_INDICATOR"), 1).otherwise(0)}


def claim_drops(ctx) -> list[DataFrame]:
    """The claims feed in two drops: first changes, then second changes of the same keys."""
    feed, step = claim_change_feed(ctx), F.col("seq") % 10
    return [feed.where(step <= 1), feed.where(step >= 2)]


def totals_from_feed(ctx, drops: list[DataFrame]) -> DataFrame:
    """The totals of the fact as built, then brought forward drop by drop. Both images become fact rows by the same build."""
    stored = written(totals(ctx.star.fact_claims(), GROUP, _measures()), "totals")
    for feed in drops:
        before, after = images(feed, ["CLAIM_ID"])
        dims = extended_dimensions(ctx, after)
        fact = lambda claims: build_fact_claims(claims, ctx.raw.financial_data(), ctx.raw.litigation(with_id=False), *dims, ctx.fraud_rule)  # noqa: B023, E731
        stored = written(applied(stored, fact(before), fact(after), GROUP, _measures()), "totals")
    return stored


def status_counts_from(stored: DataFrame) -> DataFrame:
    return stored.groupBy("CLAIM_STATUS").agg(F.sum("N").alias("COUNT"))


def region_performance_from(ctx, stored: DataFrame) -> DataFrame:
    st, n = F.col("CLAIM_STATUS"), F.col("N")
    of = lambda cond: F.sum(F.when(cond, n).otherwise(0)).cast("long")
    a = stored.join(ctx.star.dim_geography().select("GEOGRAPHY_KEY", "REGION"), "GEOGRAPHY_KEY").groupBy("REGION").agg(
        F.sum(n).cast("long").alias("TOTAL_CLAIMS"), of(st == "Closed").alias("SETTLED"), of(st == "Open").alias("OPEN_CLAIMS"),
        F.round(F.sum("PAID"), 0).cast("decimal(38,0)").alias("TOTAL_PAID"), round_div(F.sum("PAID"), F.sum(n), 0).alias("AVG_PAID"),
        round_div(F.sum("DAYS"), F.sum("CLOSED_N"), 1).alias("AVG_CLOSE_DAYS"), F.sum("FRAUD").cast("long").alias("FRAUD_COUNT"))
    return a.select("*", pct(F.col("FRAUD_COUNT"), F.col("TOTAL_CLAIMS"), 1).alias("FRAUD_RATE_PCT"), pct(F.col("SETTLED"), F.col("TOTAL_CLAIMS"), 1).alias("SETTLED_PCT"))


def status_counts_from_feed(ctx) -> DataFrame:
    return status_counts_from(totals_from_feed(ctx, claim_drops(ctx)))


def region_performance_from_feed(ctx) -> DataFrame:
    return region_performance_from(ctx, totals_from_feed(ctx, claim_drops(ctx)))


# -- profit and loss -----------------------------------------------------------------------
def earned_by_day(policies: DataFrame) -> DataFrame:
    """DAY, CENTS: every policy's premium spread over its days (the expiration day is not one) without losing a cent.

    All days weigh the same, so by largest remainders each gets the whole part
    of premium / days and the first ones a cent more until the premium is
    spent. Four changes of the daily amount say so for a policy of any length;
    they are summed per day, map-side, and added up along the calendar, whose
    length is the span of the policies and not their number.
    """
    eff, exp = F.col("POLICY_EFFECTIVE_DATE"), F.col("POLICY_EXPIRATION_DATE")
    days = F.datediff(exp, eff).cast("long")
    p = policies.where(days > 0).select(eff.alias("a"), exp.alias("z"), F.expr("CAST(PREMIUM * 100 AS BIGINT)").alias("c"), days.alias("d"))
    base, more = F.expr("c div d"), F.expr("CAST(c % d AS INT)")
    change = lambda day, by: F.struct(day.alias("DAY"), by.alias("by"))
    changes = p.select(F.explode(F.array(change(F.col("a"), base), change(F.col("z"), -base), change(F.col("a"), F.lit(1).cast("long")),
                                         change(F.date_add("a", more), F.lit(-1).cast("long")))).alias("x")).groupBy("x.DAY").agg(F.sum("x.by").alias("by"))
    spine = date_spine(changes.select("DAY")).withColumnRenamed("DATE_KEY", "DAY")
    along = Window.orderBy("DAY").rowsBetween(Window.unboundedPreceding, 0)  # one row per calendar day
    return spine.join(changes, "DAY", "left").select("DAY", F.sum(F.coalesce("by", F.lit(0))).over(along).alias("CENTS"))


def profit_and_loss(ctx) -> DataFrame:
    """LEVEL (DAY, MONTH, QUARTER), PERIOD, earned premium, paid losses by payment date, expenses by expense date, and the result."""
    s = ctx.star
    money = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(38,2)")
    none = F.lit(0).cast("decimal(38,2)")

    def part(df, day, **amounts):
        return df.select(F.col(day).alias("DAY"), *[amounts.get(c, none).alias(c) for c in ("EARNED", "PAID", "EXPENSE")]).where(F.col("DAY").isNotNull())
    earned = earned_by_day(s.dim_policy())
    paid = s.fact_claims().groupBy("PAYMENT_DATE").agg(F.sum("PAID_AMOUNT").alias("m"))
    spent = s.fact_claim_expense().groupBy("EXPENSE_DATE").agg(F.sum("TOTAL_ACTUAL_EXPENSE").alias("m"))
    daily = reduce(DataFrame.unionByName, [
        part(earned, "DAY", EARNED=(F.col("CENTS").cast("decimal(36,0)") / F.lit(100)).cast("decimal(38,2)")),
        part(paid, "PAYMENT_DATE", PAID=money(F.col("m"))), part(spent, "EXPENSE_DATE", EXPENSE=money(F.col("m")))])
    periods = daily.select(F.date_format("DAY", "yyyy-MM-dd").alias("D"), F.date_format("DAY", "yyyy-MM").alias("M"),
                           F.concat(F.year("DAY").cast("string"), F.lit("-Q"), F.quarter("DAY").cast("string")).alias("Q"), "EARNED", "PAID", "EXPENSE")
    sets = periods.groupingSets([["D"], ["M"], ["Q"]], "D", "M", "Q").agg(
        F.grouping_id().alias("_g"), *[F.sum(c).cast("decimal(38,2)").alias(c) for c in ("EARNED", "PAID", "EXPENSE")])
    level = F.when(F.col("_g") == 3, "DAY").when(F.col("_g") == 5, "MONTH").otherwise("QUARTER")
    return sets.where((F.col("EARNED") != 0) | (F.col("PAID") != 0) | (F.col("EXPENSE") != 0)).select(
        level.alias("LEVEL"), F.coalesce("D", "M", "Q").alias("PERIOD"), F.col("EARNED").alias("EARNED_PREMIUM"), F.col("PAID").alias("PAID_LOSSES"),
        F.col("EXPENSE").alias("EXPENSES"), (F.col("EARNED") - F.col("PAID") - F.col("EXPENSE")).cast("decimal(38,2)").alias("RESULT"))
