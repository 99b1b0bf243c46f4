"""The dimensions that change feeds extend: loss causes, addresses and calendar days.

`GrowingDimensions` stores them (`operators.members`); every claim, payment or
expense batch is taken in before its fact rows are built, so each fact row
finds its dimension row, whatever batch brought it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.operators.members import MemberStore
from lossledger.operators.upsert import net_changes, replaced
from lossledger.plans.incremental import _change, claim_fact_rows, described_causes, described_geography
from lossledger.plans.quality import edge_checks
from lossledger.plans.star import date_dimension, date_spine
from lossledger.shared import shared_dir, written

ADDRESS = ["STATE_CODE", "CITY", "ZIP_CODE"]


class GrowingDimensions:
    def __init__(self, ctx, path: str):
        self.ctx, s = ctx, ctx.star
        store = lambda name, dim, natural, key: MemberStore(ctx.spark, f"{path}/{name}", dim.schema, natural, key)
        self.causes = store("DIM_LOSS_CAUSE", s.dim_loss_cause(), ["LOSS_CAUSE"], "LOSS_CAUSE_KEY")
        self.geography = store("DIM_GEOGRAPHY", s.dim_geography(), ADDRESS, "GEOGRAPHY_KEY")
        self.calendar = store("DIM_DATE", s.dim_date(), ["DATE_KEY"], None)

    def create(self) -> GrowingDimensions:
        s = self.ctx.star
        for store, rows in ((self.causes, s.dim_loss_cause()), (self.geography, s.dim_geography()), (self.calendar, s.dim_date())):
            store.create(rows)
        return self

    def take_in_causes(self, claims: DataFrame, batch: str) -> None:
        self.causes.allocate(claims.select("LOSS_CAUSE").where(F.col("LOSS_CAUSE").isNotNull()), batch, lambda new: described_causes(new, self.ctx.spark))

    def take_in_addresses(self, claims: DataFrame, batch: str) -> None:
        cand = claims.where(F.col("CLAIM_STATE").isNotNull()).select(
            F.col("CLAIM_STATE").alias("STATE_CODE"), F.col("CLAIM_CITY").alias("CITY"), F.col("CLAIM_ZIP").alias("ZIP_CODE"))
        self.geography.allocate(cand, batch, lambda new: described_geography(new, self.ctx.spark))

    def take_in_dates(self, dates: DataFrame, batch: str) -> None:
        """Whole years from the calendar's first day to the last one of `dates` (one column), so it never has a gap."""
        ends = self.calendar.members().agg(F.min("DATE_KEY").alias("lo"), F.max("DATE_KEY").alias("hi"))
        both = ends.select(F.explode(F.array("lo", "hi")).alias("d")).unionByName(dates.select(F.col(dates.columns[0]).cast("date").alias("d")))
        self.calendar.allocate(date_spine(both), batch, date_dimension)

    def take_in(self, claims: DataFrame, batch: str) -> None:
        """Everything that these CLAIMS rows refer to."""
        self.take_in_causes(claims, batch)
        self.take_in_addresses(claims, batch)
        self.take_in_dates(claims.select("LOSS_DATE"), batch)


def merge_claims(ctx, dims: GrowingDimensions, feed: DataFrame, batch: str, target: DataFrame, apply_deletes: bool = False) -> DataFrame:
    """FACT_CLAIMS after one batch of CLAIMS changes; new members of dimensions are stored first."""
    changed = written(net_changes(feed, ["CLAIM_ID"], apply_deletes=apply_deletes), "net-claims")  # five steps read it
    dims.take_in(changed, batch)
    rows = claim_fact_rows(ctx, changed, apply_deletes, dims.geography.members(), dims.causes.members(), is_net=True)
    return replaced(target, rows, ["CLAIM_KEY"], apply_deletes=apply_deletes)


# -- two batches with new members, from the data -------------------------------------
def _moved(claims: DataFrame, mark: str, side: str, months: int) -> DataFrame:
    return claims.withColumns({"LOSS_CAUSE": F.concat("LOSS_CAUSE", F.lit(mark)), "CLAIM_CITY": F.concat("CLAIM_CITY", F.lit(side)),
                               "LOSS_DATE": F.add_months("LOSS_DATE", months)})


def new_member_feeds(ctx) -> list[DataFrame]:
    """First batch: stalled claims get new causes, cities and loss dates. Second: pending claims get others, rejected ones those of the first."""
    c = ctx.raw.claims()
    of = lambda status: c.where(F.col("CLAIM_STATUS") == status)
    first = _moved(of("Stalled"), " (reopened)", " NORTH", 120)
    second = _moved(of("Pending Review"), " (review)", " SOUTH", 240).unionByName(_moved(of("Rejected"), " (reopened)", " NORTH", 120))
    return [_change(first, "INSERT", "CLAIM_ID", 1), _change(second, "INSERT", "CLAIM_ID", 2)]


def _dimensions(ctx) -> GrowingDimensions:
    return GrowingDimensions(ctx, shared_dir(ctx.spark, "growing")).create()


def grown_loss_causes(ctx) -> DataFrame:
    """DIM_LOSS_CAUSE after two batches, with the batch that brought each cause."""
    dims = _dimensions(ctx)
    for k, feed in enumerate(new_member_feeds(ctx), 1):
        dims.take_in_causes(feed, str(k))
    return dims.causes.read()


def grown_geography(ctx) -> DataFrame:
    dims = _dimensions(ctx)
    for k, feed in enumerate(new_member_feeds(ctx), 1):
        dims.take_in_addresses(feed, str(k))
    return dims.geography.read()


def grown_calendar(ctx) -> DataFrame:
    """Days per year and batch of DIM_DATE after two batches."""
    dims = _dimensions(ctx)
    for k, feed in enumerate(new_member_feeds(ctx), 1):
        dims.take_in_dates(feed.select("LOSS_DATE"), str(k))
    return dims.calendar.read().groupBy("ALLOCATED_IN", "YEAR").agg(
        F.count(F.lit(1)).alias("DAYS"), F.min("DATE_KEY").alias("FIRST_DAY"), F.max("DATE_KEY").alias("LAST_DAY"))


def two_merges(ctx) -> tuple[DataFrame, GrowingDimensions]:
    dims, fact = _dimensions(ctx), ctx.star.fact_claims()
    for k, feed in enumerate(new_member_feeds(ctx), 1):  # each merge writes its changes, not the whole fact once more
        fact = merge_claims(ctx, dims, feed, str(k), fact)
    return fact, dims


def fact_after_two_merges(ctx) -> DataFrame:
    return two_merges(ctx)[0]


def gaps_after_two_merges(ctx) -> DataFrame:
    """Facts per growing dimension that have a key, none, or one without a dimension row."""
    fact, dims = two_merges(ctx)
    return edge_checks(fact, [("DATE_KEY", dims.calendar.members(), "DATE_KEY"), ("GEOGRAPHY_KEY", dims.geography.members(), "GEOGRAPHY_KEY"),
                              ("LOSS_CAUSE_KEY", dims.causes.members(), "LOSS_CAUSE_KEY")])
