"""Group totals kept from a change feed: before images are retracted, after images added.

`totals` stores, per group, the rows and exact sums (counts and decimals).
`images` reduces a feed to one before and one after image per key: the first
DELETE and the last INSERT, for keys that have an INSERT. `applied` adds the
signed sums of both to the stored totals, so a batch costs as much as its own
rows and the number of groups; the table itself is not read again. A group
whose rows all left is dropped. Averages and shares are taken from the totals
when a report is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossledger.shared import written

N = "N"


def totals(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """keys, N (rows) and the sum of each measure (a whole number or decimal; NULL counts as zero)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(N), *[_sum(F.sum(F.coalesce(m, F.lit(0))), name) for name, m in measures.items()])


def _sum(total: Column, name: str) -> Column:
    return total.cast("decimal(38,2)").alias(name)


def images(feed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(before, after): the rows of the feed, without action and seq, that a batch takes out and puts in. The feed
    is grouped once, and the pairs of images are written for both."""
    row = F.struct(*[c for c in feed.columns if c not in ("action", "seq")])
    one = feed.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.min_by(F.when(F.col("action") == "DELETE", row), F.when(F.col("action") == "DELETE", F.col("seq"))).alias("before"),
        F.max_by(F.when(F.col("action") == "INSERT", row), F.when(F.col("action") == "INSERT", F.col("seq"))).alias("after"))
    one = written(one.where(F.col("after").isNotNull()).select("before", "after"), "images")
    return one.where(F.col("before").isNotNull()).select("before.*"), one.select("after.*")


def applied(stored: DataFrame, before: DataFrame, after: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """The stored totals after a batch; `before` and `after` have the columns that keys and measures read."""
    names = [N, *measures]
    gone, new = totals(before, keys, measures), totals(after, keys, measures)
    parts = stored.unionByName(new).unionByName(gone.select(*keys, *[(-F.col(c)).cast(gone.schema[c].dataType).alias(c) for c in names]))
    out = parts.groupBy(*keys).agg(F.sum(N).cast("long").alias(N), *[_sum(F.sum(c), c) for c in measures])
    return out.where(F.col(N) != 0)
