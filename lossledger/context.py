"""Context: where the input tables are and the fixed parameters of a run.

Every operator reads through a Context, so one object pins the input
location, the `as_of` date that replaces "today" in every relative-date rule,
and the build options of the star schema. Derived tables are memoised per
context, so one report plan reuses one DataFrame lineage (Spark then reuses
the shared exchanges inside that plan).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from lossledger.shared import read

DEFAULT_AS_OF = dt.date(2001, 8, 1)


@dataclass
class Context:
    spark: SparkSession
    sf_dir: str
    as_of: dt.date = DEFAULT_AS_OF
    fraud_rule: str = "score"
    catastrophic_loss: int = 25_000_000_000
    raw_dir: str | None = None    # read materialised raw tables from here when given
    star_dir: str | None = None   # read star tables from here when given
    tables: Callable | None = None  # raw tables from a Context, instead of those mapped from sf_dir
    store: object | None = None   # writes a table of raw_dir or star_dir when it is first read (`warehouse.Store`)
    fused: bool = False           # with a store: raw tables not written yet are derived inside the reader's plan
    _cache: dict = field(default_factory=dict, repr=False)

    def table(self, name: str) -> DataFrame:
        """A driver table; column pruning and filters reach the parquet scan."""
        key = ("table", name)
        if key not in self._cache:
            self._cache[key] = self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")
        return self._cache[key]

    @property
    def buckets(self) -> int | None:
        """To how many buckets large tables are dealt by claim; None where they are not."""
        return self.store.buckets if self.store is not None else None

    def stored(self, path: str, build: Callable[[], DataFrame], by: list[str] | None = None) -> DataFrame:
        """The table at `path`; with a store, written from `build` if nobody read it before, dealt by `by`."""
        if self.store is not None:
            self.store.ensure(path, build, by)
        return read(self.spark, path)

    def memo(self, key, build):
        if key not in self._cache:
            self._cache[key] = build()
        return self._cache[key]

    # `raw` / `star` are cheap views created on access (their state lives in
    # `_cache`); not caching them on the context avoids a reference cycle,
    # so a finished query's DataFrames — and the JVM plans and broadcast
    # relations behind them — are released as soon as the context is dropped.
    @property
    def raw(self):
        if self.tables:
            return self.tables(self)
        from lossledger.sources.raw import RawTables
        return RawTables(self)

    @property
    def star_sources(self):
        """The raw tables that the star is built from. With a store a step between (payments per order, expense
        lines) that no query has asked for stays inside the plan of the star table that needs it."""
        return self.raw if self.store is None else replace(self, fused=True, _cache={}).raw

    @property
    def star(self):
        from lossledger.plans.star import StarSchema
        return StarSchema(self)
