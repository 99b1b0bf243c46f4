"""Build-once warehouse for a session: raw tables and star schema written
under the shared checkpoint folder, then every query reads the written
tables.

This is the production shape of the pipeline (build step, then reports):
each report's plan starts at a parquet scan of the star instead of
re-deriving the whole lineage from the source tables, which keeps plans
small, cuts lineage (a lost executor recomputes from parquet, not from the
sources) and builds the expensive joins once.

`query_context` writes each table when a query first reads it: a query over
the claims fact does not wait for the expense fact, and one over a given table
writes nothing. A star table takes the raw tables before it as they are
written; one that no query has read stays inside the star table's own plan, so
its rows are not written and shuffled once more. `warehouse_context` writes
every table at once. The raw tables of claims, payments and expense lines of a
large input are dealt by claim (`shared.write_dealt`), so their joins by claim
shuffle none of them. Both share one warehouse per session, input directory and
fingerprint of the files of the tables in use (name, size, modification time),
listed once per session and input; `forget` makes the next query look again.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lossledger.context import Context
from lossledger.plans.star import STAR_TABLES
from lossledger.shared import write_dealt
from lossledger.sources.raw import RawTables


class Store:
    """The tables written so far under one folder."""
    def __init__(self, base: str, buckets: int | None = None):
        self.base = base
        self.buckets = buckets
        self._written: set[str] = set()
        self._lock = threading.RLock()  # a table is built from others of the store

    def has(self, path: str) -> bool:
        return path in self._written

    def ensure(self, path: str, build: Callable[[], DataFrame], by: list[str] | None = None) -> None:
        """Write the table if it is not there, dealt by the columns `by`; a write that broke off is done again by the next reader."""
        with self._lock:
            if path not in self._written:
                write_dealt(build(), path, by, self.buckets if by else None)
                self._written.add(path)


_BUILDS: dict[tuple, Store] = {}
_LISTED: dict[tuple, tuple] = {}
_LOCK = threading.Lock()


#: An input from this size on has its tables dealt by claim; a bucket is made of about so much input at most.
DEALT_FROM, BUCKET = 64 << 20, 32 << 20

#: The input tables that the library reads; no other table's files are looked at.
TABLES = ("nation", "customer", "supplier", "orders", "lineitem", "events")


def _fingerprint(spark: SparkSession, sf_dir: str) -> tuple:
    """Name, size and time of the files of the tables in use, one listing per table."""
    jvm = spark._jvm
    files = []
    for table in TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{table}.parquet")
        for st in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
            files.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
    return tuple(sorted(files))


def buckets_for(spark: SparkSession, size: int) -> int | None:
    """A multiple of the shuffle partitions, so rows that a shuffle dealt by the same columns already lie in their buckets."""
    if size < DEALT_FROM:
        return None
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return partitions * max(1, math.ceil(size / (partitions * BUCKET)))


def query_context(spark: SparkSession, sf_dir: str, **params) -> Context:
    """A Context that reads raw and star tables written (once per session and
    input) from `sf_dir`, each by the first query that reads it."""
    from lossledger.shared import shared_dir
    where = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if where not in _LISTED:  # once per session and input, not once per query
        _LISTED[where] = _fingerprint(spark, sf_dir)
    key = (*where, _LISTED[where], tuple(sorted(params.items())))
    with _LOCK:
        if key not in _BUILDS:
            _BUILDS[key] = Store(shared_dir(spark, "warehouse"), buckets_for(spark, sum(f[1] for f in _LISTED[where])))
    store = _BUILDS[key]
    return Context(spark, sf_dir, raw_dir=f"{store.base}/raw", star_dir=f"{store.base}/star", store=store, **params)


def warehouse_context(spark: SparkSession, sf_dir: str, **params) -> Context:
    """As `query_context`, with every raw and star table written now."""
    ctx = query_context(spark, sf_dir, **params)
    for name in RawTables.RAW_TABLES:
        ctx.raw.by_name(name)
    for name in STAR_TABLES:
        ctx.star.by_name(name)
    return ctx


def forget(spark: SparkSession, sf_dir: str) -> None:
    """List the input's files again on next use: if they changed, the warehouse is rebuilt."""
    _LISTED.pop((spark.sparkContext.applicationId, sf_dir.rstrip("/")), None)
