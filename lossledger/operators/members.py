"""Dimensions that grow: surrogate keys handed out once, written before any fact uses them.

A `MemberStore` is a plain parquet dataset of dimension rows, partitioned by
the batch that brought them (`ALLOCATED_IN`). The natural key of a member is
looked up among all stored ones (NULL parts of a key match); members that are
missing are numbered after the largest stored key, in natural-key order, and
written as the batch's partition. From then on every later batch finds them.

* A batch that brings nothing new costs one anti join and writes nothing.
* A partition is complete or not there: readers take partitions with a
  `_SUCCESS` file only, and a batch that broke off writes its own again.
* A batch that is replayed finds its partition and hands out no key twice.

One writer at a time, as a micro-batch stream or a scheduled job has it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossledger.operators.keys import sequential_key
from lossledger.shared import written

BATCH = "ALLOCATED_IN"


def complete_folders(spark: SparkSession, path: str, pattern: str = "*") -> list[str]:
    """Names of the folders under `path` whose write was finished, sorted."""
    jvm = spark._jvm
    glob = jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}/_SUCCESS")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []
    return sorted(st.getPath().getParent().getName() for st in found)


def missing_members(existing: DataFrame, candidates: DataFrame, natural: list[str]) -> DataFrame:
    """Distinct natural keys of `candidates` that `existing` lacks."""
    have = existing.select(*[F.col(c).alias(f"_e_{c}") for c in natural])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in natural])
    return candidates.select(*natural).distinct().join(have, same, "left_anti")


class MemberStore:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, natural: list[str], key: str | None = None):
        """`key` is the surrogate key's column; None where the natural key is the key."""
        self.spark, self.path, self.schema, self.natural, self.key = spark, path.rstrip("/"), schema, natural, key

    def create(self, rows: DataFrame) -> MemberStore:
        rows.select(*self.schema.names).write.parquet(f"{self.path}/{BATCH}=build")
        return self

    def read(self) -> DataFrame:
        """All members, with the batch that brought them."""
        folders = [f"{self.path}/{f}" for f in complete_folders(self.spark, self.path, f"{BATCH}=*")]
        schema = T.StructType([*self.schema.fields, T.StructField(BATCH, T.StringType())])
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*folders)

    def members(self) -> DataFrame:
        return self.read().drop(BATCH)

    def allocate(self, candidates: DataFrame, batch: str, describe: Callable[[DataFrame], DataFrame]) -> None:
        """Store what `candidates` (the natural key's columns) bring; `describe` makes dimension rows of keyed members."""
        if f"{BATCH}={batch}" in complete_folders(self.spark, self.path, f"{BATCH}=*"):
            return
        existing = self.members()
        new = written(missing_members(existing, candidates, self.natural), "new-members")
        if new.isEmpty():
            return
        if self.key:
            top = F.broadcast(existing.agg(F.coalesce(F.max(self.key), F.lit(0)).cast("long").alias("_top")))  # one row
            new = (sequential_key(new, self.natural, "_n").crossJoin(top)
                   .select(*self.natural, (F.col("_top") + F.col("_n")).cast(self.schema[self.key].dataType).alias(self.key)))
        describe(new).select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/{BATCH}={batch}")
