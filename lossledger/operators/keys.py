"""Surrogate keys: ROW_NUMBER() OVER (ORDER BY k) without a one-task window.

A window with no PARTITION BY moves every row into a single task. Instead:

1. range-partition the rows on the order columns (partition i holds only keys
   smaller than partition i+1) and sort inside each partition;
2. tag each row with its partition id and its position inside the partition
   (`monotonically_increasing_id` = partition id << 33 | position) and write
   the tagged rows once to the shared folder;
3. count rows per partition of that copy (one small row per partition) and
   turn the counts into start offsets with a running sum over those few rows;
4. key = offset(partition) + position + 1, on the same copy, joined through a
   broadcast of the offsets, whose size is the partition count.

Range bounds are sampled anew in each evaluation, so rows and counts taken
from two evaluations would not fit each other; both come from one written
copy, which also survives a lost executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossledger.shared import written

_POS_BITS = 33


def _order(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_first()


def sequential_key(df: DataFrame, order_cols: list, key_name: str,
                   num_partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = [_order(c) for c in order_cols]
    ranged = df.repartitionByRange(n, *ordered).sortWithinPartitions(*ordered)
    tagged = written(ranged.withColumn("_kp", F.spark_partition_id())
                     .withColumn("_kpos", F.monotonically_increasing_id()), "keys")
    counts = tagged.groupBy("_kp").agg(F.count(F.lit(1)).alias("_kn"))
    before = Window.orderBy("_kp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_kp", F.coalesce(F.sum("_kn").over(before), F.lit(0)).alias("_koff"))
    local = F.col("_kpos") - F.shiftleft(F.col("_kp").cast("long"), _POS_BITS)
    return (tagged.join(F.broadcast(offsets), "_kp")
            .withColumn(key_name, (F.col("_koff") + local + 1).cast("long"))
            .drop("_kp", "_kpos", "_koff"))


def small_sequential_key(df: DataFrame, order_cols: list, key_name: str) -> DataFrame:
    """Plain ROW_NUMBER window for inputs whose row count is bounded by a
    fixed vocabulary (e.g. the loss-cause list); one task is the cheapest
    plan there."""
    w = Window.orderBy(*[_order(c) for c in order_cols])
    return df.withColumn(key_name, F.row_number().over(w).cast("long"))


def extend_keys(existing: DataFrame, candidates: DataFrame, natural: list[str], key: str,
                num_partitions: int | None = None) -> DataFrame:
    """Natural keys in `candidates` that `existing` lacks, numbered after the
    largest existing surrogate key (in natural-key order), as
    (natural..., key). Existing keys never change, so facts built earlier
    stay valid; re-running with the same input adds nothing (idempotent).
    The anti join is NULL-safe, so a NULL part of a natural key matches; when
    it leaves nothing, nothing is numbered.

    The keys are not stored here: where a second batch may follow, use
    `operators.members.MemberStore`, which is built on the same join."""
    from lossledger.operators.members import missing_members
    new = written(missing_members(existing, candidates, natural), "new-members")
    if new.isEmpty():
        return new.withColumn(key, F.lit(None).cast("long"))
    keyed = sequential_key(new, natural, "_n", num_partitions)
    base = F.broadcast(existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("_base")))  # one row
    return keyed.crossJoin(base).select(*natural, (F.col("_base") + F.col("_n")).alias(key))
