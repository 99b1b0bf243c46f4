"""The folder that the driver and all executors share, and copies written there.

A table that is joined by the same columns again and again can be written
dealt: as one of Spark's bucketed tables, so that such a join does not shuffle
it. The catalog of the session knows its buckets; where another session reads
the folder, it is plain parquet.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory under the session's spark.checkpoint.dir.

    On a cluster the setting is required: a machine-local default would put
    each executor's files on its own disk. Only a session that runs in one JVM
    (local mode, as in tests) falls back to a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lossledger-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lossledger/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once under the shared folder and read back: one evaluation
    that every later use sees, with file sizes the planner knows."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _table(path: str) -> str:
    return "lossledger_" + hashlib.md5(path.encode()).hexdigest()


def write_dealt(df: DataFrame, path: str, columns: list[str], buckets: int | None, lies_so: bool = False) -> None:
    """Write `df` to `path`, dealt to `buckets` by `columns`; plain where `buckets` is None. Rows that a join or an
    exchange by these columns left where they belong are not moved again, which Spark sees by itself but for a union
    (`lies_so`)."""
    if not buckets:
        df.write.mode("overwrite").parquet(path)
        return
    dealt = df if lies_so else df.repartition(buckets, *columns)
    (dealt.write.mode("overwrite").format("parquet").option("path", path).option("compression", "zstd")
     .bucketBy(buckets, *columns).sortBy(*columns).saveAsTable(_table(path)))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table at `path`, with its buckets if this session dealt it."""
    name = _table(path)
    return spark.table(name) if spark.catalog.tableExists(name) else spark.read.parquet(path)


def forget_table(spark: SparkSession, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")


def written_dealt(df: DataFrame, name: str, columns: list[str], buckets: int | None) -> DataFrame:
    """`written`, dealt by `columns`."""
    if not buckets:
        return written(df, name)
    path = shared_dir(df.sparkSession, name)
    write_dealt(df, path, columns, buckets)
    return read(df.sparkSession, path)
