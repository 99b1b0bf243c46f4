"""Run log of pipeline steps and stream batches (task, batch, state, rows,
start, end, error), kept as a parquet table, and the run-history summary
over it (runs per task by state and each task's latest state)."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lossledger.functions.money import count_if

SCHEMA = ("TASK string, BATCH_ID long, STATE string, ROWS long, STARTED_AT timestamp_ntz, "
          "ENDED_AT timestamp_ntz, ERROR string")


class RunLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def record(self, task: str, batch_id: int, state: str, rows: int, started: float, ended: float,
               error: str | None = None) -> None:
        """Append one log record (a single row)."""
        def utc(t):
            return dt.datetime.fromtimestamp(t, dt.timezone.utc).replace(tzinfo=None)
        row = (task, int(batch_id), state, int(rows), utc(started), utc(ended), error)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)


def run_history(log: DataFrame, since: dt.datetime | None = None) -> DataFrame:
    """Per task: total runs, succeeded, skipped, failed, rows, latest state."""
    if since is not None:
        log = log.where(F.col("STARTED_AT") >= F.lit(since))
    return log.groupBy("TASK").agg(
        F.count(F.lit(1)).alias("TOTAL_RUNS"),
        count_if(F.col("STATE") == "SUCCEEDED").alias("SUCCEEDED"),
        count_if(F.col("STATE") == "SKIPPED").alias("SKIPPED"),
        count_if(F.col("STATE") == "FAILED").alias("FAILED"),
        F.coalesce(F.sum("ROWS"), F.lit(0)).cast("long").alias("ROWS"),
        F.max_by("STATE", F.struct("STARTED_AT", "BATCH_ID")).alias("CURRENT_STATE"),
    )


PROGRESS_SCHEMA = ("TASK string, BATCH_ID long, NUM_INPUT_ROWS long, INPUT_ROWS_PER_SECOND double, "
                   "PROCESSED_ROWS_PER_SECOND double, TRIGGER_MS long, RECORDED_AT timestamp_ntz")


def record_progress(spark: SparkSession, path: str, task: str, progress: list) -> None:
    """Append a stream's StreamingQueryProgress entries (one row per
    micro-batch: input rows, rates, trigger duration) to a progress log."""
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = []
    for p in progress or []:
        d = p if isinstance(p, dict) else json.loads(p.json)
        rows.append((task, int(d.get("batchId", -1)), int(d.get("numInputRows", 0)),
                     float(d.get("inputRowsPerSecond") or 0.0), float(d.get("processedRowsPerSecond") or 0.0),
                     int((d.get("durationMs") or {}).get("triggerExecution", 0)), now))
    if rows:
        spark.createDataFrame(rows, PROGRESS_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def recent_runs(log: DataFrame, per_task: int = 10, since: dt.datetime | None = None) -> DataFrame:
    """The latest `per_task` runs of each task (newest first per task). The
    row_number filter is planned as a WindowGroupLimit, so each map task
    forwards at most `per_task` rows per task name."""
    if since is not None:
        log = log.where(F.col("STARTED_AT") >= F.lit(since))
    w = Window.partitionBy("TASK").orderBy(F.col("STARTED_AT").desc(), F.col("BATCH_ID").desc())
    return log.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_task).drop("_rn")
