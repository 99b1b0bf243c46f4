"""Structured Streaming change-feed pipeline.

Change files (table columns + `action` + `seq`) land in a directory; a
streaming query reads them with the file source and, per micro-batch,
`foreachBatch` merges the target rows they make into a `RunTable`:

* every run reads the table as the run before left it and writes the merged
  table (`operators.upsert.placed`) to a new folder of plain parquet; nothing is
  written over, so a reader never sees half a merge, and a run that broke off
  leaves the state before it;
* a replay of a batch merges into the state before that batch again;
* the newest `seq` of a key wins whatever batch it came with, so a retry that
  arrives late cannot undo a newer change; a deleted key keeps its row, marked,
  so an older change that arrives afterwards stays without effect;
* `keep` deletes all but the last runs;
* an empty batch writes nothing and is logged as SKIPPED, mirroring "run only
  when the stream has data".

A run writes the target once and broadcasts the net changes while they are
small; readers scan one folder. With `buckets` every run's folder is dealt by
`place`, the columns by which batches are made and readers join (the key, if
none are given): a batch of any size then leaves the target's rows where they
lie, and only keys and changes are shuffled. Offsets and progress live in the
streaming checkpoint; every batch appends one record to a run log (see
`runlog`).
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.operators.members import complete_folders
from lossledger.operators.upsert import net_changes, placed
from lossledger.shared import forget_table, read, write_dealt, written_dealt
from lossledger.streaming.runlog import RunLog

APPLIED, GONE = "_applied", "_gone"


class RunTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], apply_deletes: bool = False,
                 place: list[str] | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.keys = keys
        self.apply_deletes = apply_deletes
        self.place = place or keys
        self.buckets = buckets

    def _runs(self) -> list[int]:
        """Numbers of the finished runs, in order; 0 is the table that the first batch found."""
        return sorted(int(name.rpartition("-")[2]) for name in complete_folders(self.spark, self.path, "run-*"))

    def _state(self, run: int) -> DataFrame:
        return read(self.spark, f"{self.path}/run-{run}")

    def create(self, df: DataFrame) -> None:
        write_dealt(df.withColumns({APPLIED: F.lit(None).cast("long"), GONE: F.lit(False)}), f"{self.path}/run-0", self.place, self.buckets)

    def merge(self, rows: DataFrame, batch_id: int, is_net: bool = False) -> None:
        """Merge the change rows (target columns + action + seq) of one micro-batch; again for a replay. `is_net`: the
        rows are one per key and written."""
        run = int(batch_id) + 1
        before = max(r for r in self._runs() if r < run)
        if not self.apply_deletes:
            rows = rows.where(F.col("action") == "INSERT")
        if not is_net:
            rows = written_dealt(net_changes(rows, self.keys, apply_deletes=True), "changes", self.place, self.buckets)
        changes = rows.withColumns({APPLIED: F.col("seq"), GONE: F.col("action") == "DELETE"})
        merged = placed(self._state(before), changes, self.keys, self.place, self.buckets, applied_col=APPLIED)
        write_dealt(merged, f"{self.path}/run-{run}", self.place, self.buckets, lies_so=True)

    def read(self) -> DataFrame:
        return self._state(self._runs()[-1]).where(~F.col(GONE)).drop(APPLIED, GONE)

    def keep(self, runs: int = 2) -> None:
        """Delete all but the last `runs` runs (at least one stays)."""
        jvm, jsc = self.spark._jvm, self.spark._jsc
        for run in self._runs()[:-max(1, runs)]:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/run-{run}")
            folder.getFileSystem(jsc.hadoopConfiguration()).delete(folder, True)
            forget_table(self.spark, f"{self.path}/run-{run}")


def merge_batch_fn(table: RunTable, build, log: RunLog, task: str):
    """foreachBatch callback: skip empty batches, build target rows from the
    change rows (`build(batch, batch_id)`, one per key), merge them, and log the outcome."""
    def run(batch: DataFrame, batch_id: int) -> None:
        started = time.time()
        if batch.isEmpty():
            log.record(task, batch_id, "SKIPPED", 0, started, time.time())
            return
        try:
            rows = written_dealt(build(batch, batch_id) if build else batch, "batch-rows", table.place, table.buckets)
            table.merge(rows, batch_id, is_net=build is not None)
            n = rows.count()
            log.record(task, batch_id, "SUCCEEDED", n, started, time.time())
        except Exception as e:  # noqa: BLE001 — logged, then re-raised to fail the query
            log.record(task, batch_id, "FAILED", 0, started, time.time(), str(e)[:500])
            raise
    return run


def run_change_stream(spark: SparkSession, changes_path: str, schema, on_batch, checkpoint: str,
                      max_files_per_trigger: int | None = None):
    """Process every change file present now (availableNow trigger) and stop.
    Returns the finished StreamingQuery (its progress is in `recentProgress`)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    q = (reader.parquet(changes_path).writeStream.foreachBatch(on_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return q
