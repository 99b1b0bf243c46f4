"""Helpers that the corpus operators share: input columns, code shipping, written stages."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word and normalisation rules, as Java regular expressions.
BLANKS = "[\\x20\\x09-\\x0D]+"
WORDS = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, renamed, a null text as the empty text.

    Selecting first keeps any further column of the input, whatever its name,
    from clashing with the operator's own columns.
    """
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def boxed(df: DataFrame, **columns) -> DataFrame:
    """`row`, all columns of `df` as one struct, and the given columns: no name of the input can clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(name) for name, c in columns.items()])


def unboxed(rows: DataFrame, columns: list[str], **changed) -> DataFrame:
    """The columns of the struct `row` again, those named in `changed` replaced."""
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def ship_code(spark: SparkSession) -> None:
    """Hand this library to the executors, once per application, as Spark distributes Python files."""
    sc = spark.sparkContext
    if getattr(sc, "_lossledger_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="lossledger-code-")
    target = os.path.join(folder, "lossledger_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
        pipeline = top.parent / "corpus_pipeline.py"
        if pipeline.exists():
            z.write(pipeline, pipeline.name)
    sc.addPyFile(target)
    sc._lossledger_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A session without `spark.checkpoint.dir` gets a temporary folder only when
    everything runs in one JVM (tests); on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark.sparkContext, "_lossledger_tmp", None) or "file://" + tempfile.mkdtemp(prefix="lossledger-")
        spark.sparkContext._lossledger_tmp = base
    return base.rstrip("/") + "/lossledger-llm"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and return the rows as read from there.

    It cuts the lineage: what follows reads files that outlive any executor,
    and values that depend on the layout of a shuffle are fixed by the write.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lossledger_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files behind frames of `written` that no later step reads."""
    for df in frames:
        if path := getattr(df, "_lossledger_path", None):
            jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def portions(batches: Iterator[pa.RecordBatch], *columns: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about `most` bytes in the given columns (text or binary), at least one row each.

    What Python makes of a slice, and what a task hands back at once, then follows its bytes and not the rows of a batch.
    """
    for batch in batches:
        lengths = [pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False) for c in columns]
        ends = np.cumsum(np.sum(lengths, 0, dtype=np.int64))
        first = 0
        while first < batch.num_rows:
            upto = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
            yield batch.slice(first, upto - first)
            first = upto


def trimmed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`rows`, after which (or a failure) the worker's unused memory goes back to the system.

    A worker waits for its next task with all the pages it has touched, while the executor's other work needs them.
    """
    try:
        yield from rows
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)


def seeded_key(seed: int, *cols: str):
    """A column that orders rows pseudo-randomly and alike in every engine: MD5 of the seed and the columns."""
    parts = [F.lit(str(seed))]
    for c in cols:
        parts += [F.lit("|"), F.coalesce(F.col(c).cast("string"), F.lit("~"))]
    return F.md5(F.concat(*parts))


def slice_count(rows: int) -> int:
    """Into how many slices running totals cut the rows: some 200 rows each, so that a source with a third of
    all rows spreads over all tasks; 100,000 slices at most."""
    return int(min(100_000, max(64, rows // 200)))
