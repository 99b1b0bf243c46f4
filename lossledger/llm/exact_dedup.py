"""Exact deduplication by a 128-bit hash of the content, with the bytes compared.

Texts are compared after each run of ASCII white space is replaced by one
space. Rows are grouped by hash and bytes together, so that two texts under
one hash stay two groups; of each group only the smallest id and the count
travel on, summed on the map side, so a text that a third of all rows share
costs each task one row. Rows then find their group by hash alone; only
hashes that hold several texts, if there are any, compare texts again.

Cases: a null text counts as empty; a null id is larger than any other; of
rows that repeat id and text exactly one is kept; ties cannot occur
otherwise; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossledger.llm.common import BLANKS, boxed, id_and_text, unboxed, written


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, " ")


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256."""
    norm = id_and_text(df, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    norm = norm.withColumn("hash", content_hash(F.col("norm").cast("binary")))
    same = [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    found = written(norm.groupBy("hash", "norm").agg(*same).select("hash", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "exact")
    rows = norm.select("doc_id", "hash")
    clash = found.groupBy("hash").count().where("count > 1").select("hash")
    if clash.isEmpty():
        rows = rows.join(found, "hash").drop("hash")
    else:
        texts = norm.join(clash, "hash", "left_semi")
        texts = texts.join(texts.groupBy("hash", "norm").agg(*same), ["hash", "norm"])
        rows = (rows.join(found.join(clash, "hash", "left_anti"), "hash").drop("hash")
                .unionByName(texts.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")))
    # Rows that repeat id and text: one of them is kept.
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy("group_size"))
    return rows.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                       (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (nth == 1)).alias("kept"), "text_sha256")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that stay, all columns kept: one of each text.

    Of rows that repeat the smallest id as well the one whose columns have the smallest hash.
    """
    held = groups(df, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stay = written(held.groupBy("doc_id", "text_sha256").agg((F.count(F.lit(1)) > 1).alias("repeats")), "exact-kept")
    rows = boxed(df, id=F.col(id_col).cast("long"), sha=F.sha2(normalised(F.coalesce(F.col(text_col), F.lit(""))), 256))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("text_sha256"))
    out = rows.join(stay.where(~F.col("repeats")), same, "left_semi").select("row")
    repeats = stay.where("repeats")
    if not repeats.isEmpty():
        # Combined on the map side: rows that repeat id and text cost each task one row.
        twins = rows.join(repeats, same, "left_semi").groupBy("id", "sha").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        out = out.unionByName(twins.select("row"))
    return unboxed(out, df.columns)


SQL = """
WITH r AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM r
"""
