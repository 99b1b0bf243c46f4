"""Shards that each match the mixture of sources: proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source. A row's
place is its fractional rank, (rank + u) / rows of the source, with u in
[0, 1) seeded by the source so that small sources spread as well. Sorted by
place, any stretch holds each source in proportion; equal stretches are the
shards, so their row counts differ by one at most (law `rows`).

Both rankings work without a task that holds a whole source: rows are cut
into slices of the hash (then of the place) that hold a bounded number of
rows, ranked inside each slice, and offset by the small table of slice
counts. Nothing but ids, sizes and hashes is shuffled.

Cases: a null text has size 8 and checksum 0; rows with a null source form a
source; equal texts have no bond and may go to different shards; repeated
rows are rows of their own; fewer rows than shards leave shards empty; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossledger.llm.common import seeded_key, slice_count, written

SHARDS, SEED = 24, 20


def hash_share(key: str, parts: int):
    """Which of `parts` equal ranges a hexadecimal hash falls in."""
    return F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * F.lit(parts), 32)


def shard(df: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("key", seeded_key(seed, "doc_id"))
    n = df.count()
    slices = slice_count(n)
    rows = rows.withColumn("slice", hash_share("key", slices))

    # Rank within the source.
    order = ["key", "doc_id", "text_crc32", "size"]
    counts = rows.groupBy("stratum", "slice").agg(F.count(F.lit(1)).alias("here"))
    by_source = Window.partitionBy("stratum")
    counts = counts.select(
        "stratum", "slice", (F.sum("here").over(by_source.orderBy("slice")) - F.col("here")).alias("before"),
        F.sum("here").over(by_source).alias("of_source"))
    local = F.row_number().over(Window.partitionBy("stratum", "slice").orderBy(*order)) - 1
    u = F.conv(F.substring(seeded_key(seed + 1, "stratum"), 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)
    placed = (rows.withColumn("local", local).join(counts, ["stratum", "slice"])
              .withColumn("place", ((F.col("before") + F.col("local")).cast("double") + u) / F.col("of_source").cast("double"))
              .withColumn("slice", F.least(F.floor(F.col("place") * slices), F.lit(slices - 1)).cast("long"))
              .select("doc_id", "size", "text_crc32", "stratum", "key", "place", "slice"))
    placed = written(placed, "sharding")

    # Position in the order of places.
    starts = placed.groupBy("slice").agg(F.count(F.lit(1)).alias("here"))
    starts = starts.select("slice", (F.sum("here").over(Window.orderBy("slice")) - F.col("here")).alias("before"))  # one row a slice
    local = F.row_number().over(Window.partitionBy("slice").orderBy("place", "stratum", *order)) - 1
    at = placed.withColumn("local", local).join(starts, "slice").withColumn("at", (F.col("before") + F.col("local")).cast("long"))
    shard_no = F.expr(f"(at * {shards}) div {max(n, 1)}")
    return (at.withColumn("shard", shard_no)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                    F.expr(f"at - (shard * {n} + {shards - 1}) div {shards}").cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


SQL = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
raw AS (
  SELECT doc_id, coalesce('=' || source, '') AS stratum, strlen(coalesce(text, '')) + 8 AS size,
    md5('{SEED}|' || coalesce(doc_id::VARCHAR, '~')) AS key,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
  FROM documents),
r AS (
  SELECT doc_id, stratum, size, key,
    xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, step[1 + (xor(c, b) & 255)])), 4294967295) AS text_crc32
  FROM raw, crc),
placed AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id, text_crc32, size) - 1
    + ('0x' || substr(md5('{SEED + 1}|' || stratum), 1, 8))::BIGINT::DOUBLE / 4294967296.0)
    / (count(*) OVER (PARTITION BY stratum))::DOUBLE AS place
  FROM r),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY place, stratum, key, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, ((pos * {SHARDS}) // n)::INTEGER AS shard,
  (pos - ((((pos * {SHARDS}) // n) * n + {SHARDS - 1}) // {SHARDS}))::BIGINT AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered
"""
