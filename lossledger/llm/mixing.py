"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight. A source whose share exceeds
`most` times its size is clamped there, and its excess goes to the others by
weight, until none is above: the level of a water-filling, found by one pass
over the sources in order of cap to weight. The mix then takes every document
of a source as often as the target holds the whole source, and for the rest
the documents that come first in a seeded order; the document at the border
gives as many words as are left.

The running totals behind "first in a seeded order" never gather a source in
one task: rows fall into slices of the hash, are summed inside each slice and
offset by the small table of slice sums. One row per source is the only thing
that a single task sees whole.

Cases: a null or blank text has size 0 and is never taken; rows with a null
source form a source, which comes last; a source of size 0 has target 0;
repeated rows are rows of their own; an empty table gives no rows; further
columns are ignored by `plan` and kept by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossledger.llm.common import WORDS, boxed, seeded_key, slice_count, unboxed, written
from lossledger.llm.sharding import hash_share

WEIGHTS, BUDGET, MOST, SEED = (3, 1, 2), 1.5, 2, 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def stratum(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """stratum, source_size, target from one row per source (stratum, source_size); in code point order, null last."""
    by_name = Window.orderBy((F.col("stratum") == "").asc(), "stratum")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    s = (sizes.withColumn("i", F.row_number().over(by_name) - 1).withColumn("weight", weight.cast("long"))
         .withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap").cast("double") / F.col("weight")))
    by_ratio = Window.orderBy("ratio", "i")
    everything = Window.partitionBy()
    level = ((F.lit(budget) * F.sum("source_size").over(everything) - (F.sum("cap").over(by_ratio) - F.col("cap")))
             / (F.sum("weight").over(everything) - F.sum("weight").over(by_ratio) + F.col("weight")))
    s = s.withColumn("level", level)
    # The first source that its level does not lift above its cap: from there on none is clamped.
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("ratio", "i", "level"))
    s = s.withColumn("level", F.min(free).over(everything)["level"])
    return s.select("stratum", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def sized(df: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), stratum(F.col(source_col)).alias("stratum"),
                     word_count(F.col(text_col)).alias("size"))
    return rows.withColumn("key", seeded_key(seed, "doc_id")).withColumn("slice", hash_share("key", slice_count(df.count())))


def plan(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: int = SEED,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken; stratum and key (the seeded order) for `mixed`."""
    rows = written(sized(df, seed, id_col, text_col, source_col), "mixing")
    slices = rows.groupBy("stratum", "slice").agg(F.sum("size").alias("here"))
    goals = targets(slices.groupBy("stratum").agg(F.sum("here").alias("source_size")), weights, budget, most)
    before = slices.select("stratum", "slice", (F.sum("here").over(Window.partitionBy("stratum").orderBy("slice")) - F.col("here")).alias("before"))
    local = Window.partitionBy("stratum", "slice").orderBy("key", "doc_id", "size")
    running = F.sum("size").over(local.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    goal = F.floor(F.col("target") + 0.5).cast("long")
    return (rows.withColumn("running", running).join(before.join(goals, "stratum"), ["stratum", "slice"])
            .withColumn("whole", F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(F.lit(0)))
            .withColumn("extra", goal - F.col("whole") * F.col("source_size"))
            .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("before") - F.col("running"))))
            .select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"),
                    "stratum", "key"))


def mixed(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: int = SEED,
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `df` as often as the mix takes them, all columns kept.

    A copy that the mix takes in part holds its first words, one blank between them.
    """
    taken = plan(df, weights, budget, most, seed, id_col, text_col, source_col).where("size > 0")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("stratum", "size"))  # pairs off rows that repeat an id
    left = boxed(df, id=F.col(id_col).cast("long"), stratum=stratum(F.col(source_col)), size=word_count(F.col(text_col)))
    left = left.where("size > 0").withColumn("nth", nth)
    right = taken.withColumnRenamed("doc_id", "id").withColumn("nth", nth).select(F.col("id").alias("rid"), F.col("nth").alias("rnth"), "taken")
    rows = left.join(right, F.col("id").eqNullSafe(F.col("rid")) & (F.col("nth") == F.col("rnth"))).where("taken > 0")
    rows = rows.withColumn("text", F.col(f"row.{text_col}"))
    copies = F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    start = F.concat_ws(" ", F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORDS), F.lit(0)), F.lit(1), F.col("words")))
    rows = rows.withColumn("copy", copies).withColumn("words", words)
    return unboxed(rows, df.columns, **{text_col: F.when(F.col("words") < F.col("size"), start).otherwise(F.col("text"))})


SQL = f"""
WITH r AS (
  SELECT doc_id, coalesce('=' || source, '') AS stratum, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5('{SEED}|' || coalesce(doc_id::VARCHAR, '~')) AS key
  FROM documents),
s AS (SELECT stratum, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY stratum = '', stratum) - 1 AS i FROM r GROUP BY stratum),
w AS (SELECT *, [3, 1, 2][(i % 3 + 1)::INTEGER]::BIGINT AS weight, source_size * {MOST} AS cap FROM s),
o AS (SELECT *, cap::DOUBLE / weight AS ratio FROM w),
l AS (
  SELECT *, ({BUDGET}::DOUBLE * (sum(source_size) OVER ())::DOUBLE - (sum(cap) OVER (ORDER BY ratio, i ROWS UNBOUNDED PRECEDING) - cap)::DOUBLE)
    / (sum(weight) OVER () - sum(weight) OVER (ORDER BY ratio, i ROWS UNBOUNDED PRECEDING) + weight)::DOUBLE AS level,
    row_number() OVER (ORDER BY ratio, i) AS place
  FROM o),
t AS (
  SELECT stratum, source_size,
    least(cap::DOUBLE, (SELECT arg_min(level, place) FROM l AS x WHERE x.level * x.weight <= x.cap) * weight) AS target
  FROM l),
g AS (
  SELECT *, floor(target + 0.5)::BIGINT AS goal,
    CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole
  FROM t),
c AS (
  SELECT r.*, source_size, target, whole, goal - whole * source_size AS extra,
    (sum(size) OVER (PARTITION BY stratum ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
  FROM r JOIN g USING (stratum))
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, extra - before)))::BIGINT AS taken FROM c
"""
