"""Table profiling operators (the explorer's column statistics).

All of them run as distributed aggregations; nothing pulls a column to the
driver. The original explorer fetched a whole numeric column to draw a
histogram; here the bins are counted by Spark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossledger.functions.money import avg_round, count_if, pct, round_div

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType)
TEXT = (T.StringType, T.VarcharType, T.CharType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def type_class(dt: T.DataType) -> str:
    if isinstance(dt, NUMERIC):
        return "numeric"
    if isinstance(dt, TEXT):
        return "text"
    if isinstance(dt, DATES):
        return "date"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    return "other"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def is_float(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, (T.FloatType, T.DoubleType))


def decimals(df: DataFrame, col: str) -> int:
    """Fractional digits of an exact column."""
    t = df.schema[col].dataType
    return t.scale if isinstance(t, T.DecimalType) else 0


def fits_long(df: DataFrame, col: str) -> bool:
    """Whether every value of an exact column, unscaled, is a 64-bit number."""
    t = df.schema[col].dataType
    return not is_float(df, col) and not (isinstance(t, T.DecimalType) and t.precision > 18)


def numeric_histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram between the column's min and max, plus its mean.

    bin = least(bins-1, floor((x - min) * bins / (max - min))) in the column's
    own arithmetic: exact columns (integers of any size, decimals of any scale)
    divide as decimals without rounding, floating columns as doubles (NaN is
    left out). A constant column puts everything in bin 0. Edges of exact
    columns have two fractional digits, or the column's if it has more. One
    pass for the bounds (a one-row aggregate, broadcast), one grouped pass for
    the counts."""
    if is_float(df, col):
        return _float_histogram(df, col, bins)
    exact = df.schema[col].dataType if isinstance(df.schema[col].dataType, T.DecimalType) else T.DecimalType(20, 0)
    digits = max(2, decimals(df, col))
    vals = df.select(F.col(col).cast(exact).alias("_x")).where(F.col("_x").isNotNull())
    stats = F.broadcast(vals.agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx"), avg_round("_x", 2).alias("MEAN")))
    j = (vals.crossJoin(stats).withColumn("_num", (F.col("_x") - F.col("_mn")) * F.lit(bins))
         .withColumn("_den", F.col("_mx") - F.col("_mn")))
    b = F.when(F.col("_den") == 0, F.lit(0)).otherwise(F.least(F.lit(bins - 1).cast("long"), F.expr("_num div _den")))
    g = j.groupBy(b.cast("int").alias("BIN"), "_mn", "_mx", "MEAN").agg(F.count(F.lit(1)).alias("COUNT"))

    def edge(k):
        # (min * bins + width * k) / bins, the numerator exact
        total = (F.col("_mn") * F.lit(bins) + (F.col("_mx") - F.col("_mn")) * k).cast(f"decimal(36,{digits})")
        return F.round(F.try_divide(total, F.lit(bins).cast("decimal(2,0)")), digits).cast(f"decimal(38,{digits})")
    return g.select("BIN", edge(F.col("BIN")).alias("BIN_LOW"), edge(F.col("BIN") + 1).alias("BIN_HIGH"), "COUNT", "MEAN")


def _float_histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    vals = df.select(F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    stats = F.broadcast(vals.agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx"), F.round(F.avg("_x"), 6).alias("MEAN")))
    width = F.col("_mx") - F.col("_mn")
    b = F.when(width == 0, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("_x") - F.col("_mn")) * bins / width)))
    g = vals.crossJoin(stats).groupBy(b.cast("int").alias("BIN"), "_mn", "_mx", "MEAN").agg(F.count(F.lit(1)).alias("COUNT"))
    edge = lambda k: F.round(F.col("_mn") + width * k / F.lit(bins), 6)
    return g.select("BIN", edge(F.col("BIN")).alias("BIN_LOW"), edge(F.col("BIN") + 1).alias("BIN_HIGH"), "COUNT", "MEAN")


def category_top_n(df: DataFrame, col: str, n: int = 15) -> DataFrame:
    """Most frequent non-NULL values (ties broken by value); the limit is the
    feature (a top-n report)."""
    g = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("VALUE")).agg(F.count(F.lit(1)).alias("COUNT"))
    return g.orderBy(F.col("COUNT").desc(), F.col("VALUE").asc()).limit(n)


def numeric_profile(df: DataFrame, cols: list[str] | None = None, distinct: str = "exact") -> DataFrame:
    """MIN / MAX (6 places) / AVG (2 places) / DISTINCT per numeric column, in
    long form. Values are compared, summed and told apart in their own types;
    only what is shown is rounded. Min, max, sum and count come from one pass.
    Exact distinct counts use the unpivoted (column, value) pairs, grouped
    once: a two-level aggregate with map-side de-duplication. A task holds the
    different pairs of its split, so a pair is two numbers (the column's place
    and the value, unscaled) and text only where 64 bits are too few. Where many
    columns are nearly unique, distinct="approx" counts them by sketches in
    the same pass as the rest, without a shuffle of values."""
    cols = cols or numeric_columns(df)

    def avg(i, c):
        if is_float(df, c):
            return F.round(F.col(f"_s{i}") / F.col(f"_n{i}"), 2).cast("decimal(38,2)")
        return round_div(F.col(f"_s{i}"), F.col(f"_n{i}"), 2)

    def total(c):
        return F.sum(F.col(c).cast("double")) if is_float(df, c) else F.sum(F.col(c).cast(f"decimal(38,{max(2, decimals(df, c))})"))
    wide = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.min(c).cast("decimal(38,6)").alias(f"_mn{i}"), F.max(c).cast("decimal(38,6)").alias(f"_mx{i}"),
        total(c).alias(f"_s{i}"), F.count(c).alias(f"_n{i}"),
        *([F.approx_count_distinct(c).alias(f"_d{i}")] if distinct == "approx" else []))])
    stats = wide.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("_i"), F.lit(c).alias("COLUMN_NAME"), F.col(f"_mn{i}").alias("MIN_VALUE"),
                 F.col(f"_mx{i}").alias("MAX_VALUE"), avg(i, c).alias("AVG_VALUE"),
                 *([F.col(f"_d{i}").alias("DISTINCT_COUNT")] if distinct == "approx" else []))
        for i, c in enumerate(cols)])).alias("r")).select("r.*")
    if distinct == "approx":
        return stats.drop("_i")
    # As text a value keeps all its digits (+ 0.0 makes a negative zero a plain one).
    text = lambda c: (F.col(c) + F.lit(0.0) if is_float(df, c) else F.col(c)).cast("string")
    number = lambda c: (F.col(c) * F.lit(10 ** decimals(df, c)) if decimals(df, c) else F.col(c)).cast("long")
    short = [c for c in cols if fits_long(df, c)]
    counts = [df.select(F.explode(F.array(*[F.struct(F.lit(cols.index(c)).alias("_i"), value(c).alias("V")) for c in some])).alias("p"))
              .groupBy("p._i").agg(F.count_distinct("p.V").alias("DISTINCT_COUNT"))
              for some, value in ((short, number), ([c for c in cols if c not in short], text)) if some]
    return F.broadcast(stats).join(reduce(DataFrame.unionByName, counts), "_i", "left").select(
        "COLUMN_NAME", "MIN_VALUE", "MAX_VALUE", "AVG_VALUE",
        F.coalesce("DISTINCT_COUNT", F.lit(0)).cast("long").alias("DISTINCT_COUNT"))


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NULL count and % of rows per column (every column), one scan; the
    denominator comes from the same scan."""
    cols = cols or df.columns
    a = df.agg(F.count(F.lit(1)).alias("_n"), *[count_if(F.col(c).isNull()).alias(f"_z{i}")
                                                 for i, c in enumerate(cols)])
    rows = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("ORDINAL"), F.lit(c).alias("COLUMN_NAME"),
                                        F.col(f"_z{i}").alias("NULLS")) for i, c in enumerate(cols)]))
    return a.select("_n", rows.alias("r")).select(
        "r.ORDINAL", "r.COLUMN_NAME", "r.NULLS", pct(F.col("r.NULLS"), F.col("_n"), 1).alias("NULL_PCT"))


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table: row count (a distributed count) and column counts by type
    class (from the schema); a last row TOTAL sums them."""
    parts = []
    for name, df in tables.items():
        classes = [type_class(f.dataType) for f in df.schema.fields]
        parts.append(df.agg(F.count(F.lit(1)).alias("ROW_COUNT")).select(
            F.lit(name).alias("TABLE_NAME"), "ROW_COUNT",
            F.lit(len(classes)).cast("long").alias("COLUMN_COUNT"),
            *[F.lit(classes.count(k)).cast("long").alias(f"{k.upper()}_COLUMNS") for k in ("numeric", "text", "date", "boolean")]))
    out = reduce(DataFrame.unionByName, parts)
    counts = [c for c in out.columns if c != "TABLE_NAME"]
    return out.unionByName(out.agg(*[F.sum(c).cast("long").alias(c) for c in counts]).select(F.lit("TOTAL").alias("TABLE_NAME"), *counts))


def column_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Per column of each table: position, type class, rows and non-NULL values; one scan per table."""
    parts = []
    for name, df in tables.items():
        a = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_c{i}") for i, c in enumerate(df.columns)])
        rows = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("ORDINAL"), F.lit(f.name).alias("COLUMN_NAME"),
                                            F.lit(type_class(f.dataType)).alias("TYPE_CLASS"), F.col("_n").alias("ROW_COUNT"),
                                            F.col(f"_c{i}").alias("VALUE_COUNT")) for i, f in enumerate(df.schema.fields)]))
        parts.append(a.select(F.lit(name).alias("TABLE_NAME"), rows.alias("r")).select("TABLE_NAME", "r.*"))
    return reduce(DataFrame.unionByName, parts)
