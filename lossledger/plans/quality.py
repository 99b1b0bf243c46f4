"""Data-quality checks, build validation and the explorer's profiles.

Key checks run as joins/aggregates on the cluster: a foreign key is checked
with a left-anti join of the child keys against the parent keys (one shuffle
per edge, or a broadcast when AQE measures the parent as small); primary-key
uniqueness with a group-by on the key.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.functions.money import count_if, sum_money
from lossledger.operators import profile as P
from lossledger.plans.star import STAR_TABLES
from lossledger.sources.reference import REQUIRED_SOURCE_TABLES

# FIXED VALUES — star-schema foreign keys (fact column -> dimension table.column)
STAR_EDGES = {
    "FACT_CLAIMS": [
        ("DATE_KEY", "DIM_DATE", "DATE_KEY"),
        ("GEOGRAPHY_KEY", "DIM_GEOGRAPHY", "GEOGRAPHY_KEY"),
        ("CLAIM_TYPE_KEY", "DIM_CLAIM_TYPE", "CLAIM_TYPE_KEY"),
        ("LOSS_CAUSE_KEY", "DIM_LOSS_CAUSE", "LOSS_CAUSE_KEY"),
        ("WEATHER_EVENT_KEY", "DIM_WEATHER_EVENT", "WEATHER_EVENT_KEY"),
        ("POLICY_KEY", "DIM_POLICY", "POLICY_KEY"),
    ],
    "FACT_CLAIM_EXPENSE": [
        ("CLAIM_KEY", "FACT_CLAIMS", "CLAIM_KEY"),
        ("DATE_KEY", "DIM_DATE", "DATE_KEY"),
        ("GEOGRAPHY_KEY", "DIM_GEOGRAPHY", "GEOGRAPHY_KEY"),
        ("CLAIM_TYPE_KEY", "DIM_CLAIM_TYPE", "CLAIM_TYPE_KEY"),
        ("LOSS_CAUSE_KEY", "DIM_LOSS_CAUSE", "LOSS_CAUSE_KEY"),
        ("WEATHER_EVENT_KEY", "DIM_WEATHER_EVENT", "WEATHER_EVENT_KEY"),
        ("POLICY_KEY", "DIM_POLICY", "POLICY_KEY"),
    ],
}

# FIXED VALUES — declared foreign keys of the raw tables
RAW_EDGES = [
    ("POLICY", "INSURED_ID", "INSURED", "INSURED_ID"),
    ("POLICY", "LOB_ID", "LINE_OF_BUSINESS", "LOB_ID"),
    ("CLAIMS", "POLICY_ID", "POLICY", "POLICY_ID"),
    ("CLAIMS", "INSURED_ID", "INSURED", "INSURED_ID"),
    ("CLAIMS", "LOB_ID", "LINE_OF_BUSINESS", "LOB_ID"),
    ("CLAIMS", "VENDOR_ID", "VENDOR", "VENDOR_ID"),
    ("CLAIMS", "CATASTROPHE_ID", "CATASTROPHE", "CATASTROPHE_ID"),
    ("CLAIM_ASSIGNMENT", "CLAIM_ID", "CLAIMS", "CLAIM_ID"),
    ("FINANCIAL_DATA", "CLAIM_ID", "CLAIMS", "CLAIM_ID"),
    ("CLAIMS_EXPENSE", "CLAIM_ID", "CLAIMS", "CLAIM_ID"),
    ("LITIGATION", "CLAIM_ID", "CLAIMS", "CLAIM_ID"),
]

# FIXED VALUES — declared primary keys of the raw tables
RAW_KEYS = [("LINE_OF_BUSINESS", "LOB_ID"), ("INSURED", "INSURED_ID"), ("VENDOR", "VENDOR_ID"),
            ("CATASTROPHE", "CATASTROPHE_ID"), ("POLICY", "POLICY_ID"), ("CLAIMS", "CLAIM_ID"),
            ("CLAIM_ASSIGNMENT", "ASSIGNMENT_ID"), ("FINANCIAL_DATA", "FINANCIAL_ID"),
            ("CLAIMS_EXPENSE", "EXPENSE_ID"), ("LITIGATION", "LITIGATION_ID")]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edge_check(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """One row: non-NULL child keys, NULL child keys, and child rows whose key
    has no parent."""
    return edge_checks(child, [(fk, parent, pk)]).drop("FK")


def edge_checks(child: DataFrame, edges: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Per foreign key (fk, parent, pk) of one child table a row FK, CHILD_KEYS,
    NULL_KEYS, ORPHAN_ROWS, from one scan of the child.

    Each row gives one (edge, key) pair per foreign key; pairs are counted
    map-side first, so a hot key is summed before the shuffle, and only
    distinct pairs meet the parents' keys (each parent scanned once). One
    aggregation over that join gives all three counts."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("_e"), F.col(fk).cast("string").alias("_k"))
                                for i, (fk, _, _) in enumerate(edges)]))
    per_key = child.select(pairs.alias("p")).groupBy("p._e", "p._k").agg(F.count(F.lit(1)).alias("_n"))
    parents = _union([parent.select(F.lit(i).alias("_e"), F.col(pk).cast("string").alias("_k")).where(F.col("_k").isNotNull())
                      for i, (_, parent, pk) in enumerate(edges)]).distinct().withColumn("_p", F.lit(True))
    j = per_key.join(parents, ["_e", "_k"], "left")
    k, n = F.col("_k"), F.col("_n")

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")
    counts = j.groupBy("_e").agg(total(k.isNotNull()).alias("CHILD_KEYS"), total(k.isNull()).alias("NULL_KEYS"),
                                 total(k.isNotNull() & F.col("_p").isNull()).alias("ORPHAN_ROWS"))
    # An empty child has no pair: its edges still give a row of zeros.
    names = child.sparkSession.createDataFrame([(i, fk) for i, (fk, _, _) in enumerate(edges)], "_e int, FK string")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("CHILD_KEYS", "NULL_KEYS", "ORPHAN_ROWS")]
    return names.join(counts, "_e", "left").select("FK", *zero)


def orphan_keys(ctx) -> DataFrame:
    """Declared foreign keys of the raw tables, checked on the data; each child table is scanned once."""
    r = ctx.raw
    parts = []
    for child in dict.fromkeys(e[0] for e in RAW_EDGES):
        edges = [e for e in RAW_EDGES if e[0] == child]
        parts.append(edge_checks(r.by_name(child), [(fk, r.by_name(p).select(pk), pk) for _, fk, p, pk in edges])
                     .withColumn("CHILD_TABLE", F.lit(child)))
    named = F.broadcast(ctx.spark.createDataFrame(RAW_EDGES, "CHILD_TABLE string, CHILD_COLUMN string, PARENT_TABLE string, PARENT_COLUMN string"))
    return _union(parts).withColumnRenamed("FK", "CHILD_COLUMN").join(named, ["CHILD_TABLE", "CHILD_COLUMN"]).select(
        "CHILD_TABLE", "CHILD_COLUMN", "PARENT_TABLE", "PARENT_COLUMN", "CHILD_KEYS", "NULL_KEYS", "ORPHAN_ROWS")


def primary_key_check(ctx) -> DataFrame:
    """Rows, distinct keys and duplicated key values per raw table. Each table is read once and for its key alone:
    one that no query has written stays inside the plan, its other columns underived."""
    parts, raw = [], ctx.star_sources
    for table, key in RAW_KEYS:
        df = raw.by_name(table).select(F.col(key).alias("_k"))
        per_key = df.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
        parts.append(per_key.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("ROWS"),
            F.count("_k").alias("DISTINCT_KEYS"),
            count_if(F.col("_n") > 1).alias("DUPLICATE_KEYS"),
            count_if(F.col("_k").isNull()).alias("NULL_KEY_GROUPS"),
        ).select(F.lit(table).alias("TABLE_NAME"), F.lit(key).alias("KEY_COLUMN"), "ROWS", "DISTINCT_KEYS",
                 "DUPLICATE_KEYS", "NULL_KEY_GROUPS"))
    return _union(parts)


def relationship_map(ctx) -> DataFrame:
    """Every star-schema foreign key with matched / unmatched / NULL rows; each fact is scanned once as a child."""
    s = ctx.star
    parts = [edge_checks(s.by_name(fact), [(fk, s.by_name(dim).select(pk), pk) for fk, dim, pk in edges]).withColumn("FACT_TABLE", F.lit(fact))
             for fact, edges in STAR_EDGES.items()]
    named = F.broadcast(ctx.spark.createDataFrame([(f, *e) for f, edges in STAR_EDGES.items() for e in edges],
                                                  "FACT_TABLE string, FK_COLUMN string, DIM_TABLE string, DIM_COLUMN string"))
    return _union(parts).withColumnRenamed("FK", "FK_COLUMN").join(named, ["FACT_TABLE", "FK_COLUMN"]).select(
        "FACT_TABLE", "FK_COLUMN", "DIM_TABLE", "DIM_COLUMN", (F.col("CHILD_KEYS") - F.col("ORPHAN_ROWS")).alias("MATCHED_ROWS"),
        F.col("ORPHAN_ROWS").alias("UNMATCHED_ROWS"), "NULL_KEYS")


def fk_coverage(ctx) -> DataFrame:
    """Star coverage check: non-NULL count per fact foreign key, unique claims,
    fraud and weather flags."""
    fc = ctx.star.fact_claims()
    return fc.agg(
        F.count(F.lit(1)).alias("TOTAL_CLAIMS"), F.count_distinct("CLAIM_KEY").alias("UNIQUE_CLAIMS"),
        F.count("DATE_KEY").alias("HAS_DATE"), F.count("GEOGRAPHY_KEY").alias("HAS_GEOGRAPHY"),
        F.count("CLAIM_TYPE_KEY").alias("HAS_CLAIM_TYPE"), F.count("LOSS_CAUSE_KEY").alias("HAS_LOSS_CAUSE"),
        F.count("WEATHER_EVENT_KEY").alias("HAS_WEATHER_EVENT"), F.count("POLICY_KEY").alias("HAS_POLICY"),
        count_if(F.col("FRAUD_INDICATOR")).alias("FRAUD_FLAGGED"),
        count_if(F.col("IS_WEATHER_RELATED")).alias("WEATHER_RELATED"))


def exists(ctx, table: str) -> bool:
    """The source table can be read: its files are there and have a schema."""
    try:
        ctx.raw.by_name(table).schema  # noqa: B018 — resolves the table
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "TABLE_OR_VIEW_NOT_FOUND"):
            raise
        return False
    return True


def required_tables(ctx) -> DataFrame:
    """The eight source tables the incremental pipeline needs: found or not,
    with row counts. Each table is tested for before it is counted, so a
    missing one shows FOUND = false instead of failing the check."""
    spark = ctx.spark
    req = spark.createDataFrame([(t,) for t in REQUIRED_SOURCE_TABLES], "TABLE_NAME string")
    found = [t for t in REQUIRED_SOURCE_TABLES if exists(ctx, t)]
    if not found:
        return req.select("TABLE_NAME", F.lit(False).alias("FOUND"), F.lit(None).cast("long").alias("ROW_COUNT"))
    counts = _union([ctx.raw.by_name(t).agg(F.count(F.lit(1)).alias("ROW_COUNT"))
                     .select(F.lit(t).alias("TABLE_NAME"), "ROW_COUNT") for t in found])
    j = req.join(counts, "TABLE_NAME", "left")
    return j.select("TABLE_NAME", F.col("ROW_COUNT").isNotNull().alias("FOUND"), "ROW_COUNT")


def build_validation(ctx) -> DataFrame:
    """The validation query of each build step in long form
    (TABLE_NAME, CHECK_NAME, VALUE as text)."""
    s = ctx.star

    def rows(name, df, checks):
        a = df.agg(*[expr.alias(f"_c{i}") for i, (_, expr) in enumerate(checks)])
        arr = F.array(*[F.struct(F.lit(n).alias("CHECK_NAME"), F.col(f"_c{i}").cast("string").alias("VALUE"))
                        for i, (n, _) in enumerate(checks)])
        return a.select(F.explode(arr).alias("r")).select(F.lit(name).alias("TABLE_NAME"), "r.*")
    cnt = F.count(F.lit(1))
    parts = [
        rows("DIM_DATE", s.dim_date(), [("ROWS", cnt), ("MIN_DATE", F.min("DATE_KEY")),
                                        ("MAX_DATE", F.max("DATE_KEY"))]),
        rows("DIM_CLAIM_TYPE", s.dim_claim_type(), [("ROWS", cnt),
                                                    ("CATEGORIES", F.count_distinct("CLAIM_CATEGORY"))]),
        rows("DIM_LOSS_CAUSE", s.dim_loss_cause(), [("ROWS", cnt),
                                                    ("WEATHER_CAUSES", count_if(F.col("IS_WEATHER_RELATED")))]),
        rows("DIM_GEOGRAPHY", s.dim_geography(), [("ROWS", cnt), ("REGIONS", F.count_distinct("REGION")),
                                                  ("STATES", F.count_distinct("STATE_CODE"))]),
        rows("DIM_POLICY", s.dim_policy(), [("ROWS", cnt), ("COVERAGE_TYPES", F.count_distinct("COVERAGE_TYPE"))]),
        rows("DIM_WEATHER_EVENT", s.dim_weather_event(),
             [("ROWS", cnt), ("SEVERITY_TIERS", F.count_distinct("EVENT_SEVERITY_TIER"))]),
        rows("FACT_CLAIMS", s.fact_claims(), [("ROWS", cnt), ("OPEN_CLAIMS", count_if(F.col("CLAIM_STATUS") == "Open")),
                                              ("TOTAL_PAID", sum_money("PAID_AMOUNT"))]),
        rows("FACT_CLAIM_EXPENSE", s.fact_claim_expense(),
             [("ROWS", cnt), ("CATEGORIES", F.count_distinct("EXPENSE_CATEGORY")),
              ("TOTAL_ACTUAL", sum_money("TOTAL_ACTUAL_EXPENSE"))]),
    ]
    return _union(parts)


# -- explorer profiles on the claims fact --------------------------------------
def numeric_histogram(ctx) -> DataFrame:
    return P.numeric_histogram(ctx.star.fact_claims(), "PAID_AMOUNT", 30)


def category_top_n(ctx) -> DataFrame:
    return P.category_top_n(ctx.raw.claims(), "CLAIM_CITY", 15)


def numeric_profile(ctx) -> DataFrame:
    return P.numeric_profile(ctx.star.fact_claims())


def numeric_profile_events(ctx) -> DataFrame:
    """A double and a long column of a given table."""
    return P.numeric_profile(ctx.table("events").select("value", "event_id"))


def histogram_event_value(ctx) -> DataFrame:
    return P.numeric_histogram(ctx.table("events"), "value", 30)


def histogram_event_id(ctx) -> DataFrame:
    return P.numeric_histogram(ctx.table("events"), "event_id", 30)


def null_profile(ctx) -> DataFrame:
    return P.null_profile(ctx.star.fact_claims())


def distinct_counts(ctx) -> DataFrame:
    """Exact distinct counts of the claims fact's dimension keys."""
    fc = ctx.star.fact_claims()
    keys = ["DATE_KEY", "GEOGRAPHY_KEY", "CLAIM_TYPE_KEY", "LOSS_CAUSE_KEY", "WEATHER_EVENT_KEY", "POLICY_KEY"]
    return fc.agg(*[F.count_distinct(k).alias(f"DISTINCT_{k}") for k in keys])


def _all_tables(ctx) -> dict[str, DataFrame]:
    return {t: ctx.raw.by_name(t) for t in ctx.raw.RAW_TABLES} | {t: ctx.star.by_name(t) for t in STAR_TABLES}


def table_inventory(ctx) -> DataFrame:
    return P.table_inventory(_all_tables(ctx))


def column_inventory(ctx) -> DataFrame:
    return P.column_inventory(_all_tables(ctx))
