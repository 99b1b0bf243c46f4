"""Intake checks on the data: quarantine, cleansing of text, distinct sketches, storage and lineage reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossledger.operators import quarantine as Qn
from lossledger.operators.sketches import distinct_between, distinct_sketches
from lossledger.operators.typed import RESCUED, Field, ingest, report
from lossledger.shared import written


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# -- quarantine --------------------------------------------------------------------------
def claim_rules(ctx) -> list[Qn.Rule]:
    return [
        Qn.not_null("claim_without_policy", "POLICY_ID"),
        Qn.not_null("claim_without_stage", "CLAIM_STAGE"),
        Qn.domain("unknown_severity", "CLAIM_SEVERITY", ["Minor", "Moderate", "Significant", "Severe"]),
        Qn.within("fraud_score_out_of_range", "FRAUD_SCORE", 0, 90),
        Qn.ordered("reported_before_loss", "LOSS_DATE", "REPORTED_DATE"),
        Qn.ordered("changed_after_last_activity", "SEVERITY_CHANGE_DATE", "LAST_ACTIVITY_DATE"),
        Qn.unique("second_claim_on_a_day", "POLICY_ID", "LOSS_DATE"),
        Qn.refers_to("unknown_vendor", "VENDOR_ID", ctx.raw.vendor().select("VENDOR_ID")),
    ]


def quarantine_claims_counts(ctx) -> DataFrame:
    return Qn.counts(ctx.raw.claims(), claim_rules(ctx))


def quarantined_claims(ctx) -> DataFrame:
    """Every claim that breaks a rule, with the rules it breaks."""
    bad = Qn.split(ctx.raw.claims(), claim_rules(ctx))[1]
    return bad.select("CLAIM_ID", "CLAIM_STATUS", F.array_join(Qn.REASONS, ", ").alias("REASONS"))


def line_rules(ctx) -> list[Qn.Rule]:
    return [
        Qn.within("quantity_out_of_range", "l_quantity", 1.0, 45.0),
        Qn.domain("unknown_return_flag", "l_returnflag", ["A", "N"]),
        Qn.unique("repeated_line", "l_orderkey", "l_linenumber"),
        Qn.refers_to("order_not_final", "l_orderkey", ctx.table("orders").where(F.col("o_orderstatus") != "P").select("o_orderkey")),
    ]


def quarantine_line_counts(ctx) -> DataFrame:
    return Qn.counts(ctx.table("lineitem"), line_rules(ctx))


def kept_lines(ctx) -> DataFrame:
    """What is left of the order lines, by line status."""
    kept = Qn.split(ctx.table("lineitem"), line_rules(ctx))[0]
    return kept.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("ROWS"), F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).cast("decimal(38,2)").alias("PRICE"))


# -- cleansing ---------------------------------------------------------------------------
EVENT_FIELDS = [Field("event_id", "long"), Field("ts", "timestamp_ntz", format="yyyy-MM-dd HH:mm:ss"), Field("user_id", "long"),
                Field("event_type", "string"), Field("value", "decimal(12,2)")]


def events_as_text(ctx) -> DataFrame:
    """The events table as a text feed delivers it: blanks around numbers, null words, and values that do not fit their type."""
    e, i = ctx.table("events"), F.col("event_id")
    value = F.col("value").cast("decimal(12,2)").cast("string")
    return e.select(
        i.cast("string").alias("event_id"),
        F.when(i % 19 == 0, "2024-13-45 00:00:00").when(i % 23 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts"),
        F.when(i % 29 == 0, F.concat(F.lit("user-"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("  "), F.col("user_id").cast("string"), F.lit(" "))).alias("user_id"),
        F.when(i % 31 == 0, "N/A").otherwise(F.col("event_type")).alias("event_type"),
        F.when(i % 13 == 0, " n/a").when(i % 17 == 0, F.concat(value, F.lit(" EUR"))).otherwise(value).alias("value"))


def cleansed_events(ctx) -> DataFrame:
    typed = ingest(events_as_text(ctx), EVENT_FIELDS)
    return typed.select(*[f.name for f in EVENT_FIELDS], *[F.col(RESCUED)[c].alias(f"rescued_{c}") for c in ("ts", "user_id", "value")])


def cleansing_report(ctx) -> DataFrame:
    return report(ingest(events_as_text(ctx), EVENT_FIELDS), EVENT_FIELDS)


# -- distinct counts from sketches -----------------------------------------------------------
SKETCHED = ["CLAIM_KEY", "POLICY_KEY", "GEOGRAPHY_KEY", "LOSS_CAUSE_KEY", "PAID_AMOUNT"]


def claim_sketches(ctx) -> DataFrame:
    return distinct_sketches(ctx.star.fact_claims(), SKETCHED, F.date_format("DATE_KEY", "yyyy-MM"))


def distinct_by_sketch(ctx) -> DataFrame:
    """Monthly sketches united over a year, two years and all months, held against the exact counts: within 5 % (three standard errors)."""
    sketches, fact = written(claim_sketches(ctx), "sketches"), ctx.star.fact_claims()
    month = F.date_format("DATE_KEY", "yyyy-MM")
    parts = []
    for name, first, last in (("1996", "1996-01", "1996-12"), ("1997-1998", "1997-01", "1998-12"), ("ALL", None, None)):
        rows = fact if first is None else fact.where(month.between(first, last))
        exact = rows.agg(*[F.count_distinct(c).alias(f"_d{i}") for i, c in enumerate(SKETCHED)]).select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("COLUMN_NAME"), F.col(f"_d{i}").alias("EXACT")) for i, c in enumerate(SKETCHED)])).alias("r")).select("r.*")
        found = exact.join(distinct_between(sketches, first, last), "COLUMN_NAME", "left")
        close = F.abs(F.coalesce("DISTINCT_ESTIMATE", F.lit(0)) - F.col("EXACT")) <= F.greatest(F.lit(1.0), 0.05 * F.col("EXACT"))
        parts.append(found.select(F.lit(name).alias("PERIOD"), "COLUMN_NAME", F.coalesce("ROWS", F.lit(0)).cast("long").alias("ROWS"), "EXACT", close.alias("CLOSE")))
    return _union(parts)


# -- storage -----------------------------------------------------------------------------
def storage_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table read from files: rows, columns, files with rows, bytes, last change; and a TOTAL row.

    Spark's hidden `_metadata` gives each row its file's size and time: one
    distributed scan of no column of the table's own, summed per file, then
    per table. Files without rows are not seen.
    """
    parts = []
    for name, df in tables.items():
        per_file = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").groupBy("file_path").agg(
            F.count(F.lit(1)).alias("n"), F.max("file_size").alias("b"), F.max("file_modification_time").alias("t"))
        parts.append(per_file.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("ROW_COUNT"), F.count(F.lit(1)).alias("FILES"),
                                  F.coalesce(F.sum("b"), F.lit(0)).cast("long").alias("BYTES"), F.max("t").alias("LAST_CHANGE"))
                     .select(F.lit(name).alias("TABLE_NAME"), "ROW_COUNT", F.lit(len(df.columns)).cast("long").alias("COLUMN_COUNT"), "FILES", "BYTES", "LAST_CHANGE"))
    out = _union(parts)
    total = out.agg(*[F.sum(c).cast("long").alias(c) for c in ("ROW_COUNT", "COLUMN_COUNT", "FILES", "BYTES")], F.max("LAST_CHANGE").alias("LAST_CHANGE"))
    return out.unionByName(total.withColumn("TABLE_NAME", F.lit("TOTAL")))


GIVEN = ["customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier"]


def given_storage(ctx) -> DataFrame:
    """The given tables' rows and columns, and whether bytes, files and a time were found (their values are the file system's)."""
    s = storage_inventory({t: ctx.table(t) for t in GIVEN})
    return s.select("TABLE_NAME", "ROW_COUNT", "COLUMN_COUNT", ((F.col("BYTES") > 0) & (F.col("FILES") > 0) & F.col("LAST_CHANGE").isNotNull()).alias("STORED"))


# -- lineage -----------------------------------------------------------------------------
MONEY_OF_CLAIM = ["PAID_AMOUNT", "RESERVE_AMOUNT", "INCURRED_LOSS", "RECOVERY_AMOUNT", "SUBROGATION_AMOUNT", "SALVAGE_AMOUNT"]
#: (raw table, its columns, star table, its columns, whether only distinct rows arrive, rows that the step makes of nothing)
LINEAGE = [
    ("LINE_OF_BUSINESS", ["LOB_ID", "LOB_NAME", "LOB_CATEGORY"], "DIM_CLAIM_TYPE", ["CLAIM_TYPE_KEY", "CLAIM_TYPE", "CLAIM_CATEGORY"], False, None),
    ("CATASTROPHE", ["CATASTROPHE_ID", "CATASTROPHE_CODE", "EVENT_NAME"], "DIM_WEATHER_EVENT", ["WEATHER_EVENT_KEY", "CATASTROPHE_CODE", "EVENT_NAME"], False, None),
    ("POLICY", ["POLICY_ID", "POLICY_NUMBER", "PREMIUM", "AGENCY_NAME"], "DIM_POLICY", ["POLICY_KEY", "POLICY_NUMBER", "PREMIUM", "AGENCY_NAME"], False, None),
    ("INSURED", ["INSURED_ID"], "DIM_POLICY", ["INSURED_ID"], True, None),
    ("CLAIMS", ["LOSS_CAUSE"], "DIM_LOSS_CAUSE", ["LOSS_CAUSE"], True, None),
    ("CLAIMS", ["CLAIM_STATE", "CLAIM_CITY", "CLAIM_ZIP"], "DIM_GEOGRAPHY", ["STATE_CODE", "CITY", "ZIP_CODE"], True, None),
    ("CLAIMS", ["CLAIM_ID", "CLAIM_NUMBER", "LOSS_DATE", "CLAIM_STATUS", "CLAIM_SEVERITY", "POLICY_ID"], "FACT_CLAIMS",
     ["CLAIM_KEY", "CLAIM_NUMBER", "DATE_KEY", "CLAIM_STATUS", "CLAIM_SEVERITY", "POLICY_KEY"], False, None),
    ("FINANCIAL_DATA", ["CLAIM_ID", *MONEY_OF_CLAIM], "FACT_CLAIMS", ["CLAIM_KEY", *MONEY_OF_CLAIM], False, "zero"),
    ("LITIGATION", ["CLAIM_ID", "LITIGATION_STATUS", "SETTLEMENT_AMOUNT"], "FACT_CLAIMS", ["CLAIM_KEY", "LITIGATION_STATUS", "LITIGATION_SETTLEMENT_AMOUNT"], False, "no status"),
    ("CLAIMS_EXPENSE", ["EXPENSE_ID", "CLAIM_ID", "EXPENSE_DATE", "LEGAL_FEES"], "FACT_CLAIM_EXPENSE", ["EXPENSE_KEY", "CLAIM_KEY", "EXPENSE_DATE", "ACTUAL_LEGAL_FEES"], False, None),
    ("CLAIMS", ["POLICY_ID"], "DIM_POLICY", ["POLICY_KEY"], True, None),
]


def checksum(df: DataFrame, cols: list[str]) -> tuple[Column, Column]:
    """(rows, the sum of a 60-bit hash of each row): equal for equal multisets of rows, in any order."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
    return F.count(F.lit(1)), F.coalesce(F.sum(number), F.lit(0)).cast("decimal(38,0)").cast("string")


def _side(df: DataFrame, cols: list[str], distinct: bool, without: str | None) -> DataFrame:
    rows = df.select(*cols)
    if without == "zero":
        rows = rows.where(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in cols[1:]]))
    if without == "no status":
        rows = rows.where(F.col(cols[1]).isNotNull())
    return rows.distinct() if distinct else rows


def reconciled(edges: list[tuple], raw, star) -> DataFrame:
    """Per edge: rows and checksum of what the raw table holds and of what arrived, without a join of the two.

    `raw` and `star` give a table by name. Each side is one scan with partial
    sums; a lost, doubled or changed row shows in the count or the checksum.
    """
    parts = []
    for source, cols, target, kept, distinct, without in edges:
        sides = []
        for prefix, df, names in (("RAW", raw(source), cols), ("STAR", star(target), kept)):
            n, total = checksum(df, names)
            sides.append(_side(df, names, distinct, without).agg(n.alias(f"{prefix}_ROWS"), total.alias(f"{prefix}_CHECKSUM")))
        both = sides[0].crossJoin(sides[1])  # one row each
        parts.append(both.select(F.lit(source).alias("RAW_TABLE"), F.lit(target).alias("STAR_TABLE"), F.lit(", ".join(cols)).alias("COLUMNS"), "RAW_ROWS", "STAR_ROWS",
                                 "RAW_CHECKSUM", "STAR_CHECKSUM", ((F.col("RAW_ROWS") == F.col("STAR_ROWS")) & (F.col("RAW_CHECKSUM") == F.col("STAR_CHECKSUM"))).alias("RECONCILED")))
    return _union(parts)


def lineage_reconciliation(ctx) -> DataFrame:
    return reconciled(LINEAGE, ctx.raw.by_name, ctx.star.by_name)
