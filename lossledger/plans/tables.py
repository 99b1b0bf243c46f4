"""Registered table-level queries: star tables, the wide insurance table,
join / key / update operators exercised on the claims data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.sources import reference as ref
from lossledger.operators.keys import small_sequential_key


def fact_claims(ctx) -> DataFrame:
    return ctx.star.fact_claims()


def fact_expense(ctx) -> DataFrame:
    return ctx.star.fact_claim_expense()


def dim_geography(ctx) -> DataFrame:
    return ctx.star.dim_geography()


def dim_loss_cause(ctx) -> DataFrame:
    return ctx.star.dim_loss_cause()


def dim_policy(ctx) -> DataFrame:
    return ctx.star.dim_policy()


def dim_date(ctx) -> DataFrame:
    return ctx.star.dim_date()


def insurance_details(ctx) -> DataFrame:
    """Wide insured / policy / line / claim / catastrophe / financial table:
    insured ⋈ policy ⋈ line of business, then claims, catastrophes and
    financials attached (policies without claims keep one row). The two
    literal tables are broadcast; the others are shuffle joins on their keys.
    The property-address column has no source street address: it stays NULL
    instead of repeating the claim city.

    Skew: one policy may own a large share of all claims. A LEFT JOIN
    policy -> claims would put that policy's claims in one task (AQE can only
    split the preserved side of an outer join), so the outer join is written
    as an INNER join (AQE splits the skewed claims side) plus the policies
    with no claim at all, found by an anti join against the DISTINCT policy
    ids of the claims (a hot id is de-duplicated map-side)."""
    r = ctx.raw
    i = r.insured().select("INSURED_ID", "FIRST_NAME", "LAST_NAME", "PHONE", "EMAIL", "ADDRESS", "CITY", "STATE",
                           "ZIP_CODE")
    p = r.policy().select("POLICY_ID", "POLICY_NUMBER", "INSURED_ID", "LOB_ID", "POLICY_STATUS",
                          "POLICY_EFFECTIVE_DATE", "POLICY_EXPIRATION_DATE", "COVERAGE_TYPE", "COVERAGE_LIMIT",
                          "DEDUCTIBLE", "PREMIUM")
    lob = F.broadcast(r.line_of_business().select("LOB_ID", "LOB_NAME", "LOB_CATEGORY"))
    c = r.claims().select("CLAIM_ID", "POLICY_ID", "CLAIM_NUMBER", "CLAIM_STATUS", "LOSS_DATE", "LOSS_CAUSE",
                          "CLAIM_STATE", "CLAIM_CITY", "CLAIM_ZIP", "CAT_INDICATOR", "CATASTROPHE_ID")
    cat = F.broadcast(r.catastrophe().select("CATASTROPHE_ID", F.col("EVENT_NAME").alias("CATASTROPHE_EVENT_NAME"),
                                             F.col("EVENT_TYPE").alias("CATASTROPHE_EVENT_TYPE"),
                                             F.col("IMPACTED_STATES").alias("CATASTROPHE_IMPACTED_STATES")))
    f = r.financial_data().select("CLAIM_ID", "RESERVE_AMOUNT", "PAID_AMOUNT", "INCURRED_LOSS", "RECOVERY_AMOUNT",
                                  "SUBROGATION_AMOUNT")
    policies = i.join(p, "INSURED_ID").join(lob, "LOB_ID")
    claim_rows = c.join(cat, "CATASTROPHE_ID", "left").join(f, "CLAIM_ID", "left")
    with_claims = policies.join(claim_rows, "POLICY_ID")
    no_claims = policies.join(c.select("POLICY_ID").distinct(), "POLICY_ID", "left_anti")
    no_claims = no_claims.select("*", *[F.lit(None).cast(claim_rows.schema[x].dataType).alias(x)
                                        for x in claim_rows.columns if x != "POLICY_ID"])
    j = with_claims.unionByName(no_claims)
    prop = F.col("LOB_NAME").isin("Homeowners", "Commercial Property")
    return j.select(
        "INSURED_ID", "FIRST_NAME", "LAST_NAME", "PHONE", "EMAIL", "POLICY_ID", "POLICY_NUMBER", "POLICY_STATUS",
        "POLICY_EFFECTIVE_DATE", "POLICY_EXPIRATION_DATE", "COVERAGE_TYPE", "COVERAGE_LIMIT", "DEDUCTIBLE",
        "PREMIUM", "LOB_ID", "LOB_NAME", "LOB_CATEGORY", F.col("ADDRESS").alias("INSURED_ADDRESS"),
        F.col("CITY").alias("INSURED_CITY"), F.col("STATE").alias("INSURED_STATE"),
        F.col("ZIP_CODE").alias("INSURED_ZIP"),
        F.lit(None).cast("string").alias("INSURED_PROPERTY_ADDRESS"),
        F.when(prop, F.col("CLAIM_CITY")).alias("INSURED_PROPERTY_CITY"),
        F.when(prop, F.col("CLAIM_STATE")).alias("INSURED_PROPERTY_STATE"),
        F.when(prop, F.col("CLAIM_ZIP")).alias("INSURED_PROPERTY_ZIP"),
        "CLAIM_ID", "CLAIM_NUMBER", "CLAIM_STATUS", "LOSS_DATE", "LOSS_CAUSE", "CLAIM_STATE", "CLAIM_CITY",
        "CLAIM_ZIP", "CAT_INDICATOR", "CATASTROPHE_ID", "CATASTROPHE_EVENT_NAME", "CATASTROPHE_EVENT_TYPE",
        "CATASTROPHE_IMPACTED_STATES", "RESERVE_AMOUNT", "PAID_AMOUNT", "INCURRED_LOSS", "RECOVERY_AMOUNT",
        "SUBROGATION_AMOUNT")


def surrogate_keys(ctx) -> DataFrame:
    """LITIGATION with LITIGATION_ID = ROW_NUMBER() OVER (ORDER BY CLAIM_ID),
    numbered by the two-phase range operator."""
    return ctx.raw.litigation(with_id=True)


def semi_join(ctx) -> DataFrame:
    """Reference loss causes that occur in CLAIMS (IN-subquery as a left
    semi join), numbered in cause order."""
    present = ctx.raw.claims().select("LOSS_CAUSE")
    r = ref.loss_causes(ctx.spark).join(present, "LOSS_CAUSE", "left_semi")
    return small_sequential_key(r, ["LOSS_CAUSE"], "LOSS_CAUSE_KEY").select(
        "LOSS_CAUSE_KEY", "LOSS_CAUSE", "LOSS_CATEGORY", "IS_WEATHER_RELATED", "WEATHER_CONDITION_MAPPING")


def join_preview(ctx, n: int = 10) -> DataFrame:
    """First n rows (by claim key) of FACT_CLAIMS ⋈ DIM_GEOGRAPHY with both
    sides' columns; the dimension's columns carry a `DIM_` prefix because a
    DataFrame cannot hold two columns of one name. The limit is the feature
    (a preview), planned as TakeOrderedAndProject."""
    a = ctx.star.fact_claims()
    b = ctx.star.dim_geography()
    b = b.select(*[F.col(c).alias(f"DIM_{c}") for c in b.columns])
    return a.join(b, a.GEOGRAPHY_KEY == b.DIM_GEOGRAPHY_KEY).orderBy("CLAIM_KEY").limit(n)


def table_preview(ctx, n: int = 10) -> DataFrame:
    """Highest-paid claims: FACT_CLAIMS ordered by paid amount (claim key
    breaks ties), first n rows."""
    fc = ctx.star.fact_claims()
    return fc.orderBy(F.col("PAID_AMOUNT").desc(), F.col("CLAIM_KEY").asc()).limit(n)


def conditional_update(ctx) -> DataFrame:
    """UPDATE CLAIMS SET LAST_ACTIVITY_DATE = as_of - (CLAIM_ID % 80) - 10
    WHERE CLAIM_STATUS = 'Stalled', as a column rewrite of the whole table."""
    c = ctx.raw.claims()
    new = F.date_add(F.lit(ctx.as_of), (-(F.col("CLAIM_ID") % 80) - 10).cast("int"))
    return c.select("CLAIM_ID", "CLAIM_STATUS",
                    F.when(F.col("CLAIM_STATUS") == "Stalled", new).otherwise(F.col("LAST_ACTIVITY_DATE"))
                    .alias("LAST_ACTIVITY_DATE"))


def table_row_counts(ctx) -> DataFrame:
    """Row counts of every raw and star table in one result (UNION ALL of
    one global count per table)."""
    parts = []
    for name in ctx.raw.RAW_TABLES:
        parts.append(ctx.raw.by_name(name).agg(F.count(F.lit(1)).alias("ROW_COUNT"))
                     .select(F.lit(name).alias("TABLE_NAME"), "ROW_COUNT"))
    from lossledger.plans.star import STAR_TABLES
    for name in STAR_TABLES:
        parts.append(ctx.star.by_name(name).agg(F.count(F.lit(1)).alias("ROW_COUNT"))
                     .select(F.lit(name).alias("TABLE_NAME"), "ROW_COUNT"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
