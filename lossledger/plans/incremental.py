"""Incremental maintenance of the star schema from change feeds.

A change row is the table's columns plus `action` ('INSERT' | 'DELETE') and
`seq` (order of changes); an update is DELETE(before) + INSERT(after) with
one key. The MERGE steps:

* FACT_CLAIMS   by CLAIM_KEY   — changed claims rebuilt into fact rows
                                 (stream-static joins to financials,
                                 litigation, geography and cause dims)
* FACT_CLAIM_EXPENSE by EXPENSE_KEY — changed expense lines joined to the
                                 claims fact (inner: an expense whose claim
                                 is not there yet is returned separately
                                 for a retry instead of being dropped)
* DIM_POLICY    by POLICY_KEY
* DIM_WEATHER_EVENT by WEATHER_EVENT_KEY

By default every non-key column is refreshed on a match (the original MERGE
left some keys/flags and LEGAL_FEES_VARIANCE stale); `strict_reference=True`
restricts the update to the original column lists.

`claim_change_feed` etc. derive deterministic change feeds from the current
tables by business rules (every open claim closes, every stalled claim moves
stage twice, every rejected claim gets a DELETE, ...), so the merges can be
exercised on data of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.operators.keys import extend_keys
from lossledger.operators.upsert import net_changes, placed, upsert
from lossledger.shared import written, written_dealt
from lossledger.sources import reference as ref
from lossledger.plans.star import CLAIM_COLUMNS, build_fact_claims, build_fact_expense, weather_event_rows

# FIXED VALUES — columns the original MERGE statements update on a match
FACT_CLAIMS_UPDATE_STRICT = [
    "CLAIM_STATUS", "CLAIM_STAGE", "CLAIM_SEVERITY", "PAID_AMOUNT", "RESERVE_AMOUNT", "INCURRED_LOSS",
    "RECOVERY_AMOUNT", "SUBROGATION_AMOUNT", "SALVAGE_AMOUNT", "NET_INCURRED", "PAYMENT_TYPE", "PAYMENT_DATE",
    "FRAUD_INDICATOR", "FRAUD_SCORE", "FRAUD_RISK_TIER", "DAYS_TO_CLOSE", "CLOSE_DATE", "LAST_ACTIVITY_DATE",
    "LITIGATION_SETTLEMENT_AMOUNT", "LITIGATION_DEFENSE_COSTS", "LITIGATION_STATUS",
]
FACT_EXPENSE_UPDATE_STRICT = [
    "EXPENSE_DATE", "EXPENSE_CATEGORY", "ACTUAL_LEGAL_FEES", "ACTUAL_ADJUSTOR_COSTS",
    "ACTUAL_INVESTIGATION_CHARGES", "ACTUAL_ULAE", "TOTAL_ACTUAL_EXPENSE", "TOTAL_EXPENSE_VARIANCE",
]
DIM_POLICY_UPDATE_STRICT = ["POLICY_STATUS", "POLICY_ACTIVE_STATUS", "PREMIUM", "COVERAGE_LIMIT", "DEDUCTIBLE",
                            "INSURED_NAME"]
DIM_WEATHER_UPDATE_STRICT = ["END_DATE", "EVENT_DURATION_DAYS", "IMPACTED_STATES", "ESTIMATED_INDUSTRY_LOSS",
                             "EVENT_SEVERITY_TIER"]


def _change(df: DataFrame, action: str, key: str, step: int) -> DataFrame:
    return df.select("*", F.lit(action).alias("action"), (F.col(key) * 10 + step).cast("long").alias("seq"))


def _changes(df: DataFrame, key: str, *cases) -> DataFrame:
    """The changes of a table in one scan. A case is a condition on a row, of which at most one holds, and the changes
    that such a row goes through: (action, step, columns with another value)."""
    touched = sorted({c for _, steps in cases for _, _, new in steps for c in new})

    def step(action, number, new):
        return F.struct(F.lit(action).alias("action"), F.lit(number).alias("step"),
                        *[new.get(c, F.col(c)).cast(df.schema[c].dataType).alias(c) for c in touched])
    made = None
    for condition, steps in cases:
        row = F.array(*[step(*s) for s in steps])
        made = F.when(condition, row) if made is None else made.when(condition, row)
    rows = df.select("*", F.explode(made).alias("_change"))
    return rows.select(*[F.col(f"_change.{c}").alias(c) if c in touched else F.col(c) for c in df.columns],
                       F.col("_change.action").alias("action"), (F.col(key) * 10 + F.col("_change.step")).cast("long").alias("seq"))


# -- change feeds derived from the data ----------------------------------------
def claim_change_feed(ctx) -> DataFrame:
    """Open claims close at as_of; stalled claims move to Negotiation and then
    Settlement Review (two updates of one key in one feed); pending-review
    claims lose their stage (an update to NULL); rejected claims get a
    DELETE only."""
    c = ctx.raw.claims()
    st = F.col("CLAIM_STATUS")
    as_of = F.lit(ctx.as_of)
    closed = {"CLAIM_STATUS": F.lit("Closed"), "CLOSE_DATE": as_of, "LAST_ACTIVITY_DATE": as_of}
    nego, settle = {"CLAIM_STAGE": F.lit("Negotiation")}, {"CLAIM_STAGE": F.lit("Settlement Review")}
    unstaged = {"CLAIM_STAGE": F.lit(None)}
    return _changes(c, "CLAIM_ID",
                    (st == "Open", [("DELETE", 0, {}), ("INSERT", 1, closed)]),
                    (st == "Stalled", [("DELETE", 0, {}), ("INSERT", 1, nego), ("DELETE", 2, nego), ("INSERT", 3, settle)]),
                    (st == "Pending Review", [("DELETE", 0, {}), ("INSERT", 1, unstaged)]),
                    (st == "Rejected", [("DELETE", 0, {})]))


def expense_change_feed(ctx) -> DataFrame:
    """Every legal expense line is re-billed with 250.00 more legal fees."""
    e = ctx.raw.claims_expense()
    legal = F.col("EXPENSE_CATEGORY") == "Legal"
    after = {"LEGAL_FEES": (F.col("LEGAL_FEES") + F.lit(250).cast("decimal(12,2)")).cast("decimal(12,2)")}
    return _changes(e.where(legal), "EXPENSE_ID", (legal, [("DELETE", 0, {}), ("INSERT", 1, after)]))


def policy_change_feed(ctx) -> DataFrame:
    """Cancelled policies are reinstated with a 100.00 higher premium."""
    p = ctx.raw.policy().where(F.col("POLICY_STATUS") == "Cancelled")
    after = p.withColumn("POLICY_STATUS", F.lit("Active")) \
        .withColumn("PREMIUM", (F.col("PREMIUM") + F.lit(100).cast("decimal(10,2)")).cast("decimal(10,2)"))
    return _change(p, "DELETE", "POLICY_ID", 0).unionByName(_change(after, "INSERT", "POLICY_ID", 1))


# -- merges ----------------------------------------------------------------------
def cdc_net_changes(ctx) -> DataFrame:
    """The claim feed reduced to one row per key (latest INSERT wins;
    deletes ignored, as in the original stream filter)."""
    return net_changes(claim_change_feed(ctx), ["CLAIM_ID"])


def described_geography(new: DataFrame, spark) -> DataFrame:
    """DIM_GEOGRAPHY rows of keyed addresses (GEOGRAPHY_KEY, STATE_CODE, CITY, ZIP_CODE)."""
    return new.join(F.broadcast(ref.states(spark)), "STATE_CODE", "left").select(
        "GEOGRAPHY_KEY", "STATE_CODE", F.coalesce("STATE_NAME", "STATE_CODE").alias("STATE_NAME"),
        F.coalesce("REGION", F.lit("Unknown")).alias("REGION"), "CITY", "ZIP_CODE")


def described_causes(new: DataFrame, spark) -> DataFrame:
    """DIM_LOSS_CAUSE rows of keyed causes; one missing from the reference list has a NULL category."""
    out = new.join(F.broadcast(ref.loss_causes(spark)), "LOSS_CAUSE", "left")
    return out.withColumn("IS_WEATHER_RELATED", F.coalesce("IS_WEATHER_RELATED", F.lit(False)))


def new_geography_rows(dim_geo: DataFrame, claims: DataFrame, spark) -> DataFrame:
    """DIM_GEOGRAPHY rows for addresses in `claims` that the dimension lacks,
    keyed after its largest key (a claim in an unseen city gets a key instead
    of a NULL). Not stored: for one merge only (see `plans.growing`)."""
    cand = claims.where(F.col("CLAIM_STATE").isNotNull()).select(
        F.col("CLAIM_STATE").alias("STATE_CODE"), F.col("CLAIM_CITY").alias("CITY"), F.col("CLAIM_ZIP").alias("ZIP_CODE"))
    return described_geography(extend_keys(dim_geo, cand, ["STATE_CODE", "CITY", "ZIP_CODE"], "GEOGRAPHY_KEY"), spark)


def new_cause_rows(dim_cause: DataFrame, claims: DataFrame, spark) -> DataFrame:
    """DIM_LOSS_CAUSE rows for causes in `claims` that the dimension lacks,
    keyed after its largest key; not stored, as above."""
    cand = claims.where(F.col("LOSS_CAUSE").isNotNull()).select("LOSS_CAUSE")
    return described_causes(extend_keys(dim_cause, cand, ["LOSS_CAUSE"], "LOSS_CAUSE_KEY"), spark).select(*dim_cause.columns)


def extended_causes(ctx, claims: DataFrame) -> DataFrame:
    cause = ctx.star.dim_loss_cause()
    return cause.unionByName(new_cause_rows(cause, claims, ctx.spark))


def extended_dimensions(ctx, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Geography and loss-cause dimensions with rows for what `claims` adds,
    so that no fact row of a changed claim gets a NULL key."""
    geo = ctx.star.dim_geography()
    return geo.unionByName(new_geography_rows(geo, claims, ctx.spark)), extended_causes(ctx, claims)


def claim_fact_rows(ctx, feed: DataFrame, apply_deletes: bool = False,
                    dim_geo: DataFrame | None = None, dim_cause: DataFrame | None = None, is_net: bool = False) -> DataFrame:
    """Changed claims rebuilt into FACT_CLAIMS rows (+ action, seq): the
    change rows are the streaming side, financials / litigation / dims the
    static side of the joins. Without dimensions given, addresses and causes
    that the star's do not know are keyed for this call alone. `is_net`: the
    feed has been reduced to one row per claim and written."""
    net = feed if is_net else written_dealt(net_changes(feed.select(*CLAIM_COLUMNS, "action", "seq"), ["CLAIM_ID"], apply_deletes=apply_deletes),
                                            "net-claims", ["CLAIM_ID"], ctx.buckets)
    changed = net.select(*CLAIM_COLUMNS)
    if dim_geo is None or dim_cause is None:
        dim_geo, dim_cause = extended_dimensions(ctx, changed)
    rebuilt = build_fact_claims(changed, ctx.raw.financial_data(), ctx.raw.litigation(with_id=False),
                                dim_geo, dim_cause, ctx.fraud_rule)
    return rebuilt.join(net.select(F.col("CLAIM_ID").alias("CLAIM_KEY"), "action", "seq"), "CLAIM_KEY")


def merge_fact_claims_from(ctx, feed: DataFrame, target: DataFrame | None = None,
                           strict_reference: bool = False, apply_deletes: bool = False) -> DataFrame:
    target = target if target is not None else ctx.star.fact_claims()
    src = claim_fact_rows(ctx, feed, apply_deletes)
    update = FACT_CLAIMS_UPDATE_STRICT if strict_reference else None
    return upsert(target, src, ["CLAIM_KEY"], update, apply_deletes=apply_deletes)


def merge_fact_claims(ctx) -> DataFrame:
    return merge_fact_claims_from(ctx, claim_change_feed(ctx))


def merge_fact_expense_from(ctx, feed: DataFrame, target: DataFrame | None = None,
                            strict_reference: bool = False) -> tuple[DataFrame, DataFrame]:
    """Returns (new FACT_CLAIM_EXPENSE, unmatched expense changes to retry).

    The net changes are written once, by claim, for the fact rows and the retry. Lines and their claims lie by
    claim, and so does the target where no query has written it: the merge moves the keys alone."""
    s = ctx.star
    net = written_dealt(net_changes(feed, ["EXPENSE_ID"]), "net-expenses", ["CLAIM_ID"], ctx.buckets)
    target = target if target is not None else s.expense_to_merge()
    fc = s.fact_claims()
    exp_cols = ctx.raw.claims_expense().columns
    src = build_fact_expense(net.select(*exp_cols, "action", "seq"), fc, more=("action", "seq"))
    retry = net.join(fc.select(F.col("CLAIM_KEY").alias("CLAIM_ID")), "CLAIM_ID", "left_anti")
    if strict_reference:
        return upsert(target, src, ["EXPENSE_KEY"], FACT_EXPENSE_UPDATE_STRICT), retry
    return placed(target, src, ["EXPENSE_KEY"], ["CLAIM_KEY"], ctx.buckets), retry


def merge_fact_expense(ctx) -> DataFrame:
    return merge_fact_expense_from(ctx, expense_change_feed(ctx))[0]


def policy_rows(policies: DataFrame, insured: DataFrame, as_of, *more: str) -> DataFrame:
    """DIM_POLICY rows of POLICY and INSURED rows, and the columns in `more`."""
    today = F.lit(as_of)
    return policies.join(insured.select("INSURED_ID", "FIRST_NAME", "LAST_NAME"), "INSURED_ID", "left").select(
        F.col("POLICY_ID").alias("POLICY_KEY"), "POLICY_NUMBER", "INSURED_ID",
        F.concat(F.coalesce("FIRST_NAME", F.lit("")), F.lit(" "), F.coalesce("LAST_NAME", F.lit("")))
        .alias("INSURED_NAME"),
        "POLICY_EFFECTIVE_DATE", "POLICY_EXPIRATION_DATE", "POLICY_TERM_MONTHS", "COVERAGE_TYPE", "COVERAGE_LIMIT",
        "DEDUCTIBLE", "PREMIUM", "POLICY_STATE", "POLICY_ZIP", "AGENT_NAME", "AGENCY_NAME", "POLICY_STATUS",
        F.when(F.col("POLICY_EXPIRATION_DATE") < today, "Expired").when(F.col("POLICY_EFFECTIVE_DATE") > today,
                                                                           "Future").otherwise("Active")
        .alias("POLICY_ACTIVE_STATUS"), *more)


def merge_dim_policy_rows(ctx, feed: DataFrame) -> DataFrame:
    """DIM_POLICY rows (+ action, seq) for the policies in a change feed. (A changed insured: `plans.propagate`.)"""
    return policy_rows(net_changes(feed, ["POLICY_ID"]), ctx.raw.insured(), ctx.as_of, "action", "seq")


def merge_dim_policy_from(ctx, feed: DataFrame, target: DataFrame | None = None,
                          strict_reference: bool = False) -> DataFrame:
    target = target if target is not None else ctx.star.dim_policy()
    update = DIM_POLICY_UPDATE_STRICT if strict_reference else None
    return upsert(target, merge_dim_policy_rows(ctx, feed), ["POLICY_KEY"], update)


def merge_dim_policy(ctx) -> DataFrame:
    return merge_dim_policy_from(ctx, policy_change_feed(ctx))


def merge_dim_weather_from(ctx, feed: DataFrame, target: DataFrame | None = None,
                           strict_reference: bool = False) -> DataFrame:
    target = target if target is not None else ctx.star.dim_weather_event()
    net = net_changes(feed, ["CATASTROPHE_ID"])
    rows = weather_event_rows(net, ctx.catastrophic_loss).join(
        net.select(F.col("CATASTROPHE_ID").alias("WEATHER_EVENT_KEY"), "action", "seq"), "WEATHER_EVENT_KEY")
    update = DIM_WEATHER_UPDATE_STRICT if strict_reference else None
    return upsert(target, rows, ["WEATHER_EVENT_KEY"], update)


# -- FACT_CLAIMS refreshed from every source feed ---------------------------------
def financial_change_feed(ctx) -> DataFrame:
    """Approved claims receive a further 100.00 payment."""
    approved = ctx.raw.claims().where(F.col("CLAIM_STATUS") == "Approved").select("CLAIM_ID")
    f = ctx.raw.financial_data().join(approved, "CLAIM_ID", "left_semi")
    after = f.withColumn("PAID_AMOUNT", (F.col("PAID_AMOUNT") + F.lit(100).cast("decimal(15,2)")).cast("decimal(15,2)"))
    return _change(f, "DELETE", "FINANCIAL_ID", 0).unionByName(_change(after, "INSERT", "FINANCIAL_ID", 1))


def litigation_change_feed(ctx) -> DataFrame:
    """Cases in discovery move to mediation."""
    lit = ctx.raw.litigation(with_id=False).where(F.col("LITIGATION_STATUS") == "Discovery")
    after = lit.withColumn("LITIGATION_STATUS", F.lit("Mediation"))
    return _change(lit, "DELETE", "CLAIM_ID", 0).unionByName(_change(after, "INSERT", "CLAIM_ID", 1))


def merge_fact_claims_all_sources_from(ctx, claim_feed: DataFrame, financial_feed: DataFrame,
                                       litigation_feed: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """FACT_CLAIMS refreshed for every claim touched by a CLAIMS, FINANCIAL_DATA
    or LITIGATION change (the original only reacted to CLAIMS changes). The
    fact rows of the union of changed claim ids are rebuilt from the new
    state of each source and merged.

    Only the changed claims' slice of each source is brought to its new
    state: an upsert decides every key on its own rows, so restricting the
    sources to the changed claim ids *before* the upsert gives the same
    slice as upserting the whole table and filtering afterwards, without a
    full outer join (and shuffle) of every raw table. The id set is as small
    as the change feeds, so AQE can broadcast it into the semi joins."""
    s = ctx.star
    target = target if target is not None else s.fact_claims()
    ids = (net_changes(claim_feed, ["CLAIM_ID"]).select("CLAIM_ID")
           .unionByName(net_changes(financial_feed, ["FINANCIAL_ID"]).select("CLAIM_ID"))
           .unionByName(net_changes(litigation_feed, ["CLAIM_ID"]).select("CLAIM_ID"))
           .distinct())
    ids = written(ids, "changed-claims")  # four semi joins read it

    def in_ids(df: DataFrame) -> DataFrame:
        return df.join(ids, "CLAIM_ID", "left_semi")

    # keyed by CLAIM_ID: restricting the target to the ids is exact (every
    # key a feed inserts is one of the ids; DELETE rows are not applied)
    # written: the dimensions' candidates, the address lookup and the fact rows all read it
    changed = written(upsert(in_ids(ctx.raw.claims().select(*CLAIM_COLUMNS)), claim_feed, ["CLAIM_ID"]), "claims")
    lit = upsert(in_ids(ctx.raw.litigation(with_id=False)), litigation_feed, ["CLAIM_ID"])
    # keyed by FINANCIAL_ID: a change that carries every column replaces the
    # row whether or not it matched, so the target may be cut to the ids and
    # the result filtered by its (possibly changed) CLAIM_ID; otherwise the
    # whole table is upserted first
    fin_all = ctx.raw.financial_data()
    if set(fin_all.columns) <= set(financial_feed.columns):
        fin = in_ids(upsert(in_ids(fin_all), financial_feed, ["FINANCIAL_ID"]))
    else:
        fin = in_ids(upsert(fin_all, financial_feed, ["FINANCIAL_ID"]))
    rows = build_fact_claims(changed, fin, lit, *extended_dimensions(ctx, changed), ctx.fraud_rule)
    rows = rows.select("*", F.lit("INSERT").alias("action"), F.lit(0).cast("long").alias("seq"))
    return upsert(target, rows, ["CLAIM_KEY"])


def merge_fact_claims_all_sources(ctx) -> DataFrame:
    return merge_fact_claims_all_sources_from(ctx, claim_change_feed(ctx), financial_change_feed(ctx),
                                              litigation_change_feed(ctx))
