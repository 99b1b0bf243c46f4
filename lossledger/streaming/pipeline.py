"""End-to-end incremental runs with Structured Streaming.

Each task keeps one target as a RunTable in the shared checkpoint folder
and consumes its own change directory with a file-source stream:

  INCR_DIM_POLICY    POLICY changes        -> DIM_POLICY        by POLICY_KEY
  INCR_FACT_CLAIMS   CLAIMS changes        -> FACT_CLAIMS       by CLAIM_KEY
  INCR_FACT_EXPENSE  CLAIMS_EXPENSE changes-> FACT_CLAIM_EXPENSE by EXPENSE_KEY

The change files arrive in drops; after each drop every task runs once with
an availableNow trigger (the scheduled incremental job), in dependency order
(policy, claims, expense), and takes only files it has not seen (offsets are
in each stream's checkpoint). Rules the original left open are handled:

* a claim with a new address, loss cause or year is given dimension rows
  first, stored with their keys (`plans.growing`), so later batches find them
  and no fact misses its dimension; expense dates extend the calendar too;
* an expense whose claim has not arrived yet is not dropped: the unmatched
  change rows are written back into the expense change directory as a retry
  file, which the next run picks up, by then with the claim in the fact;
* an empty batch is logged SKIPPED.

On a large input both facts and what their batches make are dealt by claim
(`RunTable`): they are built where the raw tables' rows lie, batches meet the
facts there, and an expense batch finds its old lines by their keys alone.

The drops default to the feeds derived from the data (`plans.incremental`).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.operators.upsert import net_changes
from lossledger.plans.growing import GrowingDimensions
from lossledger.plans.incremental import claim_change_feed, claim_fact_rows, expense_change_feed, policy_change_feed
from lossledger.plans.star import CLAIM_COLUMNS, build_fact_expense
from lossledger.shared import shared_dir, written_dealt
from lossledger.streaming.cdc import RunTable, merge_batch_fn, run_change_stream
from lossledger.streaming.runlog import RunLog, recent_runs, record_progress, run_history


def default_drops(ctx) -> dict[str, list[DataFrame]]:
    """The feeds of `plans.incremental` in three drops: first changes, second changes of the same keys, nothing."""
    step = F.col("seq") % 10
    claims, expense, policy = claim_change_feed(ctx), expense_change_feed(ctx), policy_change_feed(ctx)
    none = F.lit(False)
    return {"policy": [policy, policy.where(none), policy.where(none)],
            "claims": [claims.where(step <= 1), claims.where(step >= 2), claims.where(none)],
            "expense": [expense, expense.where(none), expense.where(none)]}


def run_incremental(ctx, drops: dict[str, list[DataFrame]] | None = None) -> dict:
    spark = ctx.spark
    drops = drops or default_drops(ctx)
    base = shared_dir(spark, "incremental")
    log = RunLog(spark, f"{base}/run_log")
    s, buckets = ctx.star, ctx.buckets
    ctx.raw.financial_data(), ctx.raw.litigation(with_id=False)  # every claims batch reads them: written before the fact is made of them

    claims_t = RunTable(spark, f"{base}/FACT_CLAIMS", ["CLAIM_KEY"], buckets=buckets)
    claims_t.create(s.claims_to_deal())
    expense_t = RunTable(spark, f"{base}/FACT_CLAIM_EXPENSE", ["EXPENSE_KEY"], place=["CLAIM_KEY"], buckets=buckets)
    expense_t.create(s.expense_to_merge(claims=claims_t.read()))
    policy_t = RunTable(spark, f"{base}/DIM_POLICY", ["POLICY_KEY"])
    policy_t.create(s.dim_policy())
    dims = GrowingDimensions(ctx, f"{base}/dimensions").create()

    def build_claims(batch, batch_id):
        dims.take_in(batch.where(F.col("action") == "INSERT"), f"claims-{batch_id}")
        net = written_dealt(net_changes(batch.select(*CLAIM_COLUMNS, "action", "seq"), ["CLAIM_ID"]), "net-claims", ["CLAIM_ID"], buckets)
        return claim_fact_rows(ctx, net, dim_geo=dims.geography.members(), dim_cause=dims.causes.members(), is_net=True)

    exp_changes = f"{base}/changes/expense"

    def build_expense(batch, batch_id):
        net = written_dealt(net_changes(batch, ["EXPENSE_ID"]), "net-expenses", ["CLAIM_ID"], buckets)  # three steps read it
        dims.take_in_dates(net.select("EXPENSE_DATE"), f"expense-{batch_id}")
        fc = claims_t.read()           # the claims fact as of now (stream-static join)
        exp_cols = ctx.raw.claims_expense().columns
        rows = build_fact_expense(net.select(*exp_cols, "action", "seq"), fc, more=("action", "seq"))
        retry = net.join(fc.select(F.col("CLAIM_KEY").alias("CLAIM_ID")), "CLAIM_ID", "left_anti")
        if not retry.isEmpty():        # re-queue unmatched changes for the next run
            retry.select(*batch.columns).write.mode("overwrite").parquet(f"{exp_changes}/retry={batch_id}")
        return rows

    def build_policy(batch, batch_id):
        from lossledger.plans.incremental import merge_dim_policy_rows
        return merge_dim_policy_rows(ctx, batch)

    tasks = [
        ("INCR_DIM_POLICY", policy_t, build_policy, drops["policy"], f"{base}/changes/policy"),
        ("INCR_FACT_CLAIMS", claims_t, build_claims, drops["claims"], f"{base}/changes/claims"),
        ("INCR_FACT_EXPENSE", expense_t, build_expense, drops["expense"], exp_changes),
    ]
    for i in range(max(len(d) for _, _, _, d, _ in tasks)):
        for name, table, build, parts, changes in tasks:
            parts[i].write.mode("append").option("compression", "zstd").parquet(f"{changes}/drop={i}")
            on_batch = merge_batch_fn(table, build, log, name)
            q = run_change_stream(spark, f"{changes}/*", parts[i].schema, on_batch, f"{base}/checkpoints/{name}")
            record_progress(spark, f"{base}/progress", name, q.recentProgress)
    return {"FACT_CLAIMS": claims_t, "FACT_CLAIM_EXPENSE": expense_t, "DIM_POLICY": policy_t, "log": log,
            "dimensions": dims, "progress_path": f"{base}/progress"}


def stream_fact_claims(ctx) -> DataFrame:
    return run_incremental(ctx)["FACT_CLAIMS"].read()


def stream_run_history(ctx) -> DataFrame:
    """Runs of the last 24 hours per task, at most the 10 latest of each."""
    day = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - dt.timedelta(hours=24)
    return run_history(recent_runs(run_incremental(ctx)["log"].read(), 10, day))


def stream_status(ctx) -> DataFrame:
    """Per task how many micro-batches of its stream had rows. (The input row counts of a progress record count a
    batch once per action that reads it, so they are kept in the progress log but not reported.)"""
    p = ctx.spark.read.parquet(run_incremental(ctx)["progress_path"])
    return p.groupBy("TASK").agg(F.count_distinct(F.when(F.col("NUM_INPUT_ROWS") > 0, F.col("BATCH_ID"))).alias("BATCHES_WITH_DATA"))
