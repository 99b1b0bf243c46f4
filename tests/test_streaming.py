"""The streaming change-feed run ends in the same table as the batch MERGE,
skips an empty batch, and survives replays, retries and late changes."""

from pyspark.sql import functions as F

from lossledger.plans.incremental import claim_change_feed, claim_fact_rows, merge_dim_policy, merge_fact_claims
from lossledger.shared import shared_dir
from lossledger.streaming.cdc import RunTable
from lossledger.streaming.pipeline import default_drops, run_incremental
from lossledger.streaming.runlog import recent_runs, run_history


def _with_change(df, key, step):
    return df.select("*", F.lit("INSERT").alias("action"), (F.col(key) * 10 + step).cast("long").alias("seq"))


def late_claim(ctx):
    """The newest claim copied under the next free claim id (it arrives one drop after its expense line)."""
    c = ctx.raw.claims()
    top = c.agg(F.max("CLAIM_ID")).first()[0]
    return c.where(F.col("CLAIM_ID") == top).withColumn("CLAIM_ID", (F.col("CLAIM_ID") + 1).cast(c.schema["CLAIM_ID"].dataType))


def early_expense(ctx):
    """The late claim's expense line (arrives before the claim)."""
    e = ctx.raw.claims_expense()
    new = late_claim(ctx).first()["CLAIM_ID"]
    first = e.orderBy(F.col("CLAIM_ID").desc(), "EXPENSE_ID").limit(1)
    return first.withColumns({"EXPENSE_ID": F.lit(new * 10 + 1).cast(e.schema["EXPENSE_ID"].dataType),
                              "CLAIM_ID": F.lit(new).cast(e.schema["CLAIM_ID"].dataType)})


def test_incremental_streams(ctx):
    drops = default_drops(ctx)
    drops["claims"][1] = drops["claims"][1].unionByName(_with_change(late_claim(ctx), "CLAIM_ID", 1))
    drops["expense"][0] = drops["expense"][0].unionByName(_with_change(early_expense(ctx), "EXPENSE_ID", 1))
    out = run_incremental(ctx, drops)
    a = out["FACT_CLAIMS"].read()
    b = merge_fact_claims(ctx)
    late_id = late_claim(ctx).first()["CLAIM_ID"]
    assert a.count() == b.count() + 1
    assert a.where(F.col("CLAIM_KEY") != late_id).exceptAll(b.select(*a.columns)).count() == 0
    # the expense line that arrived before its claim was retried, not lost
    e = out["FACT_CLAIM_EXPENSE"].read()
    early_key = early_expense(ctx).first()["EXPENSE_ID"]
    assert e.where(F.col("EXPENSE_KEY") == early_key).count() == 1
    assert e.count() == ctx.star.fact_claim_expense().count() + 1
    p = out["DIM_POLICY"].read()
    assert p.exceptAll(merge_dim_policy(ctx).select(*p.columns)).count() == 0
    hist = {r["TASK"]: r for r in run_history(out["log"].read()).collect()}
    assert set(hist) == {"INCR_DIM_POLICY", "INCR_FACT_CLAIMS", "INCR_FACT_EXPENSE"}
    assert (hist["INCR_FACT_CLAIMS"]["SUCCEEDED"], hist["INCR_FACT_CLAIMS"]["SKIPPED"]) == (2, 1)
    assert hist["INCR_FACT_EXPENSE"]["SUCCEEDED"] == 2          # drop 0, then the retry file
    assert all(h["FAILED"] == 0 for h in hist.values())
    assert recent_runs(out["log"].read(), per_task=2).count() == 6
    progress = ctx.spark.read.parquet(out["progress_path"])
    assert progress.where("NUM_INPUT_ROWS > 0").count() >= 3
    # deleting older runs changes nothing that is read
    out["FACT_CLAIMS"].keep(1)
    c = out["FACT_CLAIMS"].read()
    assert c.count() == b.count() + 1 and c.where(F.col("CLAIM_KEY") != late_id).exceptAll(b.select(*c.columns)).count() == 0


def test_run_table_cases(spark):
    t = RunTable(spark, shared_dir(spark, "cases") + "/t", ["k"], apply_deletes=True)
    t.create(spark.createDataFrame([(k, 0) for k in range(12)], "k long, v long"))
    change = lambda *rows: spark.createDataFrame(list(rows), "k long, v long, action string, seq long")
    state = lambda: {r["k"]: r["v"] for r in t.read().collect()}
    t.merge(change(*[(k, None, "DELETE", 1) for k in (3, 5, 7, 11)]), 0)
    assert set(state()) == {0, 1, 2, 4, 6, 8, 9, 10}            # all of several keys deleted, nothing left behind
    t.merge(change((1, 9, "INSERT", 9)), 1)
    t.merge(change((1, 2, "INSERT", 2)), 2)                     # a retry with an older change comes late
    assert state()[1] == 9
    t.merge(change((1, 2, "INSERT", 2)), 2)                     # the same batch again
    assert state()[1] == 9
    t.keep(2)
    t.merge(change((1, 3, "INSERT", 3), (3, 4, "INSERT", 0), (5, 6, "INSERT", 7)), 3)
    assert state()[1] == 9 and 3 not in state() and state()[5] == 6
    # a batch whose write broke off leaves the state as it was
    change((0, 77, "INSERT", 99)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{t.path}/run-5")
    assert state()[0] == 0
    t.merge(change(*[(k, None, "DELETE", 100) for k in range(12)]), 4)
    assert state() == {}


def test_merge_replay(ctx):
    spark = ctx.spark
    t = RunTable(spark, shared_dir(spark, "replay") + "/t", ["CLAIM_KEY"])
    t.create(ctx.star.fact_claims())
    rows = claim_fact_rows(ctx, claim_change_feed(ctx))
    t.merge(rows, 0)
    first = sorted(t.read().collect(), key=str)
    t.merge(rows, 0)
    assert sorted(t.read().collect(), key=str) == first


def _new_members(ctx, batch):
    """Five claims under a cause, a city and a year of this batch only, and one of the batch before."""
    c = ctx.raw.claims().orderBy("CLAIM_ID").limit(6 * (batch + 1)).orderBy(F.desc("CLAIM_ID")).limit(6)
    return c.withColumns({"LOSS_CAUSE": F.lit(f"METEORITE {batch}"), "CLAIM_CITY": F.when(F.col("CLAIM_ID") % 2 == 0, f"CITY {batch}").otherwise(f"CITY {batch - 1}"),
                          "LOSS_DATE": F.add_months("LOSS_DATE", 12 * 30 * (batch + 1))}).select(
        *c.columns, F.lit("INSERT").alias("action"), (F.col("CLAIM_ID") * 10 + 5).cast("long").alias("seq"))


def test_two_streamed_batches_with_new_members(ctx):
    """Different new causes, cities and years in two batches get different keys, and every fact finds its dimension rows."""
    none = F.lit(False)
    policy, expense = default_drops(ctx)["policy"][0], default_drops(ctx)["expense"][0]
    drops = {"claims": [_new_members(ctx, 0), _new_members(ctx, 1)], "policy": [policy.where(none)] * 2,
             "expense": [expense.where(none), expense.withColumn("EXPENSE_DATE", F.add_months("EXPENSE_DATE", 12 * 90))]}
    out = run_incremental(ctx, drops)
    dims, fact = out["dimensions"], out["FACT_CLAIMS"].read()
    causes = {r["LOSS_CAUSE"]: r["LOSS_CAUSE_KEY"] for r in dims.causes.read().collect()}
    top = ctx.star.dim_loss_cause().agg(F.max("LOSS_CAUSE_KEY")).first()[0]
    assert causes["METEORITE 0"] == top + 1 and causes["METEORITE 1"] == top + 2
    geo = dims.geography.members()
    assert geo.count() == geo.select("GEOGRAPHY_KEY").distinct().count() == geo.select("STATE_CODE", "CITY", "ZIP_CODE").distinct().count()
    assert {r[0] for r in geo.where(F.col("CITY").startswith("CITY ")).select("CITY").distinct().collect()} == {"CITY -1", "CITY 0", "CITY 1"}
    for key, dim in (("LOSS_CAUSE_KEY", dims.causes), ("GEOGRAPHY_KEY", dims.geography), ("DATE_KEY", dims.calendar)):
        assert fact.join(dim.members(), key, "left_anti").count() == 0
    spent = out["FACT_CLAIM_EXPENSE"].read().select(F.col("EXPENSE_DATE").alias("DATE_KEY"))
    assert spent.count() > 0 and spent.join(dims.calendar.members(), "DATE_KEY", "left_anti").count() == 0
    days = dims.calendar.members()
    lo, hi = days.agg(F.min("DATE_KEY"), F.max("DATE_KEY")).first()
    assert days.count() == days.distinct().count() == (hi - lo).days + 1


def test_member_store_is_idempotent(ctx):
    """A replayed batch hands out no second key; NULL parts of a key match; a broken write is not read."""
    from lossledger.operators.members import MemberStore
    spark = ctx.spark
    dim = spark.createDataFrame([(1, "a", None), (2, "a", "x")], "K long, A string, B string")
    store = MemberStore(spark, shared_dir(spark, "members") + "/t", dim.schema, ["A", "B"], "K").create(dim)
    state = lambda: {(r["A"], r["B"]): (r["K"], r["ALLOCATED_IN"]) for r in store.read().collect()}
    new = spark.createDataFrame([("a", None), ("b", None), ("b", None), (None, None), ("a", "x")], "A string, B string")
    store.allocate(new, "1", lambda df: df)
    first = {("a", None): (1, "build"), ("a", "x"): (2, "build"), (None, None): (3, "1"), ("b", None): (4, "1")}
    assert state() == first
    store.allocate(new, "1", lambda df: df)                      # replay
    store.allocate(new, "2", lambda df: df)                      # nothing new
    assert state() == first
    new.withColumn("K", F.lit(99).cast("long")).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{store.path}/ALLOCATED_IN=3")
    assert state() == first
    store.allocate(spark.createDataFrame([("c", "y")], "A string, B string"), "3", lambda df: df)
    assert state() == {**first, ("c", "y"): (5, "3")}


def test_new_loss_cause_gets_a_key(ctx):
    from lossledger.plans.incremental import merge_fact_claims_from
    c = ctx.raw.claims().orderBy("CLAIM_ID").limit(1)
    moved = c.withColumn("LOSS_CAUSE", F.lit("METEORITE")).select("*", F.lit("INSERT").alias("action"), F.lit(1).cast("long").alias("seq"))
    top = ctx.star.dim_loss_cause().agg(F.max("LOSS_CAUSE_KEY")).first()[0]
    out = merge_fact_claims_from(ctx, moved)
    assert out.where(F.col("CLAIM_KEY") == c.first()["CLAIM_ID"]).first()["LOSS_CAUSE_KEY"] == top + 1


def test_unseen_city_gets_a_new_geography_key(ctx):
    from pyspark.sql import functions as F
    from lossledger.plans.incremental import merge_fact_claims_from
    c = ctx.raw.claims().orderBy("CLAIM_ID").limit(1)
    moved = c.withColumn("CLAIM_CITY", F.lit("NEW CITY")).select("*", F.lit("INSERT").alias("action"),
                                                                 F.lit(1).cast("long").alias("seq"))
    max_key = ctx.star.dim_geography().agg(F.max("GEOGRAPHY_KEY")).first()[0]
    out = merge_fact_claims_from(ctx, moved)
    cid = c.first()["CLAIM_ID"]
    row = out.where(F.col("CLAIM_KEY") == cid).first()
    assert row["GEOGRAPHY_KEY"] == max_key + 1
    assert out.count() == ctx.star.fact_claims().count()


def test_merge_dim_weather(ctx):
    from decimal import Decimal
    from pyspark.sql import functions as F
    from lossledger.plans.incremental import merge_dim_weather_from
    cat = ctx.raw.catastrophe()
    grown = cat.where("CATASTROPHE_ID = 14").withColumn(
        "ESTIMATED_INDUSTRY_LOSS", F.lit(Decimal("26000000000.00")).cast("decimal(15,2)"))
    new = cat.where("CATASTROPHE_ID = 15").withColumn("CATASTROPHE_ID", F.lit(16)).withColumn(
        "EVENT_TYPE", F.lit("Derecho"))
    feed = grown.unionByName(new).select("*", F.lit("INSERT").alias("action"), F.lit(1).cast("long").alias("seq"))
    out = {r["WEATHER_EVENT_KEY"]: r for r in merge_dim_weather_from(ctx, feed).collect()}
    assert len(out) == 16
    assert out[14]["EVENT_SEVERITY_TIER"] == "Catastrophic"
    assert out[16]["PRIMARY_WEATHER_DRIVER"] == "Wind/Hail"
    strict = {r["WEATHER_EVENT_KEY"]: r for r in merge_dim_weather_from(ctx, feed, strict_reference=True).collect()}
    assert strict[14]["EVENT_SEVERITY_TIER"] == "Catastrophic"


def test_expense_retry_for_missing_claim(ctx):
    from pyspark.sql import functions as F
    from lossledger.plans.incremental import merge_fact_expense_from
    e = ctx.raw.claims_expense().orderBy("EXPENSE_ID").limit(1)
    orphan = e.withColumn("CLAIM_ID", F.lit(-1).cast("long")).withColumn("EXPENSE_ID", F.lit(-10).cast("long"))
    feed = orphan.select("*", F.lit("INSERT").alias("action"), F.lit(1).cast("long").alias("seq"))
    merged, retry = merge_fact_expense_from(ctx, feed)
    assert retry.count() == 1
    assert merged.count() == ctx.star.fact_claim_expense().count()
