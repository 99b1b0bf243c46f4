"""Quarantine, typed ingestion, sketches, storage inventory, lineage checksums and change propagation on small cases."""

import datetime as dt
import os
import re
from decimal import Decimal

from pyspark.sql import functions as F

from lossledger.operators import quarantine as Qn
from lossledger.operators.sketches import distinct_between, distinct_sketches
from lossledger.operators.typed import Field, ingest, report
from lossledger.plans import propagate as P
from lossledger.plans.intake import LINEAGE, reconciled, storage_inventory
from lossledger.shared import shared_dir, written


def table(spark):
    day = dt.date(2020, 1, 1)
    rows = [(1, "a", 5, day, day), (2, None, 50, day, dt.date(2019, 1, 1)), (2, "b", None, None, day), (None, "z", 5, day, None), (None, "z", -1, day, day), (7, "a", 5, day, day)]
    return spark.createDataFrame(rows + [(9, "a", 5, day, day)] * 500, "id long, kind string, size int, start date, end date")


def rules(spark):
    parent = spark.createDataFrame([(1,), (2,), (9,)], "p long")
    return [Qn.not_null("no kind", "kind"), Qn.domain("odd kind", "kind", ["a", "b"]), Qn.within("odd size", "size", 0, 10), Qn.ordered("ends early", "start", "end"),
            Qn.unique("twice", "id"), Qn.refers_to("orphan", "id", parent)]


def test_quarantine_reasons(spark):
    df = table(spark)
    found = sorted(((r["id"], r["kind"], r["size"], tuple(r["REASONS"])) for r in Qn.judged(df, rules(spark)).collect() if r["id"] != 9), key=str)
    assert found == sorted([(1, "a", 5, ()), (2, None, 50, ("no kind", "odd size", "ends early", "twice")), (2, "b", None, ("twice",)),
                            (None, "z", 5, ("odd kind",)), (None, "z", -1, ("odd kind", "odd size")), (7, "a", 5, ("orphan",))], key=str)
    kept, bad = Qn.split(df, rules(spark))
    assert kept.unionByName(bad.drop("REASONS")).exceptAll(df).count() == 0 and kept.count() + bad.count() == df.count() == 506
    counts = {r["RULE"]: r["ROWS"] for r in Qn.counts(df, rules(spark)).collect()}
    assert counts == {"no kind": 1, "odd kind": 2, "odd size": 2, "ends early": 1, "twice": 502, "orphan": 1, "QUARANTINED": 505, "KEPT": 1}
    assert {r["ROWS"] for r in Qn.counts(df.limit(0), rules(spark)).collect()} == {0}


def test_quarantine_with_keys_of_several_columns(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (1, None), (2, "y")], "a long, b string")
    parent = spark.createDataFrame([(1, "x")], "a long, b string")
    got = sorted(((r["a"], r["b"], tuple(r["REASONS"])) for r in Qn.judged(df, [Qn.unique("u", "a", "b"), Qn.refers_to("f", ("a", "b"), parent)]).collect()), key=str)
    assert got == sorted([(1, "x", ("u",)), (1, "x", ("u",)), (1, None, ()), (1, None, ()), (2, "y", ("f",))], key=str)


def test_typed_ingestion(spark):
    df = spark.createDataFrame([(" 1 ", "2.50", "01/02/2020", "yes"), ("x", "1e2", "2020-01-02", "maybe"), (None, "", "N/A", "-"), ("99999999999", "12345678901.00", "31/02/2020", "false")],
                               "a string, b string, c string, d string")
    fields = [Field("n", "int", "a"), Field("b", "decimal(6,2)"), Field("c", "date", format="dd/MM/yyyy"), Field("d", "boolean")]
    typed = ingest(df, fields)
    rows = [tuple(r) for r in typed.collect()]
    assert rows == [(1, Decimal("2.50"), dt.date(2020, 2, 1), True, {}), (None, Decimal("100.00"), None, None, {"n": "x", "c": "2020-01-02", "d": "maybe"}),
                    (None, None, None, None, {}), (None, None, None, False, {"n": "99999999999", "b": "12345678901.00", "c": "31/02/2020"})]
    assert [tuple(r) for r in report(typed, fields).collect()] == [("n", 4, 1, 1, 2), ("b", 4, 2, 1, 1), ("c", 4, 1, 1, 2), ("d", 4, 2, 1, 1)]


def test_sketches_add_up(spark):
    df = spark.range(60_000).select((F.col("id") % 20_011).alias("v"), F.when(F.col("id") % 2 == 0, F.lit("k")).alias("w"), (F.col("id") % 12).alias("m"))
    sketches = written(distinct_sketches(df, ["v", "w"], F.col("m")), "sketches")
    assert sketches.count() == 24
    for first, last in ((0, 11), (3, 5), (7, 7), (None, 2)):
        part = df.where(F.col("m").between(first or 0, last))
        exact = part.agg(F.count_distinct("v"), F.count_distinct("w"), F.count("w")).first()
        got = {r["COLUMN_NAME"]: r for r in distinct_between(sketches, first, last).collect()}
        assert abs(got["v"]["DISTINCT_ESTIMATE"] - exact[0]) <= 0.05 * exact[0]
        assert (got["w"]["DISTINCT_ESTIMATE"], got["w"]["ROWS"]) == (exact[1], exact[2])


def test_storage_inventory_equals_the_file_system(spark):
    base = shared_dir(spark, "storage")
    spark.range(1000).repartition(3).write.parquet(f"{base}/a")
    spark.range(10).selectExpr("id", "id AS x").coalesce(1).write.parquet(f"{base}/b")
    got = {r["TABLE_NAME"]: r for r in storage_inventory({t: spark.read.parquet(f"{base}/{t}") for t in "ab"}).collect()}
    local = base.removeprefix("file://").removeprefix("file:")
    sizes = {t: [os.path.getsize(f"{local}/{t}/{f}") for f in os.listdir(f"{local}/{t}") if f.endswith(".parquet")] for t in "ab"}
    assert {t: (r["ROW_COUNT"], r["COLUMN_COUNT"], r["FILES"], r["BYTES"]) for t, r in got.items()} == {
        "a": (1000, 1, 3, sum(sizes["a"])), "b": (10, 2, 1, sum(sizes["b"])), "TOTAL": (1010, 3, 4, sum(sizes["a"]) + sum(sizes["b"]))}
    assert got["TOTAL"]["LAST_CHANGE"] == max(got["a"]["LAST_CHANGE"], got["b"]["LAST_CHANGE"])


def test_a_planted_loss_is_found(ctx):
    """One fact lost and another doubled: the row count agrees, the checksum does not. A changed amount shows too."""
    fact = ctx.star.fact_claims()
    two = [r[0] for r in fact.where("PAID_AMOUNT > 0").select("CLAIM_KEY").orderBy("CLAIM_KEY").limit(2).collect()]
    swapped = fact.where(F.col("CLAIM_KEY") != two[0]).unionByName(fact.where(F.col("CLAIM_KEY") == two[1]))
    paid = fact.withColumn("PAID_AMOUNT", F.when(F.col("CLAIM_KEY") == two[0], F.col("PAID_AMOUNT") + 1).otherwise(F.col("PAID_AMOUNT")).cast("decimal(15,2)"))
    edges = [e for e in LINEAGE if e[2] == "FACT_CLAIMS"]
    state = lambda star: {r["RAW_TABLE"]: (r["RAW_ROWS"] == r["STAR_ROWS"], r["RECONCILED"]) for r in reconciled(edges, ctx.raw.by_name, lambda _: star).collect()}
    assert state(fact) == {"CLAIMS": (True, True), "FINANCIAL_DATA": (True, True), "LITIGATION": (True, True)}
    assert state(swapped)["CLAIMS"] == (True, False)
    assert state(paid) == {"CLAIMS": (True, True), "FINANCIAL_DATA": (True, False), "LITIGATION": (True, True)}


def test_propagation_moves_rows_and_leaves_the_target_in_place(ctx):
    """A payment that moves to another claim changes both; the policy target is scanned, not shuffled, for a small feed."""
    fin = ctx.raw.financial_data()
    one, other = [r[0] for r in fin.select("CLAIM_ID").orderBy("CLAIM_ID").limit(2).collect()]
    doubled = fin.where(F.col("CLAIM_ID") == one).withColumn("PAID_AMOUNT", (F.col("PAID_AMOUNT") + 7).cast("decimal(15,2)"))
    feed = doubled.select("*", F.lit("INSERT").alias("action"), F.lit(1).cast("long").alias("seq"))
    before, after = ({r[0]: r[1] for r in f.select("CLAIM_KEY", "PAID_AMOUNT").collect()} for f in (ctx.star.fact_claims(), P.propagate(ctx, {"FINANCIAL_DATA": feed})["FACT_CLAIMS"]))
    assert after == before | {one: before[one] + 7} and before[other] == after[other]
    moved = feed.withColumn("CLAIM_ID", F.lit(-5).cast(fin.schema["CLAIM_ID"].dataType))  # its old claim loses the payment
    left = {r[0]: r[1] for r in P.propagate(ctx, {"FINANCIAL_DATA": moved})["FACT_CLAIMS"].select("CLAIM_KEY", "PAID_AMOUNT").collect()}
    assert left == before | {one: Decimal("0.00")}
    plan = P.propagate_dim_policy(ctx)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[\S+\], \[_s_POLICY_KEY#\d+L\], LeftOuter, BuildRight", plan)


def test_propagated_expense_lines_equal_a_rebuild(ctx):
    """Claims change, lines are re-billed, one moves to another claim and one is new: as rebuilt from all lines."""
    from lossledger.operators.upsert import upsert
    from lossledger.plans.star import build_fact_expense
    e = ctx.raw.claims_expense()
    moved = F.col("EXPENSE_ID") == e.agg(F.min("EXPENSE_ID")).first()[0]
    other = F.lit(e.agg(F.max("CLAIM_ID")).first()[0])
    feed = P.expense_change_feed(ctx).unionByName(P._change(e.where(moved).withColumn("CLAIM_ID", other), "INSERT", "EXPENSE_ID", 5)) \
        .unionByName(P._change(e.where(moved).withColumn("EXPENSE_ID", F.lit(-1).cast("long")), "INSERT", "EXPENSE_ID", 1))
    feeds = {"CLAIMS": P.severity_change_feed(ctx), "CLAIMS_EXPENSE": feed, "FINANCIAL_DATA": P.all_feeds(ctx)["FINANCIAL_DATA"]}
    both = P.propagate(ctx, feeds)
    want = build_fact_expense(upsert(e, feed, ["EXPENSE_ID"]), both["FACT_CLAIMS"])
    for got in (both["FACT_CLAIM_EXPENSE"], P.propagate(ctx, feeds, ["FACT_CLAIM_EXPENSE"])["FACT_CLAIM_EXPENSE"]):
        assert got.schema.names == want.schema.names
        assert got.count() == want.count() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_policies_keep_the_names_of_insured_people_who_did_not_change(ctx):
    names = lambda df: {r[0]: r[1] for r in df.select("POLICY_KEY", "INSURED_NAME").collect()}
    before, after = names(ctx.star.dim_policy()), names(P.propagate_dim_policy(ctx))
    assert before.keys() == after.keys() and all(after[k] in (n, f"{n} (renamed)") for k, n in before.items())


def test_split_leaves_the_columns_to_the_reader(spark, ctx):
    """The judged table is not written: a report on the kept rows scans the columns it needs."""
    from lossledger.plans import intake
    plan = intake.kept_lines(ctx)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" in plan and "judged" not in plan
    assert "l_extendedprice" in plan and "l_shipdate" not in plan


def test_images_group_the_feed_once(spark):
    """Both images are read from one written copy: the feed is not grouped again for the second."""
    from lossledger.operators.deltas import images
    feed = spark.createDataFrame([(1, "a", "DELETE", 10), (1, "b", "INSERT", 11), (1, "b", "DELETE", 12), (1, "c", "INSERT", 13), (2, "x", "DELETE", 20), (3, "n", "INSERT", 31)],
                                 "id long, v string, action string, seq long")
    before, after = images(feed, ["id"])
    assert sorted(map(tuple, before.collect())) == [(1, "a")]
    assert sorted(map(tuple, after.collect())) == [(1, "c"), (3, "n")]
    for side in (before, after):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "images-" in plan and "Aggregate" not in plan
