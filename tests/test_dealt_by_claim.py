"""Tables dealt by claim: their joins by claim move nothing, and a merge by another key moves keys alone."""

import importlib
import shutil

import pytest
from pyspark.sql import functions as F

from lossledger import warehouse
from lossledger.context import Context
from lossledger.plans import incremental as I
from tests.conftest import SMALL

U = importlib.import_module("lossledger.operators.upsert")  # the package names its function so, too


@pytest.fixture
def dealt(spark, tmp_path, monkeypatch):
    """A Context of an input that no query has read, dealt as a large one is, with no side small enough to broadcast."""
    monkeypatch.setattr(warehouse, "DEALT_FROM", 0)
    shutil.copytree(SMALL, tmp_path / "given")
    for limit in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(limit, "-1")
    yield warehouse.query_context(spark, str(tmp_path / "given"))
    for limit in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.unset(limit)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b.select(*a.columns)).isEmpty()


def test_only_a_large_input_is_dealt(spark, monkeypatch):
    assert warehouse.query_context(spark, SMALL).buckets is None
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert warehouse.buckets_for(spark, warehouse.DEALT_FROM) == partitions
    assert warehouse.buckets_for(spark, 10 * partitions * warehouse.BUCKET) == 10 * partitions


def test_dealt_tables_hold_the_same_rows_in_a_file_per_bucket(spark, dealt):
    import glob
    lazy = Context(spark, SMALL)
    for name in ("CLAIMS", "CLAIMS_EXPENSE", "FINANCIAL_DATA"):
        table = dealt.raw.by_name(name)
        assert same(table, lazy.raw.by_name(name))
        stored = "CLAIMS_BASE" if name == "CLAIMS" else name
        assert len(glob.glob(f"{dealt.raw_dir.removeprefix('file:')}/{stored}/*.parquet")) <= dealt.buckets
    met = dealt.raw.claims().join(dealt.raw.financial_data(), "CLAIM_ID").join(dealt.raw.claims_expense(), "CLAIM_ID")
    assert "Exchange" not in plan_of(met)
    assert same(dealt.star.fact_claims(), lazy.star.fact_claims()) and same(dealt.star.fact_claim_expense(), lazy.star.fact_claim_expense())


def test_placed_gives_what_upsert_gives(spark, monkeypatch):
    t = spark.createDataFrame([(k, k // 3, f"v{k}", None if k % 2 else 5) for k in range(20)], "k long, p long, v string, a long")
    rows = [(3, 1, "new", "INSERT", 7), (4, 9, "moved", "INSERT", 7), (5, 1, None, "INSERT", 7), (6, 2, "late", "INSERT", 4), (7, 2, "first", "INSERT", 4),
            (40, 1, "added", "INSERT", 1), (None, 1, "no key", "INSERT", 1)]
    ch = spark.createDataFrame(rows, "k long, p long, v string, action string, a long").withColumn("seq", F.col("a"))
    found = lambda df: sorted(map(repr, df.select("k", "p", "v", "a").collect()))
    for applied in (None, "a"):
        want = found(U.upsert(t, ch, ["k"], applied_col=applied))
        assert found(U.placed(t, ch, ["k"], ["k"], applied_col=applied)) == want
        for crowd in (1000, 1):  # by lists per place, and by place and key
            monkeypatch.setattr(U, "CROWD", crowd)
            assert found(U.placed(t, ch, ["k"], ["p"], applied_col=applied)) == want
            assert found(U.placed(t, ch, ["k"], ["p"], buckets=4, applied_col=applied)) == want


def test_expense_merge_moves_keys_and_not_the_fact(dealt):
    """The lines in the plan of the merge meet their claims, and leave, where they lie; before, all were dealt by line."""
    merged = I.merge_fact_expense(dealt)
    plan = plan_of(merged)
    assert "FullOuter" not in plan and "EXPENSE_KEY" not in "".join(line for line in plan.split("\n") if "Exchange" in line), plan
    assert same(merged, I.merge_fact_expense(Context(dealt.spark, SMALL)))
    lines = f"{dealt.star_dir}/FACT_CLAIM_EXPENSE"
    assert not dealt.store.has(lines)
    dealt.star.fact_claim_expense()  # the same over the written fact
    assert same(I.merge_fact_expense(dealt), merged)


def test_dealt_runs_are_merged_where_they_lie(spark):
    """Cases of a run table that is dealt by another column than its key, and read by a session that knows no buckets."""
    from lossledger.shared import forget_table, shared_dir
    from lossledger.streaming.cdc import RunTable
    t = RunTable(spark, shared_dir(spark, "cases") + "/t", ["k"], apply_deletes=True, place=["p"], buckets=4)
    t.create(spark.createDataFrame([(k, k // 3, 0) for k in range(12)], "k long, p long, v long"))
    change = lambda *rows: spark.createDataFrame(list(rows), "k long, p long, v long, action string, seq long")
    state = lambda: {r["k"]: (r["p"], r["v"]) for r in t.read().collect()}
    t.merge(change(*[(k, k // 3, None, "DELETE", 1) for k in (3, 5, 7, 11)]), 0)
    assert set(state()) == {0, 1, 2, 4, 6, 8, 9, 10}
    t.merge(change((1, 3, 8, "INSERT", 8), (1, 3, 9, "INSERT", 9), (20, 3, 1, "INSERT", 1)), 1)  # another place, and a new key
    assert state()[1] == (3, 9) and state()[20] == (3, 1) and len(state()) == 9
    for _ in range(2):                                                                     # late, and again
        t.merge(change((1, 0, 2, "INSERT", 2), (2, 0, 5, "INSERT", 2)), 2)
        assert state()[1] == (3, 9) and state()[2] == (0, 5) and len(state()) == 9
    change((0, 0, 77, "INSERT", 99)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{t.path}/run-4")
    assert state()[0] == (0, 0)                                                            # a write that broke off
    forget_table(spark, f"{t.path}/run-3")
    t.merge(change((5, 2, 6, "INSERT", 7), (3, 1, 4, "INSERT", 0)), 3)
    t.keep(1)
    assert state()[5] == (2, 6) and 3 not in state() and state()[1] == (3, 9) and len(state()) == 10


def test_streams_shuffle_keys_and_changes_but_no_fact(dealt, monkeypatch):
    """No merge of a run, and no batch, moves the rows of a fact; before, each merge shuffled its whole table. The result is that of the batch MERGEs."""
    from lossledger.streaming import cdc
    from lossledger.streaming.pipeline import run_incremental
    plans = {}
    write = cdc.write_dealt

    def seen(df, path, *args, **kwargs):
        if "FACT_" in path:
            plans["/".join(path.rsplit("/", 2)[-2:])] = plan_of(df)
        return write(df, path, *args, **kwargs)

    monkeypatch.setattr(cdc, "write_dealt", seen)
    out = run_incremental(dealt)
    lazy = Context(dealt.spark, SMALL)
    assert same(out["FACT_CLAIMS"].read(), I.merge_fact_claims(lazy))
    # its claims had closed by then, which no column of an expense line shows
    assert same(out["FACT_CLAIM_EXPENSE"].read(), I.merge_fact_expense(lazy))
    assert set(plans) == {"FACT_CLAIMS/run-0", "FACT_CLAIMS/run-1", "FACT_CLAIMS/run-2", "FACT_CLAIM_EXPENSE/run-0", "FACT_CLAIM_EXPENSE/run-1"}
    assert "Exchange" not in plans["FACT_CLAIM_EXPENSE/run-0"]
    for run in ("FACT_CLAIMS/run-1", "FACT_CLAIMS/run-2", "FACT_CLAIM_EXPENSE/run-1"):
        moved = [line for line in plans[run].split("\n") if "Exchange" in line]
        assert moved and all("hashpartitioning(_h_" in line for line in moved), plans[run]  # the keys found alone
    for store in (dealt.store.has(f"{dealt.star_dir}/{t}") for t in ("FACT_CLAIMS", "FACT_CLAIM_EXPENSE")):
        assert not store  # not dealt by day first, to be dealt by claim again


def test_feeds_are_made_in_one_scan_and_are_the_same(ctx):
    c, e = ctx.raw.claims(), ctx.raw.claims_expense()
    of = lambda status: c.where(F.col("CLAIM_STATUS") == status)
    closed = of("Open").withColumns({"CLAIM_STATUS": F.lit("Closed"), "CLOSE_DATE": F.lit(ctx.as_of), "LAST_ACTIVITY_DATE": F.lit(ctx.as_of)})
    stage = lambda status, to: of(status).withColumn("CLAIM_STAGE", F.lit(to).cast("string"))
    parts = [(of("Open"), "DELETE", 0), (closed, "INSERT", 1), (of("Stalled"), "DELETE", 0), (stage("Stalled", "Negotiation"), "INSERT", 1),
             (stage("Stalled", "Negotiation"), "DELETE", 2), (stage("Stalled", "Settlement Review"), "INSERT", 3), (of("Pending Review"), "DELETE", 0),
             (stage("Pending Review", None), "INSERT", 1), (of("Rejected"), "DELETE", 0)]
    want = None
    for df, action, step in parts:
        df = I._change(df, action, "CLAIM_ID", step)
        want = df if want is None else want.unionByName(df)
    feed = I.claim_change_feed(ctx)
    assert feed.dtypes == want.dtypes and same(feed, want)
    legal = e.where("EXPENSE_CATEGORY = 'Legal'")
    billed = legal.withColumn("LEGAL_FEES", (F.col("LEGAL_FEES") + 250).cast("decimal(12,2)"))
    want = I._change(legal, "DELETE", "EXPENSE_ID", 0).unionByName(I._change(billed, "INSERT", "EXPENSE_ID", 1))
    feed = I.expense_change_feed(ctx)
    assert feed.dtypes == want.dtypes and same(feed, want)
    assert all(f._jdf.queryExecution().optimizedPlan().toString().count("orders.parquet") <= 1 and "Union" not in plan_of(f)
               for f in (I.claim_change_feed(ctx), I.expense_change_feed(ctx)))
