"""Layout of the written star: date-sorted fact files and filter pushdown."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests.conftest import SMALL


def test_fact_files_sorted_by_date_and_filter_pushed(spark):
    from lossledger.warehouse import warehouse_context
    ctx = warehouse_context(spark, SMALL)
    for table in ("FACT_CLAIMS", "FACT_CLAIM_EXPENSE"):
        path = f"{ctx.star_dir}/{table}"
        files = glob.glob(f"{path.removeprefix('file:')}/*.parquet")
        assert files
        for f in files:
            keys = [d for d in pq.read_table(f, columns=["DATE_KEY"]).column("DATE_KEY").to_pylist()
                    if d is not None]
            assert keys == sorted(keys), f
        df = spark.read.parquet(path).where(F.col("DATE_KEY") >= F.lit("2024-01-01").cast("date")) \
            .select("CLAIM_KEY", "DATE_KEY")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(DATE_KEY" in plan
        assert "ReadSchema: struct<CLAIM_KEY" in plan and "PAID_AMOUNT" not in plan


def test_month_filter_reads_only_that_months_files(spark, tmp_path):
    """Facts are range-partitioned by date: a month's rows lie in few files."""
    from lossledger.context import Context
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        star = str(tmp_path / "star")
        Context(spark, SMALL).star.write(star)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = []
    for f in glob.glob(f"{star}/FACT_CLAIMS/*.parquet"):
        days = [d for d in pq.read_table(f, columns=["DATE_KEY"]).column(0).to_pylist() if d]
        if days:
            spans.append((min(days), max(days)))
    spans.sort()
    assert len(spans) >= 4 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_claims_of_any_year_reach_the_reports(spark):
    """A loss outside the years of the other claims is counted: the calendar spans the data."""
    from lossledger.context import Context
    from lossledger.plans import reports

    class Shifted:
        """The driver's raw tables with one claim moved to 1987."""
        def __init__(self, ctx):
            self.real = Context(ctx.spark, ctx.sf_dir).raw

        def __getattr__(self, name):
            return getattr(self.real, name)

        def claims(self):
            c = self.real.claims()
            first = c.agg(F.min("CLAIM_ID")).first()[0]
            old = F.lit("1987-05-05").cast("date")
            return c.withColumn("LOSS_DATE", F.when(F.col("CLAIM_ID") == first, old).otherwise(F.col("LOSS_DATE")))

    ctx = Context(spark, SMALL, tables=Shifted)
    rows = {r["QUARTER"]: r["CNT"] for r in reports.quarter_severity(ctx).where("QUARTER = '1987-Q2'").collect()}
    assert sum(rows.values()) == 1
    total = reports.quarter_severity(ctx).agg(F.sum("CNT")).first()[0]
    assert total == ctx.raw.claims().where("LOSS_DATE is not null").count()


def _fresh(spark, tmp_path):
    """A Context of an input that no query of this session has read."""
    import shutil

    from lossledger.warehouse import query_context
    shutil.copytree(SMALL, tmp_path / "given")
    return query_context(spark, str(tmp_path / "given"))


def _tables(ctx):
    return sorted(p.removesuffix("/_SUCCESS").rpartition("/")[2] for part in (ctx.raw_dir, ctx.star_dir)
                  for p in glob.glob(f"{part.removeprefix('file:')}/*/_SUCCESS"))


def test_a_query_writes_only_the_tables_it_reads(spark, tmp_path):
    from lossledger.plans import intake, reports
    ctx = _fresh(spark, tmp_path)
    assert intake.cleansed_events(ctx).count() and _tables(ctx) == []
    assert reports.close_days_by_severity(ctx).count()
    assert _tables(ctx) == ["CLAIMS_BASE", "DIM_GEOGRAPHY", "DIM_LOSS_CAUSE", "FACT_CLAIMS"]


def test_tables_written_on_demand_equal_those_written_in_order(spark, tmp_path):
    from lossledger.context import Context
    from lossledger.plans.star import STAR_TABLES
    ctx = _fresh(spark, tmp_path)
    raw, star = str(tmp_path / "raw"), str(tmp_path / "star")
    Context(spark, SMALL).raw.materialize(raw)
    whole = Context(spark, SMALL, raw_dir=raw)
    whole.star.write(star)
    whole = Context(spark, SMALL, raw_dir=raw, star_dir=star)
    for get in [lambda c, n=n: c.star.by_name(n) for n in reversed(STAR_TABLES)] + [lambda c: c.raw.financial_data(), lambda c: c.raw.claims_expense()]:
        one, other = get(ctx), get(whole)
        assert one.schema == other.schema and one.count() == other.count() and one.exceptAll(other).isEmpty()


def test_expense_lines_are_shuffled_once_by_claim(spark, ctx):
    """Lines summed per order and line meet their claim where they lie: no exchange between."""
    from lossledger.plans.star import build_fact_expense
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = build_fact_expense(ctx.raw.claims_expense(), spark.createDataFrame([], ctx.star.fact_claims().schema))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2, plan


def test_propagation_writes_only_what_leads_to_its_table(spark, tmp_path):
    """No expense line is read for the claims fact, no fact for the policies; the expense fact's old state is not written to be merged once."""
    from lossledger.plans import propagate as P
    ctx = _fresh(spark, tmp_path)
    assert P.propagate_dim_policy(ctx).count() and _tables(ctx) == ["DIM_POLICY", "INSURED", "POLICY"]
    assert P.propagate_fact_claims(ctx).count()
    assert not {"CLAIMS_EXPENSE", "FACT_CLAIM_EXPENSE"} & set(_tables(ctx))
    lines = P.propagate_fact_expense(ctx)
    assert "CLAIMS_EXPENSE" in _tables(ctx) and "FACT_CLAIM_EXPENSE" not in _tables(ctx)
    ctx.star.fact_claim_expense()  # the same over the written fact
    again = P.propagate_fact_expense(ctx)
    assert lines.count() == again.count() and lines.exceptAll(again).isEmpty() and again.exceptAll(lines).isEmpty()


def test_key_check_writes_no_table_for_its_key(spark, tmp_path):
    from lossledger.plans import quality
    ctx = _fresh(spark, tmp_path)
    rows = {r["TABLE_NAME"]: r["ROWS"] for r in quality.primary_key_check(ctx).collect()}
    assert _tables(ctx) == ["CLAIMS_BASE"]
    assert rows == {t: ctx.raw.by_name(t).count() for t, _ in quality.RAW_KEYS}


def test_changed_claims_are_brought_to_their_new_state_once(ctx):
    """The fact rows, the address lookup and the dimensions' candidates read one written copy of the columns they need."""
    from lossledger.plans.incremental import merge_fact_claims_all_sources
    plan = merge_fact_claims_all_sources(ctx)._jdf.queryExecution().optimizedPlan().toString()
    assert "LOSS_DESCRIPTION" not in plan
