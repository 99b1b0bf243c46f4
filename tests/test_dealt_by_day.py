"""The claims fact is dealt to its files by days without computing its joins twice; payments need three sums of four."""

import datetime as dt

from pyspark.sql import functions as F

from lossledger.context import Context
from lossledger.plans import star
from lossledger.warehouse import query_context

SMALL = "/root/testdata/sf0.001"


def claims_of(spark, days):
    rows = [(k, None if d is None else dt.date(2001, 1, 1) + dt.timedelta(d)) for k, d in enumerate(days)]
    return spark.createDataFrame(rows, "CLAIM_KEY long, LOSS_DATE date")


def test_rows_are_computed_once_and_each_file_covers_neighbouring_days(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(star, "FILE_ROWS", 100)
    monkeypatch.setattr(star, "LEAST_ROWS", 100)
    days = [None] * 30 + [0] * 350 + [k // 7 for k in range(700)] + [400]
    claims = claims_of(spark, days)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    fact = claims.withColumnRenamed("LOSS_DATE", "DATE_KEY").mapInArrow(counted, "CLAIM_KEY long, DATE_KEY date")
    out = f"{tmp_path}/fact"
    star.by_days_of(claims)(fact).write.parquet(out)
    assert seen.value == len(days)  # a range partitioning computes its rows once more, for a sample
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, claims.collect()), key=str)
    files = got.groupBy(F.input_file_name()).agg(F.min("DATE_KEY").alias("a"), F.max("DATE_KEY").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert len(files) == 11 and max(r["n"] for r in files) <= 200
    spans = sorted((r["a"], r["b"]) for r in files if r["a"])
    assert all(a[1] <= b[0] or a == b or a[0] == a[1] for a, b in zip(spans, spans[1:]))
    assert sum(a <= dt.date(2001, 1, 1) <= b for a, b in spans) >= 4  # the busy day is split


def test_no_claims_and_only_null_days(spark):
    for days in ([], [None] * 5):
        claims = claims_of(spark, days)
        fact = claims.withColumnRenamed("LOSS_DATE", "DATE_KEY")
        assert star.by_days_of(claims)(fact).count() == len(days)


def test_the_written_fact_is_not_sampled_and_equals_the_lazy_one(spark):
    fact = query_context(spark, SMALL).star.fact_claims()
    lazy = Context(spark, SMALL).star.fact_claims()
    assert fact.columns == lazy.columns and fact.exceptAll(lazy).isEmpty() and lazy.exceptAll(fact).isEmpty()


def test_three_sums_of_the_line_items_are_shuffled(spark):
    raw = Context(spark, SMALL).raw
    plan = raw.financial_data()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sum(") == 3
    paid = raw.financial_data().where("PAID_AMOUNT <> 0").select("CLAIM_ID", F.col("PAID_AMOUNT").alias("paid"))
    ext, disc = F.col("l_extendedprice").cast("decimal(15,2)"), F.col("l_discount").cast("decimal(4,2)")
    by_hand = Context(spark, SMALL).table("lineitem").groupBy("l_orderkey").agg(
        F.sum(ext * (1 - disc)).cast("decimal(15,2)").alias("net"))
    assert paid.join(by_hand, F.col("CLAIM_ID") == F.col("l_orderkey")).where("paid <> net").isEmpty() and not paid.isEmpty()
