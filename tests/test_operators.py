"""Operators on small hand-made inputs (the fixture cases of the spec)."""

import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lossledger.operators import profile as P
from lossledger.operators.keys import sequential_key
from lossledger.operators.latest import latest_per_key
from lossledger.operators.upsert import net_changes, upsert


def test_sequential_key_equals_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), (F.col("id") % 13).alias("g"))
    df = df.select(F.col("k").cast("string").alias("a"), "g").distinct()
    got = sequential_key(df, ["a", "g"], "key", num_partitions=7)
    want = df.withColumn("key", F.row_number().over(Window.orderBy("a", "g")).cast("long"))
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_sequential_key_nulls_first(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "x string")
    rows = {r["x"]: r["k"] for r in sequential_key(df, ["x"], "k", 2).collect()}
    assert rows == {None: 1, "a": 2, "b": 3}


def test_latest_per_key_tie_break(spark):
    df = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "b"), (1, 4, 9, "c"), (2, 1, 1, "d")],
                               "k int, t int, id int, v string")
    out = {r["k"]: r["v"] for r in latest_per_key(df, ["k"], ["t", "id"]).collect()}
    assert out == {1: "b", 2: "d"}


def _target(spark):
    return spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "k int, s string, n int")


def _changes(spark, rows):
    return spark.createDataFrame(rows, "k int, s string, n int, action string, seq long")


def test_upsert_cases(spark):
    t = _target(spark)
    ch = _changes(spark, [
        (4, "new", 40, "INSERT", 1),                                  # new key
        (1, "a", 10, "DELETE", 2), (1, "a2", 11, "INSERT", 3),        # update
        (2, "b1", 21, "INSERT", 4), (2, "b2", 22, "INSERT", 5),       # two changes in one batch
        (3, None, 30, "INSERT", 6),                                   # change to NULL wins
    ])
    out = {r["k"]: (r["s"], r["n"]) for r in upsert(t, ch, ["k"]).collect()}
    assert out == {1: ("a2", 11), 2: ("b2", 22), 3: (None, 30), 4: ("new", 40)}


def test_upsert_update_columns_and_deletes(spark):
    t = _target(spark)
    ch = _changes(spark, [(1, "x", 99, "INSERT", 1), (2, "b", 20, "DELETE", 2)])
    only_n = {r["k"]: (r["s"], r["n"]) for r in upsert(t, ch, ["k"], ["n"]).collect()}
    assert only_n[1] == ("a", 99) and only_n[2] == ("b", 20)          # delete ignored by default
    gone = {r["k"] for r in upsert(t, ch, ["k"], apply_deletes=True).collect()}
    assert gone == {1, 3}


def test_upsert_replay_is_idempotent(spark):
    t = _target(spark)
    ch = _changes(spark, [(1, "z", 1, "INSERT", 1)])
    once = upsert(t, ch, ["k"])
    twice = upsert(once, ch, ["k"])
    assert sorted(once.collect()) == sorted(twice.collect())
    assert net_changes(ch.unionByName(ch), ["k"]).count() == 1


def test_profiles_edge_cases(spark):
    df = spark.createDataFrame([(None, 5, Decimal("1.00"), "x"), (None, 5, Decimal("2.50"), None),
                                (None, 5, Decimal("9.99"), "x")],
                               "`all null` int, const int, amt decimal(15,2), `weird name` string")
    nulls = {r["COLUMN_NAME"]: (r["NULLS"], r["NULL_PCT"]) for r in P.null_profile(df).collect()}
    assert nulls["all null"] == (3, Decimal("100.0")) and nulls["weird name"] == (1, Decimal("33.3"))
    prof = {r["COLUMN_NAME"]: r for r in P.numeric_profile(df).collect()}
    assert prof["const"]["DISTINCT_COUNT"] == 1 and prof["all null"]["MIN_VALUE"] is None
    h = P.numeric_histogram(df, "const").collect()
    assert [(r["BIN"], r["COUNT"]) for r in h] == [(0, 3)]
    h2 = {r["BIN"]: r["COUNT"] for r in P.numeric_histogram(df, "amt", bins=3).collect()}
    assert h2 == {0: 2, 2: 1}
    assert P.category_top_n(df, "weird name").collect()[0]["COUNT"] == 2
    empty = df.where("false")
    assert P.null_profile(empty).where("NULLS = 0").count() == 4
    assert P.numeric_histogram(empty, "amt").count() == 0
    inv = P.table_inventory({"t": df}).first()
    assert (inv["ROW_COUNT"], inv["COLUMN_COUNT"], inv["NUMERIC_COLUMNS"]) == (3, 4, 3)


def test_money_rounding_is_exact(spark):
    from lossledger.functions.money import avg_round, pct
    df = spark.createDataFrame([(Decimal("0.01"),), (Decimal("0.02"),)], "x decimal(15,2)")
    # 0.015 rounds half away from zero to 0.02 (a double average would give 0.01 or 0.02 by luck)
    assert df.agg(avg_round("x", 2)).first()[0] == Decimal("0.02")
    assert df.agg(pct(F.lit(1), F.lit(8), 1)).first()[0] == Decimal("12.5")
    assert df.select(pct(F.lit(1), F.lit(0), 1)).first()[0] is None


def test_extend_keys(spark):
    from lossledger.operators.keys import extend_keys
    dim = spark.createDataFrame([("a", 1), ("c", 2)], "x string, k long")
    cand = spark.createDataFrame([("a",), ("b",), ("d",), ("b",), (None,)], "x string")
    got = {r["x"]: r["k"] for r in extend_keys(dim, cand, ["x"], "k").collect()}
    assert got == {None: 3, "b": 4, "d": 5}
    again = dim.unionByName(extend_keys(dim, cand, ["x"], "k"))
    assert extend_keys(again, cand, ["x"], "k").count() == 0


@pytest.mark.parametrize("parts", [4, 8, 16])
@pytest.mark.parametrize("reuse", ["true", "false"])
def test_sequential_key_with_payload(spark, parts, reuse):
    """Columns that the counting side does not need must not let the two sides see different ranges."""
    conf = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.exchange.reuse": reuse}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
        got = sequential_key(orders, ["o_orderkey"], "key").select("o_orderkey", "o_comment" if "o_comment" in orders.columns else "o_totalprice", "key")
        rows = sorted((r[0], r[2]) for r in got.collect())
        assert [k for _, k in rows] == list(range(1, orders.count() + 1))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_upsert_does_not_shuffle_the_target(spark, tmp_path):
    from lossledger.operators.upsert import upsert
    path = str(tmp_path / "target")
    spark.range(2_000_000).withColumn("v", F.col("id") * 2).write.parquet(path)
    target = spark.read.parquet(path)
    feed = spark.createDataFrame([(5, 0, "INSERT", 1), (2_000_001, 7, "INSERT", 2), (6, None, "INSERT", 3)],
                                 "id long, v long, action string, seq long")
    out = upsert(target, feed, ["id"])
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Both joins that read the target broadcast the changes; what is shuffled is the matched keys, no more than the changes.
    assert "FullOuter" not in plan
    for kind in ("LeftOuter", "LeftSemi"):
        assert re.search(rf"BroadcastHashJoin[^\n]*{kind}", plan) and not re.search(rf"SortMergeJoin[^\n]*{kind}", plan)
    got = {r["id"]: r["v"] for r in out.where("id in (5, 6, 7, 2000001)").collect()}
    assert got == {5: 0, 6: None, 7: 14, 2_000_001: 7} and out.count() == 2_000_001


def test_replaced_gives_what_upsert_gives(spark):
    from lossledger.operators.upsert import replaced
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "k long, v string")
    ch = spark.createDataFrame([(1, "x", "INSERT", 1), (1, None, "INSERT", 2), (2, "y", "INSERT", 1), (2, "y", "DELETE", 2),
                                (4, "z", "INSERT", 1), (5, "w", "DELETE", 1), (None, "n", "INSERT", 1)], "k long, v string, action string, seq long")
    rows = lambda df: sorted(map(repr, df.collect()))
    for deletes in (False, True):
        assert rows(replaced(t, ch, ["k"], deletes)) == rows(upsert(t, ch, ["k"], apply_deletes=deletes))


def test_merged_once_gives_what_upsert_gives(spark):
    from lossledger.operators.upsert import merged_once
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "k long, v string")
    ch = spark.createDataFrame([(1, "x", "INSERT", 1), (1, None, "INSERT", 2), (2, "y", "INSERT", 1), (2, "y", "DELETE", 2),
                                (4, "z", "INSERT", 1), (5, "w", "DELETE", 1), (None, "n", "INSERT", 1)], "k long, v string, action string, seq long")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(merged_once(t, ch, ["k"])) == rows(upsert(t, ch, ["k"]))


def test_two_merges_shuffle_the_wide_fact_once(spark):
    """No merge writes the whole fact: both anti joins stand over one scan of its columns."""
    from lossledger.plans.growing import fact_after_two_merges
    from lossledger.warehouse import query_context
    from tests.conftest import SMALL
    out = fact_after_two_merges(query_context(spark, SMALL))
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum("LeftAnti" in line and "Join" in line for line in plan) >= 2
    assert sum("FileScan" in line and re.search(r"[^_]CLAIM_NUMBER#", line.replace("_s_", "__")) is not None for line in plan) == 1


def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from lossledger.shared import shared_dir
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session, "x")


def test_edge_check_counts(spark):
    from lossledger.plans.quality import edge_check
    child = spark.createDataFrame([(1,)] * 50 + [(2,), (3,), (3,), (None,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (1,), (2,), (None,)], "pk int")
    row = edge_check(child, "k", parent, "pk").collect()
    assert [tuple(r) for r in row] == [(53, 2, 2)]          # hot key 1; key 3 is an orphan twice
    empty = edge_check(child.where("false"), "k", parent, "pk").collect()
    assert [tuple(r) for r in empty] == [(0, 0, 0)]


def test_profiles_keep_each_type(spark):
    df = spark.createDataFrame([(0.001, 9_000_000_000_000_000_000, Decimal("0.0001")), (0.002, -9_000_000_000_000_000_000, Decimal("0.0002")),
                                (0.004, 5, Decimal("0.0002")), (None, None, None)], "d double, l long, m decimal(20,4)")
    got = {r["COLUMN_NAME"]: r for r in P.numeric_profile(df).collect()}
    assert [got[c]["DISTINCT_COUNT"] for c in ("d", "l", "m")] == [3, 3, 2]
    assert got["d"]["MIN_VALUE"] == Decimal("0.001") and got["l"]["MAX_VALUE"] == 9_000_000_000_000_000_000
    approx = {r["COLUMN_NAME"]: r["DISTINCT_COUNT"] for r in P.numeric_profile(df, distinct="approx").collect()}
    assert approx == {"d": 3, "l": 3, "m": 2}
    bins = lambda c: {r["BIN"]: r["COUNT"] for r in P.numeric_histogram(df, c, 3).collect()}
    assert bins("d") == {0: 1, 1: 1, 2: 1} and bins("l") == {0: 1, 1: 1, 2: 1} and bins("m") == {0: 1, 2: 2}


def test_required_tables_reports_a_missing_one(spark, tmp_path):
    import os

    from lossledger.context import Context
    from lossledger.plans.quality import required_tables
    for t in ("nation", "customer", "supplier", "orders", "events"):  # no lineitem
        os.symlink(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    got = {r["TABLE_NAME"]: r for r in required_tables(Context(spark, str(tmp_path))).collect()}
    missing = {t for t, r in got.items() if not r["FOUND"]}
    assert missing and missing < set(got) and all(got[t]["ROW_COUNT"] is None for t in missing)


def test_edge_checks_scan_the_child_once(spark, tmp_path):
    from lossledger.plans.quality import edge_checks
    path = str(tmp_path / "child")
    spark.createDataFrame([(1, 5), (2, 6), (None, 7)], "a int, b int").write.parquet(path)
    parent = spark.createDataFrame([(1,), (5,), (6,)], "k int")
    out = edge_checks(spark.read.parquet(path), [("a", parent, "k"), ("b", parent, "k")])
    assert sorted(map(tuple, out.collect())) == [("a", 2, 1, 1), ("b", 3, 0, 1)]
    assert len(re.findall(r"Relation \[.*\] parquet", out._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_outlook_has_forecasts_and_normals(spark):
    """Days without a forecast come from the normals; together 90 days for each state, and every step of the ladder."""
    from lossledger.context import Context
    from lossledger.plans.outlook import weather_outlook
    out = weather_outlook(Context(spark, "/root/testdata/sf0.01")).cache()
    by = {r[0]: r[1] for r in out.groupBy("DATA_SOURCE").count().collect()}
    assert by["FORECAST"] > 0 and by["CLIMATOLOGY"] > 0
    assert {r[1] for r in out.groupBy("CLAIM_STATE").agg(F.count_distinct("FORECAST_DATE")).collect()} == {90}
    kinds = {r[0] for r in out.where("DATA_SOURCE = 'FORECAST'").select("WEATHER_CONDITION").distinct().collect()}
    assert {"Heavy Rain", "Clear/Dry"} <= kinds


def test_numeric_profile_tells_values_apart_as_numbers(spark):
    """Distinct values are held as 64-bit numbers, as text only where those are too few."""
    from lossledger.operators import profile
    df = spark.sql("SELECT * FROM VALUES (1L, 1.10BD, 2, CAST(12345678901234567890.5 AS DECIMAL(30,4)), 0.0D), (-1L, -1.10BD, NULL, CAST(12345678901234567890.6 AS DECIMAL(30,4)), -0.0D),"
                   " (9223372036854775807L, 1.11BD, 2, NULL, 1.5D) AS t(a, b, c, d, e)")
    got = {r["COLUMN_NAME"]: r["DISTINCT_COUNT"] for r in profile.numeric_profile(df).select("COLUMN_NAME", "DISTINCT_COUNT").collect()}
    assert got == {"a": 3, "b": 3, "c": 1, "d": 2, "e": 2}
    plan = profile.numeric_profile(df.select("a", "b", "c"))._jdf.queryExecution().optimizedPlan().toString()
    assert "as string" not in plan
