"""Spark-vs-DuckDB comparison used by the oracle tests."""

import datetime as dt
import decimal

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return v.normalize()
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _key(row):
    return tuple((x is None, type(x).__name__ if x is not None else "", str(x)) for x in row)


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    """None when equal (columns by name, rows order-insensitive, exact values)."""
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns differ: {sorted(spark_cols)} vs {sorted(duck_cols)}"
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    a = sorted((tuple(_norm(r[i]) for i in si) for r in spark_rows), key=_key)
    b = sorted((tuple(_norm(r[i]) for i in di) for r in duck_rows), key=_key)
    if len(a) != len(b):
        return f"row count {len(a)} vs {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"first difference: {[(order[i], x[i], y[i]) for i in range(len(order)) if x[i] != y[i]][:5]}"
    return None
