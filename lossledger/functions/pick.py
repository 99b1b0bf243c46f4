"""Pick a value from a fixed list by a 0-based integer index column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pick(values, index: Column) -> Column:
    """`values[index]` as a column; the list becomes a constant-folded array
    literal, so the lookup stays inside whole-stage codegen."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def pick_sql(values, index_sql: str) -> str:
    """The same lookup in DuckDB SQL (lists are 1-based there too)."""
    return "[" + ", ".join(_sql_lit(v) for v in values) + f"][({index_sql}) + 1]"


def sql_values(rows) -> str:
    """Rows as a SQL VALUES list."""
    return ", ".join("(" + ", ".join(_sql_lit(v) for v in r) + ")" for r in rows)
