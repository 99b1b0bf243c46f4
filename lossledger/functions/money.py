"""Money and ratio arithmetic that rounds exactly.

Money is carried as DECIMAL(15,2) (cast before any arithmetic: the driver's
tables hold doubles, whose sums depend on order). Averages and percentages
are computed as a decimal quotient and rounded half away from zero to `k`
places, then typed DECIMAL(38,k), so the value does not depend on the
engine's double rounding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(15,2)"


def money(c, precision: int = 15, scale: int = 2) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(f"decimal({precision},{scale})")


def sum_money(c) -> Column:
    """SUM of a money column, NULL-safe to 0, typed DECIMAL(38,2)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,2)")


def round_div(num: Column, den: Column, k: int) -> Column:
    """ROUND(num / den, k) as DECIMAL(38,k); NULL when den is 0 or NULL.

    Both sides are widened to decimals first (numerator up to 4, denominator
    up to 2 fractional digits), so the quotient is an exact decimal with at
    least 10 fractional digits, not a double, before the final
    half-away-from-zero rounding."""
    q = F.try_divide(num.cast("decimal(30,4)"), den.cast("decimal(22,2)"))
    return F.round(q, k).cast(f"decimal(38,{k})")


def count_if(cond: Column) -> Column:
    """COUNT of rows where cond is true, as BIGINT (0 over no rows)."""
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def avg_round(c, k: int) -> Column:
    """AVG(c) rounded to k places, as DECIMAL(38,k) (NULLs ignored)."""
    c = F.col(c) if isinstance(c, str) else c
    return round_div(F.sum(c), F.count(c), k)


def pct(part: Column, whole: Column, k: int) -> Column:
    """ROUND(part * 100 / whole, k) as DECIMAL(38,k)."""
    return round_div(part.cast("decimal(26,4)") * F.lit(100), whole, k)
