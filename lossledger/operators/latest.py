"""Latest row per key: ROW_NUMBER() OVER (PARTITION BY keys ORDER BY t DESC) = 1.

Catalyst plans `row_number() ... = 1` as a WindowGroupLimit below the
shuffle, so each map task keeps only its local best rows per key before the
exchange. A tie-break column makes the pick deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order_desc: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order_desc])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
