"""Typed ingestion of text: every column is trimmed, its null words become NULL,
the rest is cast without failing, and values that do not fit are kept.

`ingest` gives the typed columns and RESCUED, a map from column name to the
text that could not be read. One projection: no row is lost, nothing is
shuffled, and a later run can repair the rescued values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESCUED = "RESCUED"
#: FIXED VALUES — words that stand for no value, compared without regard to case
NULL_WORDS = ["", "null", "none", "n/a", "na", "-"]


@dataclass(frozen=True)
class Field:
    name: str
    type: str                   # a Spark type, as in a DDL schema
    source: str | None = None   # the text column; the field's name if not given
    format: str | None = None   # of dates and timestamps

    def text(self) -> Column:
        raw = F.trim(F.col(f"`{self.source or self.name}`").cast("string"))
        return F.when(~F.lower(raw).isin(NULL_WORDS), raw)

    def value(self) -> Column:
        if self.format and self.type.startswith(("timestamp", "date")):
            return F.try_to_timestamp(self.text(), F.lit(self.format)).cast(self.type)
        return self.text().try_cast(self.type)


def ingest(df: DataFrame, fields: list[Field]) -> DataFrame:
    """The fields in their types, and RESCUED: the trimmed text of each that was there but could not be read."""
    failed = [F.when(f.text().isNotNull() & f.value().isNull(), F.struct(F.lit(f.name).alias("key"), f.text().alias("value"))) for f in fields]
    return df.select(*[f.value().alias(f.name) for f in fields], F.map_from_entries(F.array_compact(F.array(*failed))).alias(RESCUED))


def report(typed: DataFrame, fields: list[Field]) -> DataFrame:
    """Per field: rows, values read, missing ones, and texts that could not be read; one scan."""
    n = F.count(F.lit(1))
    a = typed.agg(n.alias("_n"), *[e for i, f in enumerate(fields) for e in (
        F.count(f"`{f.name}`").alias(f"_v{i}"), F.count(F.col(RESCUED)[f.name]).alias(f"_f{i}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(f.name).alias("COLUMN_NAME"), F.col("_n").alias("ROWS"), F.col(f"_v{i}").alias("READ"),
                                        (F.col("_n") - F.col(f"_v{i}") - F.col(f"_f{i}")).alias("MISSING"), F.col(f"_f{i}").alias("FAILED"))
                               for i, f in enumerate(fields)]))
    return a.select(rows.alias("r")).select("r.*")
