"""Quarantine: declared rules over a table, and the reasons why a row fails them.

Rules on a row alone (`not_null`, `domain`, `within`, `ordered`) are columns
of one expression, evaluated in the scan. Rules about keys (`unique`,
`refers_to`) first count rows per key, map-side, and keep the bad keys only;
those are written, so a small set is broadcast to the scan and a large one is
sort-merge joined. A NULL breaks no rule but `not_null`: a key with a NULL part
is neither a duplicate nor an orphan.

`judged` gives every row an array REASONS with the names of the rules it
breaks, in the order of the rules; `split` takes the table apart by it, so
kept and quarantined rows together are the table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossledger.shared import written

REASONS = "REASONS"


@dataclass(frozen=True)
class Rule:
    name: str
    broken: Column | None = None           # true where a row alone breaks the rule
    key: tuple[str, ...] = ()
    parent: DataFrame | None = None        # for references: the parent's key columns, in the key's order


def not_null(name: str, col: str) -> Rule:
    return Rule(name, F.col(col).isNull())


def domain(name: str, col: str, values: list) -> Rule:
    return Rule(name, ~F.col(col).isin(values))


def within(name: str, col: str, low=None, high=None) -> Rule:
    """low <= col <= high; a bound of None is open."""
    parts = [F.col(col) < F.lit(low)] * (low is not None) + [F.col(col) > F.lit(high)] * (high is not None)
    return Rule(name, reduce(lambda a, b: a | b, parts))


def ordered(name: str, first: str, second: str) -> Rule:
    """`first` does not come after `second`."""
    return Rule(name, F.col(first) > F.col(second))


def unique(name: str, *key: str) -> Rule:
    return Rule(name, key=key)


def refers_to(name: str, key: str | tuple[str, ...], parent: DataFrame) -> Rule:
    return Rule(name, key=(key,) if isinstance(key, str) else tuple(key), parent=parent)


def bad_keys(df: DataFrame, rule: Rule) -> DataFrame:
    """The distinct keys, without NULL parts, that break a rule about keys, as _k0, _k1, ..."""
    names = [f"_k{i}" for i in range(len(rule.key))]
    keys = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rule.key, names, strict=True)]).dropna()
    if rule.parent is None:
        return keys.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*names)
    return keys.distinct().join(rule.parent.toDF(*names), names, "left_anti")


def judged(df: DataFrame, rules: list[Rule]) -> DataFrame:
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("two rules have one name")
    out, flags = df, {}
    for i, rule in enumerate(rules):
        if not rule.key:
            flags[rule.name] = rule.broken
            continue
        bad = written(bad_keys(df, rule), "bad-keys").withColumn(f"_bad{i}", F.lit(True))
        bad = bad.toDF(*[f"_b{i}_{n}" for n in range(len(rule.key))], f"_bad{i}")
        out = out.join(bad, reduce(and_, [F.col(f"`{c}`") == F.col(f"_b{i}_{n}") for n, c in enumerate(rule.key)]), "left")
        flags[rule.name] = F.col(f"_bad{i}")
    reasons = F.array_compact(F.array(*[F.when(flags[r.name], F.lit(r.name)) for r in rules]))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], reasons.alias(REASONS))


def split(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(kept rows, quarantined rows with REASONS). The bad keys are written once and all else is decided per row, so
    both parts fit each other wherever `df` reads the same rows twice; a reader takes the columns it needs along."""
    rows = judged(df, rules)
    return rows.where(F.size(REASONS) == 0).drop(REASONS), rows.where(F.size(REASONS) > 0)


def counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Per rule its rows; QUARANTINED and KEPT have the rows with and without any reason."""
    one = judged(df, rules).select(F.explode(F.when(F.size(REASONS) == 0, F.array(F.lit("KEPT"))).otherwise(
        F.concat(REASONS, F.array(F.lit("QUARANTINED"))))).alias("RULE"))
    found = one.groupBy("RULE").agg(F.count(F.lit(1)).alias("N"))
    names = df.sparkSession.createDataFrame([(r.name,) for r in rules] + [("QUARANTINED",), ("KEPT",)], "RULE string")
    return names.join(found, "RULE", "left").select("RULE", F.coalesce("N", F.lit(0)).cast("long").alias("ROWS"))
