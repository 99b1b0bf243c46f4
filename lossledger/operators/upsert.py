"""MERGE-style upsert for parquet tables.

`upsert(target, changes, keys, update_cols)` returns the new table state:

* changes are reduced to one row per key first — the highest `seq` wins —
  so duplicate source keys never make the result ambiguous;
* by default only INSERT rows count (new rows and after-images of updates;
  a DELETE is ignored), which is what the original change-stream MERGE did;
  `apply_deletes=True` removes keys whose latest change is a DELETE;
* the changes carry an explicit matched flag, so a NULL that arrives in the
  change wins over the old value (a `coalesce` would silently keep the old one);
* matched rows take `update_cols` from the change and every other column
  from the target; new keys take every column from the change.

The target is never shuffled for a small feed. The net changes are written
once, so the planner knows their size, and the merge is three joins that can
all broadcast them: target LEFT JOIN changes for the rows that stay, target
LEFT SEMI JOIN changes for the keys that matched (no more than there are
changes), and changes LEFT ANTI JOIN those keys for the rows that are new. A
feed above Spark's broadcast threshold is sort-merge joined instead.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.operators.latest import latest_per_key
from lossledger.shared import written


def net_changes(changes: DataFrame, keys: list[str], seq_col: str = "seq", action_col: str = "action",
                apply_deletes: bool = False) -> DataFrame:
    """One row per key: the latest change (INSERTs only unless deletes apply)."""
    if not apply_deletes:
        changes = changes.where(F.col(action_col) == "INSERT")
    return latest_per_key(changes, keys, [seq_col])


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], update_cols: list[str] | None = None,
           seq_col: str = "seq", action_col: str = "action", apply_deletes: bool = False,
           applied_col: str | None = None) -> DataFrame:
    """The merged table. With `applied_col` (a column of both sides, the seq
    a row was last changed by) a change only counts where it is newer."""
    cols = target.columns
    update = set(update_cols if update_cols is not None else [c for c in cols if c not in keys])
    net = net_changes(changes, keys, seq_col, action_col, apply_deletes)
    src_cols = [c for c in cols if c in net.columns]
    s = written(net.select(*[F.col(c).alias(f"_s_{c}") for c in src_cols],
                           F.col(action_col).alias("_s_action"), F.lit(True).alias("_s")), "changes")
    t = target.select(*[F.col(c).alias(f"_t_{c}") for c in cols])
    on = reduce(and_, [F.col(f"_t_{k}") == F.col(f"_s_{k}") for k in keys])
    matched = F.col("_s").isNotNull()
    if applied_col:
        matched = matched & (F.col(f"_t_{applied_col}").isNull() | (F.col(f"_s_{applied_col}") > F.col(f"_t_{applied_col}")))

    def typed(col, c):
        return col.cast(target.schema[c].dataType).alias(c)

    old = t.join(s, on, "left")
    same_key = t.select(*[F.col(f"_t_{k}") for k in keys]).join(s.select(*[f"_s_{k}" for k in keys]), on, "left_semi").distinct()
    new = s.join(same_key, on, "left_anti")
    if apply_deletes:
        old = old.where(~matched | (F.col("_s_action") != "DELETE"))
        new = new.where(F.col("_s_action") != "DELETE")
    take = [c for c in src_cols if c in update and c not in keys]
    old = old.select(*[typed(F.when(matched, F.col(f"_s_{c}")).otherwise(F.col(f"_t_{c}")) if c in take else F.col(f"_t_{c}"), c) for c in cols])
    new = new.select(*[typed(F.col(f"_s_{c}") if c in src_cols else F.lit(None), c) for c in cols])
    return old.unionByName(new)


def replaced(target: DataFrame, changes: DataFrame, keys: list[str], apply_deletes: bool = False) -> DataFrame:
    """`upsert` for changes that carry every column of the target and refresh all of them.

    The rows that stay are target LEFT ANTI JOIN changes, and a change takes
    the place of each row with its key. An anti join passes through the union
    that a merge before it made, so merges in a row by one key, none of them
    written, shuffle the wide target once and not once each."""
    cols = target.columns
    net = net_changes(changes, keys, apply_deletes=apply_deletes)
    s = written(net.select(*[F.col(c).alias(f"_s_{c}") for c in cols], F.col("action").alias("_s_action")), "changes")
    t = target.select(*[F.col(c).alias(f"_t_{c}") for c in cols])
    on = reduce(and_, [F.col(f"_t_{k}") == F.col(f"_s_{k}") for k in keys])
    s_keys = s.select(*[f"_s_{k}" for k in keys])
    kept = t.join(s_keys, on, "left_anti").select(*[F.col(f"_t_{c}").alias(c) for c in cols])
    # one row per target row with a changed key: every row of a repeated key is replaced, as in `upsert`
    same_key = t.select(*[F.col(f"_t_{k}") for k in keys]).join(s_keys, on, "left_semi")
    put = s.join(same_key, on, "left")
    if apply_deletes:
        put = put.where(F.col("_s_action") != "DELETE")
    return kept.unionByName(put.select(*[F.col(f"_s_{c}").cast(target.schema[c].dataType).alias(c) for c in cols]))


def merged_once(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """`upsert` for changes that carry every column of the target and refresh all of them, in one full outer join.

    For a feed that is a good part of the target and would be shuffled with it
    in any case: each side is evaluated and shuffled once, and the changes are
    not written. Sides that are dealt by the keys already are not shuffled. A
    small feed is better merged by `upsert`, which leaves the target in place."""
    cols = target.columns
    s = net_changes(changes, keys).select(*[F.col(c).alias(f"_s_{c}") for c in cols], F.lit(True).alias("_s"))
    t = target.select(*[F.col(c).alias(f"_t_{c}") for c in cols])
    on = reduce(and_, [F.col(f"_t_{k}") == F.col(f"_s_{k}") for k in keys])
    put = F.col("_s").isNotNull()  # one row per target row with a changed key, as in `upsert`
    return t.join(s, on, "full_outer").select(
        *[F.when(put, F.col(f"_s_{c}")).otherwise(F.col(f"_t_{c}")).cast(target.schema[c].dataType).alias(c) for c in cols])


#: Changed rows of one place up to which a target row looks through them; beyond, rows and changes meet by key as well.
CROWD = 1000


def placed(target: DataFrame, changes: DataFrame, keys: list[str], place: list[str], buckets: int | None = None,
           applied_col: str | None = None) -> DataFrame:
    """`upsert` that leaves a target dealt by `place` (columns that are never NULL) where it lies.

    For changes, one per key, that carry every column of the target and refresh all of them, and that are too many to
    be broadcast. Only the keys of both sides are shuffled to meet; the pairs found are written, with the place of
    the target's row. The rows that stay are the target without those found, which it meets by `place`, and the
    changes follow, dealt by `place` too: neither side's wide rows are shuffled, or no more than the changes. Both
    sides are read twice. With `applied_col` as in `upsert`. Of a key that the target repeats every row goes."""
    cols, beside = target.columns, [c for c in place if c not in keys]
    applied = [applied_col] if applied_col else []
    t = target.select(*[F.col(c).alias(f"_t_{c}") for c in [*keys, *beside, *applied]])
    s = changes.select(*[F.col(c).alias(f"_s_{c}") for c in [*keys, *applied]])
    found = t.join(s, reduce(and_, [F.col(f"_t_{k}") == F.col(f"_s_{k}") for k in keys]))
    newer = F.lit(True)
    if applied_col:
        newer = F.col(f"_t_{applied_col}").isNull() | F.coalesce(F.col(f"_s_{applied_col}") > F.col(f"_t_{applied_col}"), F.lit(False))
    hits = written(found.select(*[F.col(f"_t_{c}").alias(f"_h_{c}") for c in [*keys, *beside]], newer.alias("_h_newer")), "hits")

    def without(df, some, by):
        return df.join(some, reduce(and_, [F.col(c) == F.col(f"_h_{c}") for c in by]), "left_anti")

    def dealt(df):
        return (df.repartition(buckets, *place) if buckets else df).select(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in cols])

    gone = hits.where("_h_newer")
    at = [f"_h_{c}" for c in beside]
    if not beside:
        kept = without(target, gone, keys)
    elif set(place) != set(beside) or (gone.groupBy(*at).count().agg(F.max("count")).first()[0] or 0) > CROWD:
        kept = without(target, gone, [*keys, *beside])
    else:
        row = lambda p: F.struct(*[F.col(p + k).alias(k) for k in keys])
        lists = gone.groupBy(*at).agg(F.collect_set(row("_h_")).alias("_h_gone"))
        kept = target.join(lists, reduce(and_, [F.col(c) == F.col(f"_h_{c}") for c in beside]), "left").where(
            ~F.coalesce(F.array_contains("_h_gone", row("")), F.lit(False)))
    late = hits.where("NOT _h_newer")
    put = changes if not applied_col or late.isEmpty() else without(changes, written(late, "late"), keys)
    return dealt(kept).unionByName(dealt(put))
