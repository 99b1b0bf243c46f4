"""Line dedup: a suffix array over lines, by distributed prefix doubling, shows the runs of lines that repeat.

Each document is a sequence of line ids (128-bit hashes; blank lines are left
out of the sequence). A suffix is the rest of a document from some line on.
Prefix doubling ranks the suffixes by their first 1, 2, 4, ... lines: the
rank by 2h lines comes from the pair (rank by h lines here, rank by h lines
h lines further on). Suffixes with the same rank by m lines are the members
of one interval of the suffix array whose longest common prefix is at least m
lines. In each such interval the first copy, by document id and line, stays;
the lines of the later copies are deleted, and overlapping or touching copies
make up one run, wherever their first copies lie. Only the intervals by m
lines decide; the rounds beyond m finish the array.

With `long_words`, an interval with a common prefix of one line counts too
where that line has so many words: its later copies go whatever surrounds
them. The query and the pipeline use LONG_WORDS.

Only suffixes that start with a repeated line take part. A suffix whose rank
no other shares is settled: it leaves the rounds, and one that reaches it is
settled in the next. One whose document ends within h lines is settled too,
and stays only while others can reach it. So a round costs what may still
split, and one very long document makes no rounds for the others. Ranks
are positions in a range-partitioned, sorted and written table of the
distinct pairs that repeat: no window over all rows (that by document sees the
lines of one text), and a line that a third of all rows hold is one row of
that table. Rounds go on until no interval can split any more.

Cases: a null text has no lines and stays null; a text that loses all its
lines becomes empty; `a a a` with m = 2 holds `a a` twice, overlapping, and
loses all but the first line; rows that repeat id and text count as one
document and are treated alike; of equal copies the one with the smallest id
is the first, null ids come before all others; an empty table gives no rows;
further columns are kept by `deduplicated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossledger.llm.common import WORDS, boxed, discard, unboxed, written

#: A run of this many lines is deleted where it occurs again.
RUN_LINES = 2
#: A single line of so many words is deleted where it occurs again.
LONG_WORDS = 50
NOT_BLANK = "[^\\x20\\x09-\\x0D]"
PLACE = ["_d", "_t", "idx"]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`row` of `df` with the document's key: its id (a null below all others) and a hash that tells texts under one id apart."""
    return boxed(df, _d=F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), _t=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_table(df: DataFrame, m: int, id_col: str, text_col: str, long_words: int | None) -> DataFrame:
    """A row per line that is not blank: place, lines of its document, line id (a, b), where m lines from it begin and end, whether it is long."""
    every = F.transform(lines_of(F.col(f"row.{text_col}")), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    items = keyed(df, id_col, text_col).select("_d", "_t", F.filter(every, lambda s: s["line"].rlike(NOT_BLANK)).alias("items"))
    rows = items.select("_d", "_t", F.size("items").alias("of"), F.transform("items", lambda s: s["at"]).alias("ats"),
                        F.posexplode("items").alias("idx", "item"))
    # So many words take at least so many characters: short lines are not matched.
    long = F.lit(False) if long_words is None else (F.length("item.line") >= 2 * long_words - 1) & (F.regexp_count("item.line", F.lit(WORDS)) >= long_words)
    return rows.select("_d", "_t", "of", "idx", F.col("item.at").alias("first"), F.get("ats", F.col("idx") + (m - 1)).alias("last"),
                       F.xxhash64("item.line").alias("a"), F.xxhash64(F.lit("second"), "item.line").alias("b"), long.alias("long"))


def ranked(names: DataFrame, by: list[str]) -> DataFrame:
    """The distinct keys with `rank`, a number that grows with the key; written, since it hangs on the layout."""
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(names.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), "ranks")


PAIR = ["prior", "kind", "k"]


def shifted(level: DataFrame, h: int) -> DataFrame:
    """Each suffix that shares its rank, as `prior`, with the rank of the suffix h lines further on, or what stands there instead.

    kind 2: a suffix that shares its rank (k); 1: one that shares it with none; 0: the document's end.
    """
    ahead = F.first("rank").over(Window.partitionBy("_d", "_t").orderBy("idx").rangeBetween(h, h))
    kind = F.when(F.col("k").isNotNull(), 2).when(F.col("idx") + h < F.col("of"), 1).otherwise(0)
    return level.where(F.col("rank").isNotNull()).withColumn("k", ahead).withColumn("kind", kind).withColumn("k", F.coalesce("k", F.lit(0))).withColumnRenamed("rank", "prior")


def doubled(level: DataFrame, h: int) -> DataFrame:
    """Suffixes ranked by h lines -> ranked by 2h lines; the rank is null where no other suffix has it.

    Suffixes that are settled and that no other reaches are left out: those
    whose rank was null, and those whose document ends within h lines and
    that stand less than h lines from its start.
    """
    pairs = written(shifted(level.where((F.col("idx") + h < F.col("of")) | (F.col("idx") >= h)), h), "pairs")
    meet = pairs.where("kind != 1")
    names = ranked(meet.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), PAIR)
    keep = [*PLACE, "of", "first", "last", "rank"]
    new = written(meet.join(names, PAIR, "left").select(*keep)
                  .unionByName(pairs.where("kind = 1").withColumn("rank", F.lit(None).cast("long")).select(*keep)), "suffixes")
    discard(pairs, names)
    return new


def levels(df: DataFrame, m: int, id_col: str, text_col: str, long_words: int | None) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """The suffixes that start with a repeated line, by their ranks of 1, 2, 4, ... lines; and the intervals: by m lines, and by one long line."""
    lines = line_table(df, m, id_col, text_col, long_words)
    names = ranked(lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), ["a", "b"])
    found = [written(lines.join(names, ["a", "b"]).select(*PLACE, "of", "first", "last", "long", "rank").dropDuplicates(PLACE), "suffixes")]
    discard(names)
    long, h, intervals = found[0].where("long").withColumn("interval", F.struct("rank")), 1, None
    while True:
        level = found[-1]
        if h <= m < 2 * h:
            whole = F.col("idx") + m <= F.col("of")
            if m == h:
                intervals = level.where(whole & F.col("rank").isNotNull()).withColumn("interval", F.struct("rank"))
            else:
                # The line m - h further on decides; where it is settled alone, so is this one.
                intervals = shifted(level, m - h).where(whole & (F.col("kind") != 1)).withColumn("interval", F.struct(*PAIR))
        if intervals is not None and level.where(F.col("rank").isNotNull() & (F.col("idx") + h < F.col("of"))).isEmpty():
            return found, intervals, long
        found.append(doubled(level, h))
        h *= 2


def suffix_array(df: DataFrame, m: int = RUN_LINES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All suffixes that start with a repeated line, with `rank`, alike for equal suffixes only; and `interval`, by m lines, of those that have m lines.

    The rank names the round that settled the suffix, its rank in that round,
    and its place where it shares that with no other.
    """
    found, intervals, _ = levels(df, m, id_col, text_col, None)
    alone, rows = F.col("rank").isNull(), None
    for n, level in enumerate(found):
        # What ended in an earlier round was settled there, and is only here to be reached.
        new = F.lit(n == 0) | (F.col("idx") + (1 << n) // 2 < F.col("of"))
        place = [F.when(alone, F.col(c)).alias(c) for c in PLACE]
        settled = level.where(new & (alone | (F.col("idx") + (1 << n) >= F.col("of")))).select(*PLACE, F.struct(F.lit(n).alias("round"), F.col("rank").alias("by"), *place).alias("rank"))
        rows = settled if rows is None else rows.unionByName(settled)
    return rows, intervals


def later_copies(intervals: DataFrame) -> DataFrame:
    """The members of an interval that are not its first: `first` and `last` say which lines of the text they cover."""
    heads = intervals.groupBy("interval").agg(F.min(F.struct(*PLACE)).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Written: a join whose sides both come straight from a shuffle can be split where an interval is hot.
    return intervals.join(written(heads, "heads"), "interval").where(F.struct(*PLACE) != F.col("head")).select(*PLACE, "first", "last")


def maximal_runs(copies: DataFrame) -> DataFrame:
    """_d, _t, runs: of each document the stretches of lines to delete, as an array of (first, last); touching copies make one."""
    by_doc = Window.partitionBy("_d", "_t").orderBy("idx")
    reach = F.max("last").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("first") > F.coalesce(reach, F.lit(-2)) + 1, 1).otherwise(0)
    runs = copies.withColumn("new", new).withColumn("run", F.sum("new").over(by_doc))
    runs = runs.groupBy("_d", "_t", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("_d", "_t").agg(F.collect_list(F.struct("first", "last")).alias("runs"))


def _stripped(df: DataFrame, m: int, id_col: str, text_col: str, long_words: int | None) -> DataFrame:
    """`keyed` with `runs` (null where nothing is deleted) and `left`, what is left of the text."""
    found, intervals, long = levels(df, m, id_col, text_col, long_words)
    copies = later_copies(intervals)
    if long_words is not None:
        copies = copies.unionByName(later_copies(long.withColumn("last", F.col("first"))))
    runs = written(maximal_runs(copies), "runs")
    discard(*found)
    inside = lambda i: F.exists("runs", lambda r: (i >= r["first"]) & (i <= r["last"]))
    left = F.array_join(F.filter(lines_of(F.col("text")), lambda x, i: ~inside(i)), "\n")
    # Merged at every size: documents with runs grow with the input, so the texts must move once anyhow.
    rows = keyed(df, id_col, text_col).join(runs.hint("merge"), ["_d", "_t"], "left").withColumn("text", F.col(f"row.{text_col}"))
    return rows.withColumn("left", F.when(F.col("runs").isNull(), F.col("text")).otherwise(left))


def deduplicated(df: DataFrame, m: int = RUN_LINES, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = None) -> DataFrame:
    """`df` without the lines of later copies; a document that loses all its lines goes, all other columns stay."""
    out = _stripped(df, m, id_col, text_col, long_words).where(F.col("runs").isNull() | F.col("left").rlike(NOT_BLANK))
    return unboxed(out, df.columns, **{text_col: F.col("left")})


def report(df: DataFrame, m: int = RUN_LINES, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = None) -> DataFrame:
    """doc_id, n_lines (not blank), n_removed, n_runs, kept_sha256 of what is left."""
    count = lambda c: F.size(F.filter(lines_of(F.col(c)), lambda x: x.rlike(NOT_BLANK))).cast("long")
    out = _stripped(df.select(id_col, text_col), m, id_col, text_col, long_words)
    return out.select(F.col(f"row.{id_col}").cast("long").alias("doc_id"), count("text").alias("n_lines"),
                      (count("text") - count("left")).alias("n_removed"),
                      F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"),
                      F.sha2(F.coalesce("left", F.lit("")), 256).alias("kept_sha256"))


SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
s AS (
  SELECT *, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS solid FROM l),
w AS (
  SELECT doc_id, pos AS first, line, lead(pos) OVER o AS last, lead(line) OVER o AS next FROM s WHERE solid WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
c AS (
  SELECT doc_id, first, last FROM w WHERE last IS NOT NULL QUALIFY row_number() OVER (PARTITION BY line, next ORDER BY doc_id, first) > 1
  UNION ALL
  SELECT doc_id, first, first AS last FROM w WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= 50
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, first) > 1),
i AS (
  SELECT *, CASE WHEN first > coalesce(max(last) OVER (PARTITION BY doc_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -2) + 1 THEN 1 ELSE 0 END AS new FROM c),
g AS (SELECT doc_id, count(*) FILTER (new = 1) AS n_runs, list(first) AS firsts, list(last) AS lasts FROM i GROUP BY doc_id),
k AS (
  SELECT s.*, EXISTS (SELECT 1 FROM c WHERE c.doc_id = s.doc_id AND s.pos BETWEEN c.first AND c.last) AS gone FROM s)
SELECT k.doc_id, count(*) FILTER (solid) AS n_lines, count(*) FILTER (solid AND gone) AS n_removed, coalesce(any_value(n_runs), 0) AS n_runs,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM k LEFT JOIN g USING (doc_id) GROUP BY k.doc_id
"""
