"""Documents with every awkward case, and small helpers for the tests of the corpus operators."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       # names that operators use for columns of their own
                       *[T.StructField(n, T.StringType()) for n in ("size", "shard", "hash", "norm", "rank", "label", "row", "key", "_d", "node", "runs", "left", "id")]])
LONG = "\n".join(" ".join(f"w{i * 31 % 9973}" for i in range(k, k + 40)) for k in range(0, 8000, 40))


def documents(spark, texts, sources=None, langs=None):
    """texts: a list, numbered from 0, or pairs (doc_id, text)."""
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    rows = [(i, t, langs[k] if langs else None, sources[k] if sources else None, None, *["x"] * 13) for k, (i, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, SCHEMA)


AWKWARD = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "one two three four five six"), (5, "one two three four five six"),
           (6, LONG), (7, LONG), (8, "naïve café 日本語 😀 <|endoftext|> ▁x"), (8, "the same id, another text"), (9, "twin row"), (9, "twin row"), (None, "no id")]


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()] if columns else [r.asDict() for r in df.collect()]
