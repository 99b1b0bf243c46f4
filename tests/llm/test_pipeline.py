"""The pipeline's stages against plain versions of the same decisions, and the queries against their SQL."""

import os
import sys
from collections import Counter, defaultdict

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from lossledger.llm import registry  # noqa: E402

from .cases import rows  # noqa: E402
from .test_dedup import lines_by_hand, near_by_hand  # noqa: E402
from .test_sampling import filled, size_of  # noqa: E402

TABLES = "/root/testdata/sf0.001"


def test_each_stage_decides_as_by_hand(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "near dedup", "mixing", "sentencepiece"]

    def step(name, frame):
        out = rows(stages[name](spark, frame, TABLES))
        if name != "sentencepiece":
            assert set(out[0]) == set(columns) and all(r["n_chars"] == len(r["text"]) for r in out if name != "language ID")
            return out, spark.createDataFrame([[r[c] for c in columns] for r in out], frame.schema)
        return out, None

    one, frame = step("language ID", docs)
    assert {r["doc_id"] for r in one} == {i for i, t in rows(docs, "doc_id", "text") if t and any(c.isalpha() for c in t)}
    two, frame = step("line dedup", frame)
    want = lines_by_hand([(r["doc_id"], r["text"]) for r in one], 2, 50)
    assert {r["doc_id"]: r["text"] for r in two} == {i: left for (i, t), left in want.items() if left.strip() or not (t or "").strip()}
    three, frame = step("near dedup", frame)
    assert sorted(r["doc_id"] for r in three) == sorted(i for i, _, _, kept in near_by_hand([(r["doc_id"], r["text"]) for r in two]) if kept)
    four, frame = step("mixing", frame)
    sizes, taken = defaultdict(int), Counter()
    for r in three:
        sizes[r["source"]] += size_of(r["text"])
    for r in four:
        taken[r["source"]] += size_of(r["text"])
    goal = filled(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}, 1.5, 2)
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in sizes)
    five, _ = step("sentencepiece", frame)
    assert Counter(r["doc_id"] for r in five) == Counter(r["doc_id"] for r in four) and all(r["n_tokens"] > 2 for r in five)


@pytest.mark.parametrize("key", sorted(registry.SQL))
def test_query_equals_its_sql(spark, key):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{TABLES}/{table}.parquet')")
    df = registry.QUERIES[key](spark, TABLES)
    found = con.execute(registry.SQL[key])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, rows(df, *names))) == sorted(repr(tuple(r)) for r in found.fetchall())
