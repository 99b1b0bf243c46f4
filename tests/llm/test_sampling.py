"""Sharding, mixing and fingerprints by definition."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from lossledger.llm import imatch, mixing, sharding

from .cases import AWKWARD, documents, rows

SMALL = "/root/testdata/sf0.01/documents.parquet"
SOURCES = ["a", "a", None, "b", "a", "é", "b", None, "a", "a", "Z", "b", "a"]


def size_of(t):
    return len(re.findall("[^\x20\x09-\x0d]+", t or ""))


def test_shards_match_the_mixture(spark):
    docs = spark.read.parquet(SMALL)
    found = rows(sharding.shard(docs))
    source = dict(rows(docs, "doc_id", "source"))
    n, total = Counter(r["shard"] for r in found), Counter(source.values())
    assert set(n) == set(range(24)) and max(n.values()) - min(n.values()) <= 1
    for k in n:
        assert sorted(r["slot"] for r in found if r["shard"] == k) == list(range(n[k]))
        here = Counter(source[r["doc_id"]] for r in found if r["shard"] == k)
        assert all(abs(here[s] - total[s] / 24) <= 1 + 1e-9 for s in total)


def test_shards_of_awkward_rows(spark):
    df = documents(spark, AWKWARD, SOURCES)
    found = rows(sharding.shard(df, shards=4))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in AWKWARD)
    assert sorted(Counter(r["shard"] for r in found).values()) == [3, 3, 3, 4]
    assert {(r["law"], r["grown_shard"]) for r in found} == {("rows", None)}
    assert sorted(map(str, found)) == sorted(map(str, rows(sharding.shard(df, shards=4))))
    assert sharding.shard(df.limit(0)).count() == 0 and len({r["shard"] for r in rows(sharding.shard(df))}) == len(AWKWARD)


def filled(sizes, weights, budget, most):
    """Water-filling round by round: clamp, share the excess by weight, again."""
    goal = {s: 0.0 for s in sizes}
    free, rest = set(sizes), budget * sum(sizes.values())
    while rest > 1e-9 and free:
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        rest = 0.0
        for s, x in share.items():
            take = min(x, most * sizes[s] - goal[s])
            goal[s] += take
            rest += x - take
        free = {s for s in free if goal[s] < most * sizes[s] - 1e-9}
    return goal


def check_mix(found, pairs, sources):
    sizes = defaultdict(int)
    for (_, t), s in zip(pairs, sources):
        sizes[s] += size_of(t)
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    goal = filled(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5, 2)
    source, taken = defaultdict(set), Counter()
    for (i, t), s in zip(pairs, sources):
        source[i, size_of(t)].add(s)
    for r in found:
        (s,) = source[r["doc_id"], r["size"]] if len(source[r["doc_id"], r["size"]]) == 1 else (next(x for x in source[r["doc_id"], r["size"]] if sizes[x] == r["source_size"]),)
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(goal[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert len(found) == len(pairs) and all(abs(taken[s] - goal[s]) <= 0.5 + 1e-6 for s in sizes)


def test_mix_takes_each_target_to_the_word(spark):
    docs = spark.read.parquet(SMALL)
    table = rows(docs, "doc_id", "text", "source")
    check_mix(rows(mixing.plan(docs)), [x[:2] for x in table], [x[2] for x in table])


def test_mix_of_awkward_rows(spark):
    df = documents(spark, AWKWARD, SOURCES)
    found = rows(mixing.plan(df))
    check_mix(found, AWKWARD, SOURCES)
    assert sorted(map(str, found)) == sorted(map(str, rows(mixing.plan(df)))) and mixing.plan(df.limit(0)).count() == 0
    blank = documents(spark, [(1, None), (2, " ")], ["a", None])
    assert {(r["taken"], r["target"]) for r in rows(mixing.plan(blank))} == {(0, 0.0)}


def test_mixed_rows_hold_the_words_taken(spark):
    df = documents(spark, AWKWARD, SOURCES)
    out = mixing.mixed(df)
    words = Counter()
    for r in rows(out):
        words[r["doc_id"]] += size_of(r["text"])
    want = Counter()
    for r in rows(mixing.plan(df)):
        want[r["doc_id"]] += r["taken"]
    assert out.columns == df.columns and words == +want
    text = {t for _, t in AWKWARD}
    assert all(r["text"] in text or any(" ".join((t or "").split()).startswith(r["text"]) for t in text) for r in rows(out))


def test_edits_and_order(spark):
    table = dict(zip(*(pq.read_table(SMALL)[c].to_pylist() for c in ("doc_id", "text"))))
    ids = sorted(table, reverse=True)
    found = {r["doc_id"]: r for r in rows(imatch.stability(spark.read.parquet(SMALL)))}
    plain = dict(rows(imatch.fingerprints(spark.read.parquet(SMALL)), "doc_id", "fingerprint"))
    for i, j in zip(ids, ids[1:] + ids[:1]):
        new = imatch.edited(table[i], table[j])
        r = found[i]
        assert r["n_chars"] == len(table[i]) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and r["fingerprint"] == plain[i]
    assert len(found) == len(table)
    near, far = [sum(r[c] for r in found.values()) / len(found) for c in ("near_edited", "near_next")]
    assert near > 0.3 and far < 0.05
    by_text = defaultdict(set)
    for i, t in table.items():
        by_text[t].add(found[i]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprints_of_awkward_rows(spark):
    df = documents(spark, AWKWARD)
    found = rows(imatch.stability(df))
    assert Counter((r["doc_id"], r["n_chars"]) for r in found) == Counter((i, len(t or "")) for i, t in AWKWARD)
    assert all(0 <= r[c] <= 1 for r in found for c in ("near_edited", "near_next"))
    empty = next(r for r in found if r["doc_id"] == 0)
    assert empty["near_edited"] == 1.0 and empty["fingerprint"] == empty["edited_fingerprint"]
    one = rows(imatch.stability(documents(spark, [(5, "one single text")])))
    assert one[0]["near_next"] == 1.0 and imatch.stability(df.limit(0)).count() == 0


def test_lexicon_is_the_band(spark):
    docs = spark.read.parquet(SMALL).select("doc_id", "text")
    count = Counter(t for _, text in rows(docs, "doc_id", "text") for t in set(re.findall(r"\w+", text.lower())))
    n = docs.count()
    low, high = max(2, math.ceil(n * imatch.RAREST)), math.floor(n * imatch.COMMONEST)
    assert imatch.lexicon(docs) == sorted(t for t, c in count.items() if low <= c <= high)


def test_near_copies_have_near_fingerprints():
    terms = [f"t{k}" for k in range(3000)]
    make = imatch.Fingerprinter(terms)
    a, b, c = make(" ".join(terms[:1000])), make(" ".join(terms[:990])), make(" ".join(terms[1500:2500]))
    assert imatch.likeness(a, a) == 1 and imatch.likeness(a, b) >= 0.8 and imatch.likeness(a, c) <= 0.2
