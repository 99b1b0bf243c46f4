"""The four dedup operators against brute force on small tables and awkward rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lossledger.llm import exact_dedup, hyperminhash, line_dedup, suffix_dedup
from lossledger.llm.shingles import shingle_sets

from .cases import AWKWARD, documents, rows

SMALL = "/root/testdata/sf0.001/documents.parquet"


def small():
    t = pq.read_table(SMALL)
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


def in_order(found):
    return sorted(found, key=lambda r: [(x is None, x if x is not None else 0) if not isinstance(x, str) else (False, x) for x in r])


# exact

def exact_by_hand(pairs):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    ids, out, seen = {}, [], set()
    for i, t in pairs:
        ids.setdefault(norm(t), []).append(i)
    for i, t in pairs:
        n = norm(t)
        keep = min((x for x in ids[n] if x is not None), default=None)
        out.append((i, keep, len(ids[n]), i == keep and (i, n) not in seen, hashlib.sha256(n.encode()).hexdigest()))
        seen.add((i, n))
    return in_order(out)


@pytest.mark.parametrize("content_hash", [F.md5, lambda c: F.substring(F.md5(c), 1, 1)], ids=["md5", "colliding"])
def test_exact_groups(spark, content_hash):
    for pairs in (AWKWARD, small(), [(k, f"word {k % 7}  x") for k in range(60)]):
        got = exact_dedup.groups(documents(spark, pairs), content_hash=content_hash)
        assert in_order(rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256")) == exact_by_hand(pairs)


def test_exact_keeps_all_columns(spark):
    df = documents(spark, [(1, "a  b"), (2, "a b"), (3, "c")])
    assert sorted(r["doc_id"] for r in rows(exact_dedup.deduplicated(df))) == [1, 3]
    assert exact_dedup.deduplicated(df).columns == df.columns and exact_dedup.groups(df.limit(0)).count() == 0


def test_exact_keeps_one_row_where_ids_are_null_or_repeat(spark):
    pairs = [(None, "a  b"), (None, "a b"), (None, "c"), (4, "c"), (4, "c"), (4, "d"), (5, "d"), (6, None), (None, ""), (6, "")]
    got = rows(exact_dedup.deduplicated(documents(spark, pairs)), "doc_id", "text")
    assert sorted((i or 0, re.sub(" +", " ", t or "")) for i, t in got) == [(0, "a b"), (4, "c"), (4, "d"), (6, "")]


# line runs

def lines_by_hand(pairs, m, long_words=None):
    pairs = list(dict.fromkeys(pairs))
    at, gone = {}, {}
    for d, (i, t) in enumerate(pairs):
        every = (t or "").split("\n")
        solid = [k for k, x in enumerate(every) if re.search("[^\x20\x09-\x0d]", x)]
        for s in range(len(solid) - m + 1):
            key = tuple(every[k] for k in solid[s:s + m])
            at.setdefault(key, []).append(((-1 if i is None else i), d, s, solid[s], solid[s + m - 1]))
        for s, k in enumerate(solid):
            if long_words is not None and len(re.findall("[^\x20\x09-\x0d]+", every[k])) >= long_words:
                at.setdefault(("long", every[k]), []).append(((-1 if i is None else i), d, s, k, k))
    for found in at.values():
        for _, d, _, first, last in sorted(found)[1:]:
            gone.setdefault(d, set()).update(range(first, last + 1))
    return {(i, t): "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone.get(d, ())) for d, (i, t) in enumerate(pairs)}


@pytest.mark.parametrize("m", [1, 2, 3])
def test_line_runs(spark, m):
    r = random.Random(m)
    made = [(k, "\n".join(r.choices(["aa", "bb", "cc", "", " ", f"only {k}"], k=r.randint(0, 9)))) for k in range(40)]
    cases = [made] if m != 2 else [made, [*AWKWARD, (20, "a\na\na"), (21, "p\n\nq\nr"), (22, "p\nq\n\nr\ns")], small()]
    for pairs in cases:
        want = lines_by_hand(pairs, m)
        got = line_dedup.report(documents(spark, pairs), m)
        expected = in_order([(i, hashlib.sha256(want[i, t].encode()).hexdigest()) for i, t in pairs])
        assert in_order(rows(got, "doc_id", "kept_sha256")) == expected


def test_long_lines_go_from_later_copies(spark):
    """With `long_words`, a line of so many words goes where it occurs again, whatever surrounds it; shorter ones stay."""
    r = random.Random(50)
    words = lambda n, c: " ".join(f"{c}{k}" for k in range(n))
    pool = [words(50, "p"), words(50, "q") + " ", words(49, "s"), "short", "", "\t"]
    made = [(k, "\n".join(x for y in r.choices(pool, k=r.randint(0, 6)) for x in (y, f"only {k} {r.random()}"))) for k in range(40)]
    pairs = [*AWKWARD, *made, (60, words(50, "p")), (61, words(50, "p")), (61, words(50, "p")), (62, words(49, "s")), (None, words(50, "q") + " ")]
    two = lines_by_hand(pairs, 2)
    at, gone = {}, {}
    for d, (i, t) in enumerate(dict.fromkeys(pairs)):
        for k, x in enumerate((t or "").split("\n")):
            if len(x.split()) >= 50:
                at.setdefault(x, []).append((-1 if i is None else i, k, d, (i, t)))
    for found in at.values():
        for _, k, _, pair in sorted(found, key=lambda f: f[:3])[1:]:
            gone.setdefault(pair, set()).add(k)
    # No two lines repeat together but in the awkward rows, where the whole text does: there the long lines are part of the runs.
    want = {p: two[p] if two[p] != (p[1] or "") else "\n".join(x for k, x in enumerate((p[1] or "").split("\n")) if k not in gone.get(p, ())) for p in two}
    got = line_dedup.report(documents(spark, pairs), long_words=50)
    assert in_order(rows(got, "doc_id", "kept_sha256")) == in_order([(i, hashlib.sha256(want[i, t].encode()).hexdigest()) for i, t in pairs])
    left = {r["doc_id"] for r in rows(line_dedup.deduplicated(documents(spark, pairs), long_words=50))}
    assert 60 not in left and 61 not in left and {None, 62} <= left


def test_long_lines_and_runs_together(spark):
    """Both rules at once: runs of two lines, and long lines between lines that change; ties, null ids, texts under one id."""
    r = random.Random(3)
    pool = [" ".join(f"{c}{k}" for k in range(60)) for c in "pq"] + ["aa", "bb", ""]
    made = [(r.choice([None, 7, k]), "\n".join(r.choices([*pool, f"only {k}"], k=r.randint(0, 9)))) for k in range(60)]
    pairs = list(dict.fromkeys([*made, *AWKWARD]))
    rest = [(i, t) for i, t in pairs if i not in (None, 7)]
    want = lines_by_hand(rest, 2, 50)
    got = line_dedup.report(documents(spark, rest), long_words=50)
    assert in_order(rows(got, "doc_id", "kept_sha256")) == in_order([(i, hashlib.sha256(want[i, t].encode()).hexdigest()) for i, t in rest])
    # Which text under one id comes first hangs on the hashes, but one copy of each long line stays.
    left = Counter(x for r in rows(line_dedup.deduplicated(documents(spark, pairs), long_words=50)) for x in (r["text"] or "").split("\n"))
    assert all(left[x] == 1 for x in pool[:2])


def test_line_dedup_keeps_rows_and_columns(spark):
    df = documents(spark, [(1, "a\nb\nc"), (2, "a\nb\nd"), (3, "a\nb"), (4, None), (5, "")])
    out = line_dedup.deduplicated(df)
    assert out.columns == df.columns
    assert {(r["doc_id"], r["text"]) for r in rows(out)} == {(1, "a\nb\nc"), (2, "d"), (4, None), (5, "")}
    assert line_dedup.report(df.limit(0)).count() == 0


def test_suffix_ranks_follow_the_lines(spark):
    """Suffixes of equal rank are equal to their end; ranks by m lines group what agrees in m lines."""
    pairs = [(k, "\n".join(x)) for k, x in enumerate(["abcab", "xabcab", "ab", "cab", "zzz", "abz"])]
    ranks, intervals = line_dedup.suffix_array(documents(spark, pairs), 2)
    text = {k: t.split("\n") for k, t in pairs}
    found = {(r["_d"], r["idx"]): r["rank"] for r in rows(ranks)}
    for a in found:
        for b in found:
            assert (found[a] == found[b]) == (text[a[0]][a[1]:] == text[b[0]][b[1]:])
    by = {(r["_d"], r["idx"]): r["interval"] for r in rows(intervals)}
    for a in by:
        for b in by:
            assert (by[a] == by[b]) == (text[a[0]][a[1]:a[1] + 2] == text[b[0]][b[1]:b[1] + 2])


# byte strings

def test_grouped_suffix_array():
    r = random.Random(4)
    for _ in range(1500):
        text = [r.randint(1, r.choice([1, 2, 3, 9])) for _ in range(r.randint(0, 30))] + [0]
        assert suffix_dedup.grouped_suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def strings_by_hand(pairs, n=suffix_dedup.LENGTH):
    raw = [(i, (t or "").encode()) for i, t in pairs]
    count = Counter(x[k:k + n] for _, x in raw for k in range(len(x) - n + 1))
    out = []
    for i, x in raw:
        hit = bytearray(len(x))
        for k in range(len(x) - n + 1):
            if count[x[k:k + n]] > 1:
                hit[k:k + n] = b"\1" * n
        kept = bytes(b for b, h in zip(x, hit) if not h)
        out.append((i, len(x), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest()))
    return in_order(out)


def passages(seed, n=40, shared=3):
    """Texts around a few shared passages of about the decisive length, in many different surroundings."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(1, 8)))
    parts = [" ".join(word() for _ in range(r.choice([30, 38, 41, 45, 90]))) for _ in range(shared)]
    out = []
    for k in range(n):
        bits = [" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(3)]
        out.append((k, bits[0] + r.choice(["", " "]) + r.choice(parts) + bits[1] + (r.choice(parts)[r.randint(0, 40):] if r.random() < 0.5 else "") + bits[2]))
    return out


@pytest.mark.parametrize("crowd", [256, 3, 1])
def test_repeated_strings(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    cases = [passages(crowd), [*AWKWARD, (30, "ab" * 300), (31, "z" * 199), (32, "z" * 200), (33, "z" * 500), (34, "é" * 150)]]
    for pairs in cases + ([small()] if crowd == 256 else []):
        got = suffix_dedup.removed(documents(spark, pairs))
        assert in_order(rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == strings_by_hand(pairs)


def test_repeated_strings_of_an_empty_table(spark):
    assert suffix_dedup.removed(documents(spark, AWKWARD).limit(0)).count() == 0


def test_long_texts_are_cut_without_losing_a_string():
    r = np.random.default_rng(3)
    data = r.integers(97, 105, 5000).astype(np.uint8)
    whole = list(suffix_dedup._bounded(data, [5000]))
    parts = list(suffix_dedup._bounded(data, [5000], most=700))
    starts = lambda found: {(f + k, p) for _, first, count, place, _, _ in found for f, c, p in zip(first, count, place) for k in range(c)}
    assert len(parts) == 8 and starts(whole) == starts(parts) and len(starts(whole)) == 5000 - suffix_dedup.LENGTH + 1


# near-duplicates

def sets_by_hand(pairs):
    out = []
    for i, t in pairs:
        w = (t or "").encode().lower().split()
        out.append((i, frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def near_by_hand(pairs):
    sets = sets_by_hand(pairs)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    head = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            head[find(k)] = min(head.get(find(k), i), i)
    return in_order([(i, len(s), head.get(find(k)), i == head.get(find(k))) for k, (i, s) in enumerate(sets)])


def family(seed, n, base_words, edits):
    """Near copies of one text, each with a few words changed: a chain of likenesses around the threshold."""
    r = random.Random(seed)
    base = [f"b{r.randrange(5000)}" for _ in range(base_words)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(r.randint(0, edits)):
            words[r.randrange(len(words))] = f"x{seed}{r.randrange(9)}"
        out.append((seed * 1000 + k, " ".join(words)))
    return out


def test_shingles_are_those_of_the_definition():
    pairs = [*AWKWARD, *small()[:50]]
    owner, hashes = shingle_sets([t for _, t in pairs])
    assert np.bincount(owner, minlength=len(pairs)).tolist() == [len(s) for _, s in sets_by_hand(pairs)]
    by = {}
    for (_, s), k in zip(sets_by_hand(pairs), range(len(pairs))):
        by.setdefault(s, set()).add(tuple(hashes[owner == k].tolist()))
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)


def test_near_duplicates(spark):
    big = [*family(1, 25, 200, 8), *family(2, 25, 60, 3), *family(3, 30, 12, 2), *family(4, 20, 400, 25)]
    for pairs in (AWKWARD, small(), big):
        got = hyperminhash.near_duplicates(documents(spark, pairs))
        assert in_order(rows(got, "doc_id", "n_shingles", "component_id", "kept")) == near_by_hand(pairs)


@pytest.mark.parametrize("sample", [1, 4000])
def test_rest_of_unfinished_buckets(spark, monkeypatch, sample):
    """The exact way for the rest finds every link between components, whatever the order of shingles rests on."""
    monkeypatch.setattr(hyperminhash, "SAMPLE_NODES", sample)
    r = random.Random(11)
    passage = [f"p{k}" for k in range(50)]
    mixed = [(k, " ".join([f"o{r.randrange(40)}" for _ in range(r.randint(0, 20))] + passage + [f"q{r.randrange(9)}" for _ in range(r.randint(0, 9))])) for k in range(60)]
    pairs = [*mixed, *family(5, 25, 120, 9), *family(6, 25, 40, 4)]
    want = near_by_hand(pairs)
    assert in_order(rows(hyperminhash.near_duplicates(documents(spark, pairs)), "doc_id", "n_shingles", "component_id", "kept")) == want
    # Every node by itself: the pairs of the rest hold each link.
    sets = dict(sets_by_hand(pairs))
    hyperminhash.ship_code(spark)
    texts = hyperminhash.packed(documents(spark, pairs).select("doc_id", "text")).select(F.col("doc_id").alias("node"), "packed")
    alone = texts.select("node", F.col("node").alias("label"))
    found = set(rows(hyperminhash.pairs_of_rest(alone, texts), "a", "b"))
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert links <= found and len(found) < len(sets) ** 2 / 2


def test_estimate_is_near_the_similarity():
    r = random.Random(9)
    words = [f"w{k}" for k in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[600:3600])
    owner, hashes = shingle_sets([a, b])
    regs = hyperminhash.registers(owner, hashes, 2)
    estimate, filled = hyperminhash.similarity(regs[:1], regs[1:])
    assert filled[0] == hyperminhash.REGISTERS and abs(estimate[0] - 2400 / 3600) < 0.15 and r


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (200, 201)]
    found = dict(rows(hyperminhash.components(spark.createDataFrame(edges, "a long, b long")), "node", "label"))
    assert found == {**{k: 0 for k in range(41)}, 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}
    assert hyperminhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup_keeps_one_row_of_a_group(spark):
    df = documents(spark, [*family(1, 6, 200, 3), (7, None), (8, "a b")])
    out = hyperminhash.deduplicated(df)
    assert sorted(r["doc_id"] for r in rows(out)) == [7, 8, 1000] and out.columns == df.columns
    assert hyperminhash.near_duplicates(df.limit(0)).count() == 0


def test_near_dedup_keeps_one_row_where_ids_are_null_or_repeat(spark):
    one, two, three, four = ([t for _, t in family(k, 4, 200, 2)] for k in (21, 22, 23, 24))
    pairs = [*[(None, t) for t in one],  # no id at all
             *[(None, t) for t in two[1:]], (5, two[0]),  # the row with an id stands for them
             *[(7, t) for t in three], (8, three[0]),  # one id, several texts
             (7, four[0]), (3, four[1]),  # an id kept elsewhere
             *[(9, "a twin row of six words")] * 3, (None, "another twin row without id")]
    pairs += [pairs[-1], (7, None), (7, None), (None, " ")]  # without shingles: all stay
    got = rows(hyperminhash.deduplicated(documents(spark, pairs)), "doc_id", "text")
    assert Counter(i for i, _ in got) == Counter([None, 5, 7, 3, 9, None, 7, 7, None])
    assert all(sum(t in texts for _, t in got) == 1 for texts in (one, two, three, four)) and not Counter(got) - Counter(pairs)
