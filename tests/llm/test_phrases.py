"""Phrase counts and collocations against plain counting and against SQL."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lossledger.llm import phrases, registry
from tests.oracle_compare import compare, duck

from .cases import AWKWARD, documents, rows

SMALL = "/root/testdata/sf0.001"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_counts(pairs):
    """pairs: (lang, text) -> lang -> Counter of phrases as tuples."""
    out = defaultdict(Counter)
    for lang, text in pairs:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            w = re.findall("[^ \t]+", piece)
            out[lang or "und"].update(tuple(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    return out


def brute(pairs, least=10, top=2000):
    out = []
    for lang, f in brute_counts(pairs).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and c >= least and 100 * c >= 50 * a for q, c in f.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def random_texts(seed, docs=200):
    r = random.Random(seed)
    words = ["a", "b", "The", "new", "york", "seven77", "eightlet", "a\x00", "a\x00\x00", "naïve", "日本語の言葉です", "x" * 30, "x" * 31, "ÀB", "c d"]
    return [(r.choice(["en", "de", None]), "".join(r.choice(words[:3 + k % 13]) + r.choice([" ", " ", " ", "\t ", ". ", ",", "\n"]) for _ in range(r.randint(0, 120)))) for k in range(docs)]


def table(spark, pairs):
    return documents(spark, [t for _, t in pairs], langs=[x for x, _ in pairs])


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("bucket_bytes, slice_bytes", [(8_000_000, 4_000_000), (300, 64)])
def test_equals_plain_counting(spark, bucket_bytes, slice_bytes):
    """Also with slices shorter than a text, so that phrases run over their borders, and with many buckets."""
    pairs = random_texts(1) + [(None, t) for _, t in AWKWARD] + [("en", "new york city")] * 40 + [("und", None)]
    df = table(spark, pairs)
    want = brute(pairs)
    got = sorted(rows(phrases.collocations(df, bucket_bytes=bucket_bytes, slice_bytes=slice_bytes), *COLUMNS))
    assert got == want and len(want) > 80 and {len(w[2].split(" ")) for w in want} == {2, 3}
    counts = {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in rows(phrases.phrase_counts(df, 3, bucket_bytes=bucket_bytes, slice_bytes=slice_bytes)) if r["words"]}
    assert counts == {(lang, p): c for lang, f in brute_counts(pairs).items() for p, c in f.items() if c >= 3}


def test_ties_and_limit(spark):
    pairs = [("en", f"p{k} q{k}") for k in range(30) for _ in range(10 + k % 2)]
    got = sorted(rows(phrases.collocations(table(spark, pairs), top=7), *COLUMNS))
    assert got == brute(pairs, top=7) and [g[1] for g in got] == list(range(1, 8))


def test_empty(spark):
    assert phrases.collocations(table(spark, random_texts(2)).limit(0)).count() == 0
    assert phrases.collocations(table(spark, [(None, None), ("en", ""), ("en", " \t.\n")])).count() == 0


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(4_000_000_000_000, 5_000_000_000_000, 7_000_000_000_001)], "a long, l long, r long")
    a, left, right = 4_000_000_000_000, 5_000_000_000_000, 7_000_000_000_001
    assert row.select(phrases._score(row.a, row.l, row.r)).first()[0] == 1_000_000 * a * a // (left * right)


def test_quicksort_orders_digits_exactly():
    """Words that differ by their length only, by zero bytes, or beyond seven bytes are different words."""
    words = [b"a", b"a\x00", b"abcdefg", b"abcdefgh", b"abcdefg\x00", b"abcdefghijklmn", b"abcdefghijklmno", b"\xff" * 9]
    r = random.Random(3)
    entries = [(r.choice(words), r.choice(words), r.choice([*words, b""])) for _ in range(3000)]
    weights = [r.randint(1, 3) for _ in entries]
    s = phrases.Suffixes(b"".join(b" ".join(e) + b"\n" for e in entries), np.array(weights), 3)
    want = Counter()
    for e, w in zip(entries, weights):
        for k in (1, 2, 3):
            if e[k - 1]:
                want[e[:k]] += w
    got = {}
    for k, pointers, counts in phrases.frequent(s, 12):
        got |= {entries[p][:k]: c for p, c in zip(pointers.tolist(), counts.tolist())}
    assert got == {p: c for p, c in want.items() if c >= 12}


def test_equals_sql(spark):
    df = registry.QUERIES["op11_phrases"](spark, SMALL)
    res = duck(SMALL).execute(registry.SQL["op11_phrases"])
    assert compare([tuple(r) for r in df.collect()], df.columns, res.fetchall(), [d[0] for d in res.description]) is None
