"""Phrase mining: counts of all runs of words by multikey three-way quicksort of suffix pointers.

A suffix pointer stands for a place in a piece of text and the (up to three)
words from there on. Each task first sums up equal suffixes of a few
megabytes of text, then packs them by their leading two words into buckets
(single words by themselves into buckets of their own), so all suffixes that
begin with the same two words meet in one bucket, each with a weight.

There a three-way quicksort sorts pointers, not texts. A word is read as
digits of seven bytes and their number; suffixes are split by the current
digit of a pivot into smaller, equal and larger ones. The equal part goes on
to the next digit, and at a word's last digit its weight is the count of the
words so far. A part lighter than `least` holds no frequent phrase and is
abandoned. All parts of a bucket are split in the same step, with numpy. No
hash decides a count.

Buckets are as many as the text needs for `BUCKET` bytes in each. The words
that follow a very frequent pair are in one bucket once per few megabytes of
text, with weights, so the pair's number of occurrences does not load it.

Scores compare a phrase with the counts of its parts, by joins: a part is at
least as frequent as the whole, so it was counted. Products are exact
decimals of 38 digits.

Cases: null text is empty; null language is `und`; a text or piece without a
word counts nothing; long texts are cut behind a word, and the next two words
are read again as context; repeated rows count as often as they occur; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossledger.llm.common import discard, ship_code, written

#: Bytes of text whose equal suffixes a task sums up at a time; at most half as many words, so three word numbers fit 63 bits.
SLICE = 4_000_000
#: Bytes of suffixes that a bucket holds, about, if none are equal.
BUCKET = 8_000_000
MOST_WORDS = 3

_END, _SPACE = 10, 32
#: Letters A-Z in lower case, piece borders as line ends, tabs as blanks.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else _END if c in b".,;:!?\n\x0b\x0c\r" else _SPACE if c == 9 else c for c in range(256))
_CONTEXT = re.compile(rb" *(?:[^ \n]+ +)?(?:[^ \n]+)?")
_SEPARATOR = re.compile(rb"[ \n]")


# -- from texts to weighted suffixes ------------------------------------------------------------------------------------


def slices(texts: list[bytes], most: int = SLICE) -> Iterator[tuple[bytes, int]]:
    """Stretches of about `most` bytes of prepared text, and how many of their bytes count: what follows is context."""
    held: list[bytes] = []
    size = 0
    for raw in texts:
        text = raw.translate(_TABLE)
        if size + len(text) > most and held:
            data = b"\n".join(held)
            yield data, len(data)
            held, size = [], 0
        at = 0
        while len(text) - at > most:
            cut = _SEPARATOR.search(text, at + most)
            if not cut:
                break
            yield text[at:_CONTEXT.match(text, cut.start()).end()], cut.start() - at
            at = cut.start()
        held.append(text[at:])
        size += len(text) - at + 1
    if held:
        data = b"\n".join(held)
        yield data, len(data)


def _mixed(h: np.ndarray) -> np.ndarray:
    """64 bits to 64 bits, every bit of the input moving every bit of the result."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _routing_hash(words: pa.BinaryArray) -> np.ndarray:
    """A hash per word, alike in every task; it only chooses buckets."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))
    letters = _mixed(data[:offsets[-1]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + inside.astype(np.uint64))
    return np.add.reduceat(letters, offsets[:-1]) if len(words) else np.zeros(0, np.uint64)


def _packed(lang: str, kind: int, words: list[pa.Array], weight: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """One row per bucket: its suffixes' words, blanks between and a line end behind, and their weights."""
    order = np.argsort(bucket, kind="stable")
    lines = pc.binary_join_element_wise(*[w.take(pa.array(order)) for w in words], b" ")
    offsets = np.frombuffer(lines.buffers()[1], np.int32, len(lines) + 1)
    numbers, first = np.unique(bucket[order], return_index=True)
    cuts = np.append(first, len(order)).astype(np.int32)
    entries = pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(offsets[cuts].copy()), lines.buffers()[2]])
    weights = pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(cuts * 4), pa.py_buffer(weight[order].astype("<u4"))])
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(numbers)), pa.array([kind] * len(numbers), pa.int32()), pa.array(numbers.astype(np.int64)), entries, weights],
                                      names=["lang", "kind", "bucket", "entries", "weights"])


def suffixes(lang: str, data: bytes, counted: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The suffixes of one stretch, equal ones summed up: single words (kind 1), and two or three words (kind 3)."""
    words = pa.array(data.split(), pa.binary()).dictionary_encode()
    ids, vocabulary = words.indices.to_numpy().astype(np.int64), words.dictionary
    letters = np.frombuffer(data, np.uint8)
    blank = (letters == _SPACE) | (letters == _END)
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    heads = int(np.searchsorted(starts, counted))
    if not heads:
        return
    size = len(vocabulary) + 1
    hashes = _routing_hash(vocabulary) + np.uint64(sum(lang.encode()) + 1)
    line = pc.binary_join_element_wise(vocabulary, pa.scalar(b"\n", pa.binary()), b"")

    times = np.bincount(ids[:heads], minlength=size - 1)
    seen = np.flatnonzero(times)
    yield _packed(lang, 1, [line.take(pa.array(seen))], times[seen], (_mixed(hashes[seen]) % np.uint64(buckets)).astype(np.int64))

    piece = np.append(np.searchsorted(np.flatnonzero(letters == _END), starts), [-1, -2])
    padded = np.append(ids, [0, 0])
    head = np.flatnonzero(piece[1:heads + 1] == piece[:heads])
    if not len(head):
        return
    third = np.where(piece[head + 2] == piece[head], padded[head + 2] + 1, 0)
    key = np.sort((padded[head] * size + padded[head + 1]) * size + third)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    times = np.diff(np.append(first, len(key)))
    pair, third = np.divmod(key[first], size)
    one, two = np.divmod(pair, size)
    ends = pa.concat_arrays([pa.array([b"\n"], pa.binary()), line.cast(pa.binary())])
    bucket = _mixed(hashes[one] + _mixed(hashes[two])) % np.uint64(buckets)
    yield _packed(lang, MOST_WORDS, [vocabulary.take(pa.array(one)), vocabulary.take(pa.array(two)), ends.take(pa.array(third))], times, bucket.astype(np.int64))


# -- the quicksort ------------------------------------------------------------------------------------------------------

_KEEP = np.array([(0xFFFFFFFFFFFFFFFF << (64 - 8 * r)) & 0xFFFFFFFFFFFFFFFF for r in range(8)], np.uint64)


class Suffixes:
    """The suffixes of a bucket: where each of their words begins, how long it is, and their weights."""

    def __init__(self, data: bytes, weights: np.ndarray, words: int):
        self.data, self.weights = data, weights.astype(np.int64)
        letters = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(letters == _END)
        blanks = np.flatnonzero(letters == _SPACE).reshape(len(ends), words - 1)
        borders = np.column_stack([np.append(-1, ends[:-1]), blanks, ends])
        self.start = np.ascontiguousarray((borders[:, :-1] + 1).T)
        self.length = np.ascontiguousarray(np.diff(borders, axis=1).T - 1)
        padded = np.append(letters, np.zeros(8, np.uint8))
        self.eight = np.ndarray((len(letters) + 1,), ">u8", padded, strides=(1,)).astype(np.uint64)

    def digit(self, pointer: np.ndarray, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Seven bytes of each pointer's word, and in the last byte how many there are: 0 no word, 8 more follow."""
        left = self.length[word, pointer] - 7 * place
        return self.eight[self.start[word, pointer] + 7 * place] & _KEEP[np.minimum(left, 7)] | np.minimum(left, 8).astype(np.uint64)

    def phrase(self, pointer: int, words: int) -> str:
        return self.data[self.start[0, pointer]:self.start[words - 1, pointer] + self.length[words - 1, pointer]].decode()


def frequent(s: Suffixes, least: int, seed: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of words, a pointer to each such phrase, its count) for all phrases with a count of `least` or more."""
    depth = len(s.start)
    pick = np.random.default_rng(seed)
    pointer = np.arange(s.start.shape[1])
    sizes, word, place = np.array([len(pointer)]), np.zeros(1, np.int64), np.zeros(1, np.int64)
    digit = s.digit(pointer, 0, 0)
    while len(pointer):
        offset = np.cumsum(sizes) - sizes
        pivot = digit[offset + (pick.random(len(sizes)) * sizes).astype(np.int64)]
        against = np.repeat(pivot, sizes)
        weight = s.weights[pointer]
        parts = []
        for side, part in enumerate((digit < against, digit == against, digit > against)):
            count = np.add.reduceat(part, offset, dtype=np.int64)
            total = np.add.reduceat(np.where(part, weight, 0), offset)
            keep = total >= least
            if side == 1:
                more = pivot & np.uint64(255)
                done = np.flatnonzero(keep & (more > 0) & (more < 8))
                if len(done):
                    # The pivot's own suffix stands for each part: the first of the equal ones.
                    at = np.flatnonzero(part)[(np.cumsum(count) - count)[done]]
                    for w in range(depth):
                        if (mine := word[done] == w).any():
                            yield w + 1, pointer[at[mine]], total[done][mine]
                keep &= (more == 8) | ((more > 0) & (word + 1 < depth))
                new_word, new_place = np.where(more < 8, word + 1, word), np.where(more < 8, 0, place + 1)
            else:
                new_word, new_place = word, place
            chosen = np.flatnonzero(part & np.repeat(keep, sizes))
            if len(chosen):
                p, n = pointer[chosen], count[keep]
                d = s.digit(p, np.repeat(new_word[keep], n), np.repeat(new_place[keep], n)) if side == 1 else digit[chosen]
                parts.append((p, d, n, new_word[keep], new_place[keep]))
        if not parts:
            return
        pointer, digit, sizes, word, place = (np.concatenate(x) for x in zip(*parts, strict=True))


# -- the whole table ----------------------------------------------------------------------------------------------------

_PACKED = "lang string, kind int, bucket long, entries binary, weights binary"
_COUNTS = "lang string, words int, phrase string, f long"


def phrase_counts(df: DataFrame, least: int = 10, text_col: str = "text", lang_col: str = "lang", bucket_bytes: int = BUCKET, slice_bytes: int = SLICE) -> DataFrame:
    """lang, words, phrase, f: all phrases of 1 to 3 words with f >= least; with words = 0, parts of the number of all words."""
    ship_code(df.sparkSession)
    texts = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where(F.octet_length("text") > 0)
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-MOST_WORDS * total // bucket_bytes))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[bytes]] = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                by_lang[lang].append(text)
            for lang, found in sorted(by_lang.items()):
                for data, counted in slices(found, slice_bytes):
                    yield from suffixes(lang, data, counted, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _COUNTS.split(", ")]
        rows = ((lang, kind, bucket, entries, weights) for batch in batches for k in range(0, batch.num_rows, 64)
                for lang, kind, bucket, entries, weights in zip(*(c.to_pylist() for c in batch.slice(k, 64).columns), strict=True))
        for (lang, kind, _), group in groupby(rows, key=lambda r: r[:3]):
            packed = [r[3:] for r in group]
            found = Suffixes(b"".join(p[0] for p in packed), np.frombuffer(b"".join(p[1] for p in packed), "<u4"), kind)
            del packed
            if kind == 1:
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([int(found.weights.sum())], pa.int64())], names=names)
            for words, pointers, counts in frequent(found, least):
                if words == 1 < kind:  # only the part of the word's occurrences that this bucket's pairs begin with
                    continue
                n = len(pointers)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([words] * n, pa.int32()), pa.array([found.phrase(p, words) for p in pointers.tolist()]),
                                                  pa.array(counts, pa.int64())], names=names)

    return (texts.mapInArrow(pack, _PACKED).repartition("bucket", "lang", "kind").sortWithinPartitions("bucket", "lang", "kind")
            .mapInArrow(count, _COUNTS))


def _score(a: Column, left: Column, right: Column) -> Column:
    exact = lambda c: c.cast("decimal(19,0)")
    over = (exact(a) * exact(a)).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", over, exact(left) * exact(right)).cast("long")


def collocations(df: DataFrame, least: int = 10, top: int = 2000, text_col: str = "text", lang_col: str = "lang", inside: int = 50,
                 bucket_bytes: int = BUCKET, slice_bytes: int = SLICE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of two or three words.

    The score is floor(10^6 a^2 / (l r)) at the cut where it is least. A phrase
    that lies in a longer candidate with at least `inside` percent of its count
    gives way to it.
    """
    counts = written(phrase_counts(df, least, text_col, lang_col, bucket_bytes, slice_bytes), "phrase-counts")
    of = lambda n, name, f: counts.where(F.col("words") == n).select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    w = F.split("phrase", " ")
    words_of = lambda i, j: F.concat_ws(" ", F.slice(w, i, j))
    pairs = (of(2, "phrase", "a").withColumns({"one": w[0], "two": w[1]})
             .join(of(1, "one", "l"), ["lang", "one"]).join(of(1, "two", "r"), ["lang", "two"])
             .select("lang", "phrase", "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score")))
    triples = of(3, "phrase", "a").withColumns({"one": w[0], "front": words_of(1, 2), "back": words_of(2, 2), "three": w[2]})
    longer = (triples.select("lang", F.explode(F.array("front", "back")).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    pairs = (pairs.join(longer, ["lang", "phrase"], "left")
             .where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True))).drop("longer"))
    cuts = (triples.join(of(1, "one", "l1"), ["lang", "one"]).join(of(2, "back", "r1"), ["lang", "back"])
            .join(of(2, "front", "l2"), ["lang", "front"]).join(of(1, "three", "r2"), ["lang", "three"])
            .withColumns({"s1": _score(F.col("a"), F.col("l1"), F.col("r1")), "s2": _score(F.col("a"), F.col("l2"), F.col("r2"))}))
    first = F.col("s1") <= F.col("s2")
    triples = cuts.select("lang", "phrase", "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                          F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    # A language's best of each of 64 parts first, then the best of those: no task orders all of a language.
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    near = (pairs.unionByName(triples).withColumn("part", part)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    n = counts.where(F.col("words") == 0).groupBy("lang").agg(F.sum("f").alias("n"))
    found = written(ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    discard(counts)
    return found


#: DuckDB SQL for `collocations` of the table `documents`, with its default parameters.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists
), grams AS (
  SELECT lang, 1 AS words, w[i] AS phrase FROM places
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM places WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM places WHERE i + 2 <= len(w)
), f AS (
  SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY lang, words, phrase HAVING count(*) >= 10
), n AS (
  SELECT lang, count(*) AS n FROM places GROUP BY lang
), candidates AS (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1
), cuts AS (
  SELECT c.lang, c.words, c.phrase, c.a, k, l.f AS l, r.f AS r, ((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM candidates) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ') AND l.words = c.k
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ') AND r.words = c.words - c.k
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, part AS phrase, max(a) AS a
  FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM candidates WHERE words = 3) GROUP BY lang, part
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN longer x ON x.lang = s.lang AND x.phrase = s.phrase AND s.words = 2
  WHERE x.a IS NULL OR 100 * x.a < 50 * s.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, n.n, k.score FROM ranked k JOIN n ON n.lang = k.lang WHERE k.rank <= 2000
"""
