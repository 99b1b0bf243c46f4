"""I-Match fingerprints: hashes of a document's terms within randomised subsets of a mid-frequency lexicon.

The lexicon keeps the terms whose inverse document frequency, log(N / df),
lies in a band: neither in nearly every document nor in next to none. Each
subset holds a seeded random share of the lexicon; a document's entry for a
subset is the hash of the document's distinct terms in it, in sorted order.
Subsets come in shares from 1/4096 to a half of the lexicon, eight of each. A
subset that holds none of the terms that an edit changed keeps its hash; small
subsets, of a term or two, so agree about as often as terms do. Likeness is
the part of entries that agree among the smallest subsets, as many sizes of
them as it takes to find `ENOUGH` entries filled in either fingerprint.

The lexicon goes out as a broadcast. Its size is bounded whatever the number
of documents: a document has d distinct terms on average, and each term of
the band is in at least `RAREST` of the documents, so there are at most
d / RAREST terms.

Cases: a null text counts as empty; a text without lexicon terms is
fingerprinted over all its terms, one without terms has empty entries only,
and two such fingerprints are alike (1.0) if equal; equal texts have equal
fingerprints; rows that repeat an id follow each other in the order of a hash
of their text; null ids come last; a single document is its own next; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.llm.common import id_and_text, ship_code
from lossledger.llm.shingles import U, mix

TERMS = re.compile(r"\w+")
#: The band, as shares of the documents: terms in fewer or in more of them are left out.
RAREST, COMMONEST = 1 / 2_000, 1 / 8
#: Share of the lexicon in a subset: from the smallest to the largest, several subsets of each.
EACH = 8
SHARES = np.repeat(2.0 ** -np.arange(12, 0, -1), EACH)
SEEDS = mix(np.arange(1, len(SHARES) + 1).astype(U))
LIMITS = (SHARES * 2.0 ** 64).astype(U)
#: So many filled entries decide the likeness.
ENOUGH = 8


def terms_of(text: str) -> set[str]:
    return set(TERMS.findall(text.lower()))


def document_frequencies(df: DataFrame) -> DataFrame:
    """term, n: in how many of the rows (doc_id, text) a term occurs; counted in each task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["term", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                seen.update(terms_of(text))
                if len(seen) > 400_000:
                    yield out(seen)
                    seen = Counter()
        yield out(seen)

    return df.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(df: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST) -> list[str]:
    """The terms of the band, sorted; at most (distinct terms per document) / `rarest` of them."""
    n = df.count()
    low, high = max(2, math.ceil(rarest * n)), max(2, math.floor(commonest * n))
    found = document_frequencies(df).where(F.col("n").between(low, high)).select("term")
    return sorted(r[0] for r in found.toLocalIterator())


class Fingerprinter:
    def __init__(self, terms: list[str]):
        self.index = {t: i for i, t in enumerate(terms)}
        self.hashes, self.member = self._of(terms)

    @staticmethod
    def _of(terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = b"".join(hashlib.blake2b(t.encode(), digest_size=8).digest() for t in terms)
        hashes = np.frombuffer(raw, "<u8").astype(U)
        return hashes, mix(hashes[:, None] ^ SEEDS) < LIMITS

    def __call__(self, text: str) -> np.ndarray:
        """One 16-bit entry per subset; 0 where the text has no term in the subset."""
        terms = terms_of(text)
        rows = sorted(self.index[t] for t in terms & self.index.keys())
        hashes, member = (self.hashes[rows], self.member[rows]) if rows else self._of(sorted(terms))
        total = mix((member * hashes[:, None]).sum(0, dtype=U) + member.sum(0).astype(U)) >> U(48)
        return np.where(member.any(0), np.maximum(total, U(1)), U(0)).astype(np.uint16)


def text_of(entries: np.ndarray) -> str:
    return entries.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = ((a | b) > 0).reshape(-1, EACH).sum(1).cumsum()
    agree = ((a == b) & (a > 0)).reshape(-1, EACH).sum(1).cumsum()
    size = min(int(np.searchsorted(filled, ENOUGH)), len(filled) - 1)
    return float(agree[size] / filled[size]) if filled[size] else 1.0


_FINGERPRINTERS: dict[str, Fingerprinter] = {}


def fingerprinter_of(terms: list[str]) -> Fingerprinter:
    """One per Python worker and lexicon."""
    key = hashlib.sha256("\n".join(terms).encode()).hexdigest()
    if key not in _FINGERPRINTERS:
        _FINGERPRINTERS.clear()
        _FINGERPRINTERS[key] = Fingerprinter(terms)
    return _FINGERPRINTERS[key]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every text; nothing is shuffled but the term counts behind the lexicon."""
    ship_code(df.sparkSession)
    rows = id_and_text(df, id_col, text_col)
    terms = df.sparkSession.sparkContext.broadcast(lexicon(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = fingerprinter_of(terms.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_of(make(t)) for t in batch.column(1).to_pylist()], pa.string())],
                                             names=["doc_id", "fingerprint"])

    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def in_descending_order(rows: DataFrame) -> DataFrame:
    """bucket, ghost, doc_id, packed text: buckets of neighbouring ids, each in one partition, in descending order.

    Each bucket ends in a ghost, a copy of the row that follows its last one.
    The driver sees the borders of the buckets and each one's largest id,
    which are as many as there are buckets, not the rows. Texts travel
    compressed.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * parts
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = rows.withColumns({"at": order, "tie": F.xxhash64("text")})
    cuts = rows.agg(F.percentile_approx("at", [k / n for k in range(1, n)], 100 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    rows = rows.withColumn("bucket", F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<long>"), lambda c: c < F.col("at"))))
    heads = sorted(tuple(r) for r in rows.groupBy("bucket").agg(F.max("at")).collect())
    # The row after a bucket's last is the first of the next lower bucket; after the lowest, of the highest.
    follows = {head: [] for _, head in heads}
    for (bucket, _), (_, head) in zip(heads, [heads[-1], *heads[:-1]] if heads else [], strict=True):
        follows[head].append(bucket)
    pack_schema = "bucket int, ghost int, doc_id long, at long, tie long, packed binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([press.compress(t.encode()) for t in batch.column(5).to_pylist()], pa.binary())],
                                             names=["bucket", "ghost", "doc_id", "at", "tie", "packed"])

    own = rows.select("bucket", F.lit(0).alias("ghost"), "doc_id", "at", "tie", "text")
    if follows:
        pairs = F.create_map(*[x for head, buckets in follows.items() for x in (F.lit(head).cast("long"), F.lit(buckets).cast("array<int>"))])
        ghosts = rows.where(F.col("at").isin(*follows)).select(F.explode(F.element_at(pairs, F.col("at"))).alias("bucket"), F.lit(1).alias("ghost"), "doc_id", "at", "tie", "text")
        own = own.unionByName(ghosts)
    return (own.mapInArrow(pack, pack_schema).repartition(parts, "bucket")
            .sortWithinPartitions("bucket", "ghost", F.col("at").desc(), "tie").select("bucket", "ghost", "doc_id", "packed"))


def edited(text: str, following: str) -> str:
    """The last third of the characters replaced by as many of the following text's first, or all of it."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def stability(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    `edited` with the next document in descending order of the id shows how
    much of a fingerprint an edit leaves, against what unrelated texts share.
    """
    ship_code(df.sparkSession)
    rows = id_and_text(df, id_col, text_col)
    terms = df.sparkSession.sparkContext.broadcast(lexicon(rows))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        make, unpress = fingerprinter_of(terms.value), zstandard.ZstdDecompressor()
        last = None
        for batch in batches:
            out = []
            for bucket, ghost, doc_id, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ghost and (last is None or last[1] or last[0] != bucket):
                    continue  # one ghost is enough
                text = unpress.decompress(packed).decode()
                entries = make(text)
                if last and not last[1] and last[0] == bucket:
                    _, _, before, own, theirs = last
                    new = edited(own, text)
                    changed = make(new)
                    out.append((before, len(own), hashlib.sha256(new.encode()).hexdigest(), text_of(theirs), text_of(changed),
                                likeness(theirs, changed), likeness(theirs, entries)))
                last = (bucket, ghost, doc_id, text, entries)
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_descending_order(rows).mapInArrow(run, schema)
