"""Byte-level BPE by tree concatenation: halves are encoded apart, then joined exactly.

A sequence of tokens is the encoding of its bytes exactly when each two
neighbours are, encoded together, left as they are. So two encoded halves are
joined by encoding a window of tokens around the cut anew: if its first token
is the left half's and its last the right half's, everything outside stands.
While a side does not agree, the window grows on that side.

Two levels use it. A long word (a match of the pre-tokeniser without a
cut inside) is halved down to `LEAF` bytes. A long text is halved, at any
character, down to `block` bytes; its blocks are encoded in as many tasks as
there are, and come together in a tree. There the window grows in words first:
the text around the cut is split anew until the words of both sides agree,
then the tokens of a word that the cut ran through are joined as above.

Texts of up to `block` bytes are encoded where they are read. Blocks of longer
ones are shuffled twice, as bytes and as ids; a task holds one document's ids
at a time, which is the row it returns.

Cases: a null text counts as empty (no ids, empty text back); the special
string inside a text is its own id, also where a cut runs through it; rows
that repeat id and text are encoded once if long, and returned as often as
they occur; rows with equal or null ids and different texts are kept apart by
a hash of the text; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.llm.common import id_and_text, ship_code
from lossledger.llm.merging import Memo, merge_pairs
from lossledger.llm.token_counts import PATTERN, SEAM, byte_letters

#: Words of up to this many bytes are merged in one go.
LEAF = 64
#: Texts of more bytes are cut into blocks that are encoded in parallel.
BLOCK = 1 << 16


class Encoded(NamedTuple):
    """Ids, and for each whether it begins a word."""

    ids: np.ndarray
    begins: np.ndarray


class TreeCodec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level BPE without normalisation or a leading blank is read")
        back = {c: b for b, c in byte_letters().items()}
        raw = lambda s: bytes(back[c] for c in s)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of = {raw(s): i for s, i in model["vocab"].items() if s not in added}
        self.special_id = {s.encode(): i for s, i in added.items()}
        size = 1 + max([*self.id_of.values(), *added.values()])
        self.surface = [b""] * size
        for b, i in (self.id_of | self.special_id).items():
            self.surface[i] = b
        self.one = [bytes([b]) for b in range(256)]
        self.length = np.array([len(b) for b in self.surface], np.int64)
        self.rank = {tuple(map(raw, m.split(" ") if isinstance(m, str) else m)): k for k, m in enumerate(model["merges"])}
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.words, self.seams = regex.compile(PATTERN), regex.compile(SEAM)
        #: A word ends before this many bytes ahead of a cut: then nothing beyond the cut has a say in it.
        self.margin = 4 * (2 + max(map(len, added), default=0))
        self.word_ids = Memo(self._word, most=200_000)
        self.chunk_ids = Memo(self._chunk, most=1_000_000)

    # -- one word -----------------------------------------------------------------------------------------------------

    def _merged(self, word: bytes) -> list[int]:
        return list(map(self.id_of.__getitem__, merge_pairs(list(map(self.one.__getitem__, word)), self.rank)))

    def word(self, word: bytes) -> list[int]:
        """Ids of one word; a long one by halves."""
        if len(word) <= LEAF:
            return self._merged(word)
        half = len(word) // 2
        return self.concatenated(self.word(word[:half]), self.word(word[half:]))

    def concatenated(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of two strings in one word, from the ids of each: windows around the join, until both sides agree."""
        if not left or not right:
            return left or right
        a, b = 2, 2
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self._merged(b"".join(self.surface[i] for i in (*left[-a:], *right[:b])))
            agree_left = a == len(left) or window[0] == left[-a]
            agree_right = b == len(right) or window[-1] == right[b - 1]
            if agree_left and agree_right:
                return left[:-a] + window + right[b:]
            a, b = a * (1 if agree_left else 2), b * (1 if agree_right else 2)

    def _word(self, word: str) -> bytes:
        ids = self.word(word.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    # -- one text -----------------------------------------------------------------------------------------------------

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.removeprefix(" ").isalpha():  # one word
            return self._word(chunk)
        return b"".join([self.word_ids[w] for w in self.words.findall(chunk)])

    def _chunks(self, s: str) -> list[str]:
        """Cut at single blanks between words: no word runs over them, whatever lies around."""
        parts = s.split(" ")
        if "" not in parts and not any(p[0].isspace() or p[-1].isspace() for p in parts if not (p[0].isalnum() and p[-1].isalnum())):
            return [parts[0], *[" " + p for p in parts[1:]]]
        return self.seams.split(s)

    def encode(self, text: str) -> bytes:
        """All ids as little-endian 32-bit integers."""
        out, at, get = [], 0, self.chunk_ids.__getitem__
        for m in self.special.finditer(text) if self.special else ():
            out += [*map(get, self._chunks(text[at:m.start()])), np.array([self.special_id[m[0].encode()]], "<u4").tobytes()]
            at = m.end()
        out += map(get, self._chunks(text[at:] if at else text))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text that the ids stand for, in UTF-8; bytes that form no character become U+FFFD."""
        out = b"".join(map(self.surface.__getitem__, ids.tolist()))
        return out.decode("utf-8", "replace").encode()

    # -- blocks of a text ---------------------------------------------------------------------------------------------

    def scan(self, raw: bytes) -> list[bytes]:
        """The words of a text in order, special strings among them."""
        text, out, at = raw.decode(), [], 0
        for m in self.special.finditer(text) if self.special else ():
            out += [w.encode() for w in self.words.findall(text[at:m.start()])] + [m[0].encode()]
            at = m.end()
        return out + [w.encode() for w in self.words.findall(text[at:])]

    def encode_block(self, raw: bytes) -> Encoded:
        words = self.scan(raw)
        ids = [[self.special_id[w]] if w in self.special_id else self.word(w) for w in words]
        begins = np.zeros(sum(map(len, ids)), bool)
        begins[np.cumsum([0, *map(len, ids)])[:-1]] = True
        return Encoded(np.array([i for x in ids for i in x], np.uint32), begins)

    def _bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.surface.__getitem__, ids.tolist()))

    def join(self, a: Encoded, b: Encoded) -> Encoded:
        """The encoding of two neighbouring blocks' text, from each block's own."""
        if not len(a.ids) or not len(b.ids):
            return a if len(a.ids) else b
        places = lambda e: np.concatenate([[0], np.cumsum(self.length[e.ids])])
        a_at, b_at = places(a), places(b)
        cut = int(a_at[-1])
        a_words, b_words = np.flatnonzero(a.begins), np.flatnonzero(b.begins)
        # The first word of the left side that what follows the cut could change.
        ends = np.append(a_at[a_words[1:]], cut)
        first = int(a_words[np.searchsorted(ends, cut - self.margin, side="right")])
        left_raw = self._bytes(a.ids[first:])
        b_starts = (b_at[b_words] + cut).tolist()
        window = 8
        while True:
            upto = int(b_words[window]) if window < len(b_words) else len(b.ids)
            words = self.scan(left_raw + self._bytes(b.ids[:upto]))
            safe = cut + int(b_at[upto]) - (self.margin if upto < len(b.ids) else 0)
            at, taken = int(a_at[first]), []
            for w in words:
                at += len(w)
                taken.append(w)
                if at > safe:
                    break
                if at >= cut and (at == cut + int(b_at[-1]) or ((k := bisect_left(b_starts, at)) < len(b_starts) and b_starts[k] == at)):
                    last = int(np.searchsorted(b_at, at - cut))
                    return self._joined(a, b, first, last, taken, int(a_at[first]), cut)
            window *= 4

    def _joined(self, a: Encoded, b: Encoded, first: int, last: int, words: list[bytes], at: int, cut: int) -> Encoded:
        """`a` up to token `first`, then `words` (from byte `at`), then `b` from token `last`."""
        ids, begins = [a.ids[:first]], [a.begins[:first]]
        for w in words:
            if w in self.special_id:
                new = [self.special_id[w]]
            elif len(w) > LEAF and at < cut < at + len(w) and (halves := self._halves(a, b, first, last, at, at + len(w), cut)):
                new = self.concatenated(*halves)
            else:
                new = self.word(w)
            ids.append(np.array(new, np.uint32))
            begins.append(np.arange(len(new)) == 0)
            at += len(w)
        return Encoded(np.concatenate([*ids, b.ids[last:]]), np.concatenate([*begins, b.begins[last:]]))

    def _halves(self, a: Encoded, b: Encoded, first: int, last: int, start: int, end: int, cut: int) -> tuple[list[int], list[int]] | None:
        """The ids that both blocks have for the word from byte `start` to `end`, if it is one word in each."""
        tail, head = a.ids[first:], b.ids[:last]
        tail_at = cut - np.cumsum(self.length[tail][::-1])[::-1]
        head_at = cut + np.concatenate([[0], np.cumsum(self.length[head])])
        i, j = int(np.searchsorted(tail_at, start)), int(np.searchsorted(head_at, end))
        if i == len(tail) or tail_at[i] != start or head_at[j] != end or a.begins[first + i + 1:].any() or b.begins[1:j].any():
            return None
        if tail[i:].max(initial=0) in self.special_id.values() or head[:j].max(initial=0) in self.special_id.values():
            return None
        return tail[i:].tolist(), head[:j].tolist()

    def tree(self, blocks: list[Encoded]) -> Encoded:
        """Neighbours are joined two by two until one is left."""
        while len(blocks) > 1:
            blocks = [reduce(self.join, blocks[k:k + 2]) for k in range(0, len(blocks), 2)]
        return blocks[0]


def cut_text(raw: bytes, block: int) -> list[bytes]:
    """Halves of halves, at characters, until no part has more than `block` bytes."""
    if len(raw) <= max(block, 8):
        return [raw]
    half = len(raw) // 2
    while raw[half] & 0xC0 == 0x80:
        half += 1
    return cut_text(raw[:half], block) + cut_text(raw[half:], block)


@lru_cache(maxsize=4)
def tree_codec(path: str) -> TreeCodec:
    """One codec, with the words it has seen, per Python worker and path."""
    return TreeCodec(path)


_ROW = "doc_id long, ids binary, decoded binary"
_DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _result(codec: TreeCodec, ids: bytes, digests: bool) -> tuple:
    back = codec.decode(np.frombuffer(ids, "<u4"))
    if digests:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()
    return ids, back


def _arrays(rows: list[tuple], digests: bool) -> list[pa.Array]:
    kinds = (pa.int64(), pa.string(), pa.string()) if digests else (pa.binary(), pa.binary())
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]


def _encoded(df: DataFrame, path: str, id_col: str, text_col: str, block: int, digests: bool) -> DataFrame:
    ship_code(df.sparkSession)
    schema = _DIGEST if digests else _ROW
    names = [c.split()[0] for c in schema.split(", ")]
    texts = id_and_text(df, id_col, text_col)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tree_codec(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                rows = [_result(codec, codec.encode(t), digests) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *_arrays(rows, digests)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks = cut_text(text.encode(), block)
                for k in range(0, len(blocks), 64):
                    n = len(blocks[k:k + 64])
                    yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array([digest] * n), pa.array(range(k, k + n), pa.int64()),
                                                      pa.array(blocks[k:k + 64], pa.binary())], names=["doc_id", "digest", "no", "raw"])

    def encode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tree_codec(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                found = [codec.encode_block(raw) for raw in part.column("raw").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "digest", "no", "copies")), pa.array([e.ids.astype("<u4").tobytes() for e in found], pa.binary()),
                     pa.array([np.packbits(e.begins).tobytes() for e in found], pa.binary())], names=["doc_id", "digest", "no", "copies", "ids", "begins"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tree_codec(path)
        rows = (r for batch in batches for k in range(0, batch.num_rows, 64) for r in zip(*(c.to_pylist() for c in batch.slice(k, 64).columns), strict=True))
        for (doc_id, _), group in groupby(rows, key=lambda r: r[:2]):
            blocks = []
            for *_, copies, ids, begins in group:
                ids = np.frombuffer(ids, "<u4")
                blocks.append(Encoded(ids, np.unpackbits(np.frombuffer(begins, np.uint8), count=len(ids)).astype(bool)))
            result = _result(codec, codec.tree(blocks).ids.astype("<u4").tobytes(), digests)
            yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([copies], pa.int64()), *_arrays([result], digests)],
                                             names=["doc_id", "copies", *names[1:]])

    size = F.octet_length("text")
    short = texts.where(size <= block).mapInArrow(whole, schema)
    # Equal blocks of equal rows are summed up before they are sent.
    spread = (texts.where(size > block).select("doc_id", F.sha2("text", 256).alias("digest"), "text")
              .mapInArrow(cut, "doc_id long, digest string, no long, raw binary")
              .groupBy("doc_id", "digest", "no").agg(F.max("raw").alias("raw"), F.count(F.lit(1)).alias("copies")))
    long = (spread.mapInArrow(encode_blocks, "doc_id long, digest string, no long, copies long, ids binary, begins binary")
            .repartition("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "no")
            .mapInArrow(assemble, schema.replace("doc_id long", "doc_id long, copies long")))
    return short.unionByName(long.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*names))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded (the text that they give back)."""
    return _encoded(df, path, id_col, text_col, block, False).withColumn("decoded", F.decode("decoded", "UTF-8"))


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens and the digests of `encode`'s ids and text, taken in the task that made them."""
    return _encoded(df, path, id_col, text_col, block, True)
