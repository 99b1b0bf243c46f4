"""SentencePiece encoding and decoding with byte spans of the original text.

A model file holds pieces with scores, and a compiled character map: a double
array trie whose keys are byte strings and whose values point at
replacements. `Normalizer` walks the text with the longest matching key at
each place and notes, for each byte it writes, the source byte it came from.
`PieceModel.encode` merges pieces over the normalised text and projects their
borders through that alignment, so every piece has the span of original bytes
that it stands for. No piece of the models in use runs from a word into the
blank of the next, so words are encoded one by one and remembered until the task ends.

In a task: Arrow batches in, one row per document out; nothing is shuffled.
Cases: a null text is the empty text (begin and end ids only); characters
without a piece become byte pieces (or the unknown id when the model has
none); rows with equal ids or texts give equal rows; an empty table gives no
rows; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lossledger.llm.common import id_and_text, portions, ship_code, trimmed
from lossledger.llm.merging import Memo, merge_joined

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """The compiled map: trie size (4 bytes), trie units (4 bytes each), then replacements that end with a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.texts = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at `at`, and its replacement."""
        if not self.units:
            return None
        units, found = self.units, None
        step = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node = step(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= step(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if not found:
            return None
        return found[0], self.texts[found[1]:self.texts.index(b"\0", found[1])]


@dataclass
class Normalizer:
    charsmap: CharacterMap
    dummy_prefix: bool
    collapse: bool
    escape: bool

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the original byte it begins at."""
        if not text:
            return "", np.zeros(1, np.int64)
        if self.charsmap.units or self.collapse or not self.escape:
            return self._walk(text.encode())
        # Nothing but blanks changes: each becomes the three bytes of the mark.
        source = np.frombuffer(text.encode(), np.uint8)
        origin = np.repeat(np.arange(len(source)), np.where(source == 32, 3, 1))
        lead = np.zeros(3 * self.dummy_prefix, np.int64)
        return SPACE * self.dummy_prefix + text.replace(" ", SPACE), np.concatenate([lead, origin, [len(source)]])

    def _walk(self, text: bytes) -> tuple[str, np.ndarray]:
        out, origin, at = bytearray(), [], 0
        blank = SPACE.encode() if self.escape else b" "

        def take() -> tuple[int, bytes]:
            if found := self.charsmap.longest(text, at):
                return found
            size = 1
            while at + size < len(text) and text[at + size] & 0xC0 == 0x80:
                size += 1
            return size, text[at:at + size]

        while self.collapse and at < len(text):
            size, piece = take()
            if piece != b" ":
                break
            at += size
        if at == len(text):
            return "", np.zeros(1, np.int64)
        if self.dummy_prefix:
            out += blank
            origin += [at] * len(blank)
        after_blank = self.collapse
        while at < len(text):
            size, piece = take()
            piece = piece.lstrip(b" ") if after_blank else piece
            for b in piece:
                new = blank if b == 32 else bytes([b])
                out += new
                origin += [at] * len(new)
            if piece:
                after_blank = piece.endswith(b" ")
            at += size
            after_blank &= self.collapse
        while self.collapse and out.endswith(blank):
            at = origin[len(out) - len(blank)]
            del out[-len(blank):], origin[len(out):]
        return out.decode(), np.array([*origin, at], np.int64)


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        n = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or any(p.type in (USER_DEFINED, UNUSED) for p in proto.pieces):
            raise ValueError("only BPE models without user-defined or unused pieces are read")
        self.normalizer = Normalizer(CharacterMap(n.precompiled_charsmap), n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces)
        self.surface = [p.piece for p in proto.pieces]
        self.kind = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = proto.trainer_spec.unk_id
        self.unknown_surface = proto.trainer_spec.unk_surface or " ⁇ "
        self.begin, self.end = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        #: A mark after another character inside a piece would let pieces run across words.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.words, self.atoms = Memo(self._word, 300_000), Memo(self._atom, 200_000)
        self.adjacent = {pair for p in self.ids for pair in zip(p, p[1:])}
        self.pairs = {(p[0], p[1]): r for p, r in self.score.items() if len(p) == 2}
        self.decoded = [self._surface(i) for i in range(len(self.surface))]
        u4 = lambda n: np.array([n], "<u4").tobytes()
        self.made = {p: (u4(i), u4(len(p.encode())), self.decoded[i]) for p, i in self.ids.items()}

    def _word(self, word: str) -> tuple[bytes, bytes, bytes]:
        """Ids and byte length of each piece (32-bit integers), and the bytes that the ids decode to.

        A word falls apart between characters that stand side by side in no piece.
        """
        joined = list(map(self.adjacent.__contains__, zip(word, word[1:])))
        if False not in joined:
            return self._atom(word)
        cuts = [i for i, together in enumerate(joined, 1) if not together]
        return tuple(map(b"".join, zip(*[self.atoms[word[i:j]] for i, j in zip([0, *cuts], [*cuts, len(word)])])))

    def _atom(self, atom: str) -> tuple[bytes, bytes, bytes]:
        if (one := self.made.get(atom)) and len(atom) == 1:
            return one
        found = [self.made.get(p) or self._fallback(p) for p in merge_joined(atom, self.score, self.pairs)]
        return found[0] if len(found) == 1 else tuple(map(b"".join, zip(*found)))

    def _fallback(self, piece: str) -> tuple[bytes, bytes, bytes]:
        """A character without a piece: byte pieces, the last of which stands for it, or the unknown id."""
        raw = piece.encode()
        if self.byte_ids:
            ids, lengths = [self.byte_ids[b] for b in raw], [0] * (len(raw) - 1) + [len(raw)]
            return np.array(ids, "<u4").tobytes(), np.array(lengths, "<u4").tobytes(), raw
        return np.array([self.unknown], "<u4").tobytes(), np.array([len(raw)], "<u4").tobytes(), self.decoded[self.unknown]

    def _split(self, normal: str) -> list[str]:
        if not self.by_word:
            return [normal] if normal else []
        if normal[:1] == SPACE and SPACE + SPACE not in normal and not normal.endswith(SPACE):
            return [SPACE + w for w in normal[1:].split(SPACE)]
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", normal)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids without begin and end, and each piece's first and past-the-last byte of `text`."""
        normal, origin = self.normalizer(text)
        found = [self.words[w] for w in self._split(normal)]
        ids = np.frombuffer(b"".join([f[0] for f in found]), "<u4")
        ends = np.cumsum(np.frombuffer(b"".join([f[1] for f in found]), "<u4"), dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return ids, origin[starts], origin[ends]

    def _surface(self, i: int) -> bytes:
        if self.kind[i] == CONTROL:
            return b""
        if self.kind[i] == UNKNOWN:
            return self.unknown_surface.encode()
        if self.kind[i] == BYTE:
            return bytes([int(self.surface[i][3:5], 16)])
        return self.surface[i].replace(SPACE, " ").encode()

    def decode(self, ids) -> str:
        """The text of a list of ids: begin and end ids vanish, byte pieces join, invalid bytes become U+FFFD."""
        ids = [int(i) for i in ids if self.kind[i] != CONTROL]
        out, k = [], 0
        while k < len(ids):
            if self.kind[ids[k]] != BYTE:
                out.append(self.decoded[ids[k]].decode())
                k += 1
                continue
            run = bytearray()
            while k < len(ids) and self.kind[ids[k]] == BYTE:
                run += self.decoded[ids[k]]
                k += 1
            out.append(_lossy(bytes(run)))
        lead = bool(ids) and self.normalizer.dummy_prefix and self.surface[ids[0]].startswith(SPACE)
        return "".join(out)[lead:]

    def encode_and_decode(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray, bytes]:
        """`encode`'s result with begin and end ids, and the bytes that those ids decode to."""
        normal, origin = self.normalizer(text)
        found = list(map(self.words.__getitem__, self._split(normal)))
        edge = [np.array([i], "<u4").tobytes() for i in (self.begin, self.end)]
        ids = b"".join([edge[0], *[f[0] for f in found], edge[1]])
        ends = np.cumsum(np.frombuffer(b"".join([f[1] for f in found]), "<u4"), dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        back = b"".join([f[2] for f in found])
        if back[:1] == b" " and self.normalizer.dummy_prefix and normal.startswith(SPACE):
            back = back[1:]
        return ids, origin[starts], origin[ends], back


def _lossy(run: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that does not belong to a valid character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[k:k + size].decode())
                    k += size
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                k += 1
        return "".join(out)


def forgetting(model: PieceModel, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`rows`, after which (or a failure) the model drops the words it has seen: idle workers keep only the model."""
    def dropping() -> Iterator[pa.RecordBatch]:
        try:
            yield from rows
        finally:
            model.words.clear()
            model.atoms.clear()

    return trimmed(dropping())


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    """One model, with the words it has seen, per Python worker and path."""
    return PieceModel(path)


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, starts, ends (little-endian unsigned 32-bit integers), decoded: the operator's whole result."""
    ship_code(df.sparkSession)

    def rows_of(model: PieceModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = [model.encode_and_decode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([r[0] for r in rows], pa.binary()),
                    *(pa.array([r[c].astype("<u4").tobytes() for r in rows], pa.binary()) for c in (1, 2)),
                    pa.array([r[3].decode() for r in rows], pa.string())], names=["doc_id", "ids", "starts", "ends", "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        return forgetting(model, rows_of(model, batches))

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, starts binary, ends binary, decoded string")


def encode_digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the digests of `encode`'s result, taken in the task that made it.

    n_tokens counts all ids, begin and end included; spans_sha256 is over all
    starts, then all ends; n_covered is the number of original bytes up to the
    end of the last piece.
    """
    ship_code(df.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, n_covered long"

    def rows_of(model: PieceModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda b: hashlib.sha256(b).hexdigest()
        for batch in portions(batches, 1):
            rows = []
            for text in batch.column(1).to_pylist():
                ids, starts, ends, back = model.encode_and_decode(text)
                spans = starts.astype("<u4").tobytes() + ends.astype("<u4").tobytes()
                rows.append((len(ids) // 4, digest(ids), digest(back), digest(spans), int(ends[-1]) if len(ends) else 0))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:4]), pa.array(cols[4], pa.int64())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "n_covered"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        return forgetting(model, rows_of(model, batches))

    return id_and_text(df, id_col, text_col).mapInArrow(run, schema)
