"""Language identification by unigrams over pieces, summed over all segmentations.

The vocabulary is the fixed piece list of a public tokenizer. Each language
has a probability for each piece; a word's probability is the sum, over all
ways to cut it into pieces, of the product of the pieces' probabilities: the
forward algorithm's last value. Pieces hold a word mark only at their start,
so the segmentations of a text are those of its words, and a text's log
probability is the sum of its words'. Expectation maximisation over the same
sums (forward-backward) fits the probabilities.

Words are runs of letters (Unicode's categories L), lower-cased, with the mark
in front. Training reads the text and label of about `TRAINING_DOCUMENTS`
documents a language at most, chosen by a hash of the id among those that are
not held out, so a rare language is learned as well; every document is scored,
whole. Texts alone decide a prediction.

Each language is fitted in a task of its own, from its words' counts; the
driver gets the probabilities of the pieces in use, at most one per piece and
language. Both sums run over many words of equal length at once, with numpy:
a piece is found by a 64-bit hash of its characters, rolled from one length to
the next. A task keeps the scores of words that it has seen, up to a bound.

Cases: a null text, or one without a letter, gives `und` with score 0; a
language that ties goes to the first in alphabetical order; rows without a
label train nothing; repeated rows give repeated results; without any labelled
row every text is `und`; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossledger.llm.common import portions, ship_code, trimmed

LETTERS = regex.compile(r"\p{L}+")
MARK = "▁"
#: The classifier is fitted on at most about this many labelled documents of each language.
TRAINING_DOCUMENTS = 2_000
#: Probability, in any language, of a character that no piece holds.
STRANGE = 1e-9
#: Words longer than this are scored in parts of this length, so a stray megabyte of letters stays linear.
LONGEST_WORD = 64
#: Words whose scores a task keeps until its end, and characters of text that it takes at a time.
MOST_WORDS, STRETCH = 200_000, 1_000_000


def words_of(text: str) -> list[str]:
    return [part for w in LETTERS.findall(text.lower()) for part in parts_of(w)]


def parts_of(word: str) -> list[str]:
    return [MARK + word[i:i + LONGEST_WORD] for i in range(0, len(word), LONGEST_WORD)]


@lru_cache(maxsize=4)
def piece_list(model_path: str) -> frozenset:
    """The lower-case pieces made of letters, with or without the word mark in front."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_byte(i) and not sp.is_unknown(i))
    return frozenset(p for p in pieces if p == MARK or (p.removeprefix(MARK).isalpha() and p == p.lower()))


#: For words of one length, from left to right: start, end, the words that have a piece there, and the pieces' numbers.
Edges = list[tuple[int, int, np.ndarray, np.ndarray]]


class Lattice:
    """Finds the pieces that can stand at each place of many words; a single character always may, as number `unknown`."""

    _FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces):
        self.pieces = sorted(pieces)
        self.unknown = len(self.pieces)
        self.longest = max(map(len, self.pieces), default=1)
        hashes = np.array([self._hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        beginnings = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
        self.begins, self.whole = np.zeros(1 << 20, bool), np.zeros(1 << 20, bool)
        self.begins[[self._hash(b) >> 44 for b in beginnings]] = True
        self.whole[hashes >> np.uint64(44)] = True

    @classmethod
    def _hash(cls, text: str) -> int:
        h = 0
        for c in text:
            h = (h ^ ord(c)) * int(cls._FACTOR) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        return h

    def edges(self, words: list[str]) -> Edges:
        """For words of one and the same length."""
        size = len(words[0])
        letters = np.array(words, f"<U{size}").view("<u4").reshape(len(words), size).astype(np.uint64)
        out: Edges = []
        for i in range(size):
            alive, h = np.arange(len(words)), np.zeros(len(words), np.uint64)
            for j in range(i + 1, min(size, i + self.longest) + 1):
                h = (h ^ letters[alive, j - 1]) * self._FACTOR
                h ^= h >> np.uint64(29)
                short = h >> np.uint64(44)
                at = np.flatnonzero(self.whole[short])
                place = np.minimum(np.searchsorted(self.hashes, h[at]), max(self.unknown - 1, 0))
                found = self.hashes[place] == h[at] if self.unknown else np.zeros(0, bool)
                rows, numbers = alive[at[found]], self.numbers[place[found]]
                if j == i + 1:
                    every = np.full(len(words), self.unknown)
                    every[rows] = numbers
                    rows, numbers = alive, every
                if len(rows):
                    out.append((i, j, rows, numbers))
                going = np.flatnonzero(self.begins[short])
                if not len(going):
                    break
                alive, h = alive[going], h[going]
        return out


def by_length(words, most: int) -> Iterator[list[str]]:
    """The words in lists of one length, each of about `most` characters."""
    groups: dict[int, list[str]] = defaultdict(list)
    for w in words:
        groups[len(w)].append(w)
    for size, group in sorted(groups.items()):
        step = max(1, most // size)
        for k in range(0, len(group), step):
            yield group[k:k + step]


def expected_counts(words: dict[str, int], lattice: Lattice, prob: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over all segmentations of the counted words; the last number is of unknown characters."""
    out = np.zeros(lattice.unknown + 1)
    for group in by_length(words, 1_000_000):
        n, edges = len(group[0]), lattice.edges(group)
        forward, backward = np.zeros((n + 1, len(group))), np.zeros((n + 1, len(group)))
        forward[0] = backward[n] = 1.0
        for i, j, rows, numbers in edges:
            forward[j, rows] += forward[i, rows] * prob[numbers]
        for i, j, rows, numbers in reversed(edges):
            backward[i, rows] += backward[j, rows] * prob[numbers]
        times = np.array([words[w] for w in group], float)
        scale = np.divide(times, forward[n], out=np.zeros(len(group)), where=forward[n] > 0)
        for i, j, rows, numbers in edges:
            out += np.bincount(numbers, forward[i, rows] * prob[numbers] * backward[j, rows] * scale[rows], len(out))
    return out


def fit(counts: dict[str, int], lattice: Lattice, rounds: int = 2, smoothing: float = 0.05) -> np.ndarray:
    """The pieces' probabilities in one language, from its words' counts; the last is that of unknown characters."""
    # Long pieces are rarer than short ones a priori; the rounds correct this start.
    prob = np.array([*(30.0 ** -len(p) for p in lattice.pieces), STRANGE])
    for _ in range(rounds):
        seen = expected_counts(counts, lattice, prob)
        prob = (seen + smoothing) / (seen.sum() + smoothing * lattice.unknown)
        prob[-1] = STRANGE
    return prob


class Scorer:
    """Scores texts; keeps each word's log probabilities as a row of a table."""

    def __init__(self, languages: tuple[str, ...], probability: dict[str, tuple[float, ...]]):
        self.languages, self.probability = languages, probability
        self.lattice = Lattice(probability)
        self.matrix = np.array([*(probability[p] for p in self.lattice.pieces), (STRANGE,) * len(languages)], float)
        self.row: dict[str, int] = {}
        self.table = np.zeros((0, len(languages)))

    def logs(self, words: list[str]) -> np.ndarray:
        """Per word (one length) and language the log of its probability: the forward algorithm over all segmentations."""
        n = len(words[0])
        sums, shift = np.zeros((n + 1, len(words), len(self.languages))), np.zeros(len(words))
        sums[0], at = 1.0, 0
        for i, j, rows, numbers in self.lattice.edges(words):
            if i > at:  # all sums up to i are final; keep them in a float's range
                at = i
                low = np.flatnonzero(sums[i].max(1) < 1e-100)
                sums[i:, low] *= 1e100
                shift[low] -= 100 * math.log(10)
            sums[j, rows] += sums[i, rows] * self.matrix[numbers]
        with np.errstate(divide="ignore"):
            out = np.log(sums[n]) + shift[:, None]
        for k in np.flatnonzero((sums[n] < 1e-290).any(1)):
            out[k] = self._scaled(words[k])
        return out

    def _scaled(self, word: str) -> list[float]:
        """The same for one word, with logs throughout."""
        with np.errstate(divide="ignore"):
            logs = np.log(self.matrix)
        f = np.full((len(word) + 1, len(self.languages)), -np.inf)
        f[0] = 0.0
        for i, j, _, numbers in self.lattice.edges([word]):
            f[j] = np.logaddexp(f[j], f[i] + logs[numbers[0]])
        return f[-1].tolist()

    def _learn(self, words) -> None:
        """Rows for words (without mark) that have none."""
        parts = {w: parts_of(w) for w in words}
        of_part: dict[str, np.ndarray] = {}
        for group in by_length({p for ps in parts.values() for p in ps}, max(1, 1_000_000 // len(self.languages))):
            of_part.update(zip(group, self.logs(group), strict=True))
        rows = [of_part[ps[0]] if len(ps) == 1 else np.sum([of_part[p] for p in ps], 0) for ps in parts.values()]
        self.row.update(zip(parts, range(len(self.table), len(self.table) + len(parts)), strict=True))
        self.table = np.concatenate([self.table, rows])

    def forget(self) -> None:
        self.row, self.table = {}, self.table[:0].copy()

    def scores(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """For each text the best language and its posterior under equal priors."""
        out: list[tuple[str, float]] = []
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= STRETCH):
                size += len(texts[upto] or "")
                upto += 1
            out += self._stretch(texts[at:upto])
            at = upto
        return out

    def _stretch(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words: list[str] = []
        ends = []
        for text in texts:
            words += LETTERS.findall(text.lower()) if text else ()
            ends.append(len(words))
        if not words or not self.languages:
            return [("und", 0.0)] * len(texts)
        new = set(words) - self.row.keys()
        if new:
            if len(self.row) + len(new) > MOST_WORDS:
                self.forget()
                new = set(words)
            self._learn(sorted(new))
        rows = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        starts = np.array([0, *ends[:-1]])
        some = np.flatnonzero(np.array(ends) > starts)
        total = np.add.reduceat(self.table[rows], starts[some])
        best = total.argmax(1)
        score = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        out = [("und", 0.0)] * len(texts)
        for k, b, x in zip(some.tolist(), best.tolist(), score.tolist(), strict=True):
            out[k] = (self.languages[b], x)
        return out


def is_held_out(id_col: str = "doc_id") -> Column:
    """Rows that training never sees: CRC-32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hash_limits(sizes: dict[str, int], most: int) -> dict[str, int]:
    """language -> the 63-bit hash below which about `most` of its rows fall; languages with no more than that are left out."""
    return {lang: (most << 63) // n for lang, n in sizes.items() if n > most}


def training_words(df: DataFrame, id_col: str, text_col: str, lang_col: str, most: int) -> DataFrame:
    """lang, word, n over the training documents: about `most` documents a language at most."""
    usable = df.where(~is_held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    limits = hash_limits({r[0]: r[1] for r in usable.groupBy(F.col(lang_col)).count().collect()}, most)
    chosen = usable
    if limits:
        limit = F.create_map(*[c for lang, x in sorted(limits.items()) for c in (F.lit(lang), F.lit(x).cast("long"))])[F.col(lang_col)]
        chosen = usable.where(limit.isNull() | (F.shiftrightunsigned(F.xxhash64(F.lit("train"), F.col(id_col)), 1) < limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(rows_of(batches))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in portions(batches, 0):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[lang].update(words_of(text))
        rows = [(a, w, c) for a, words in seen.items() for w, c in words.items()]
        for k in range(0, len(rows), 50_000):
            cols = list(zip(*rows[k:k + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())],
                                             names=["lang", "word", "n"])

    return (chosen.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(run, "lang string, word string, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


_SCORERS: dict[str, Scorer] = {}


def scorer_of(key: str, languages: tuple[str, ...], probability: dict) -> Scorer:
    """One scorer per Python worker and model: its piece index outlives a task, the words that it has seen do not."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(languages, probability)
    return _SCORERS[key]


def fitted(df: DataFrame, model_path: str, id_col: str, text_col: str, lang_col: str, most: int):
    """The languages and the model, learned from `df`, as a broadcast: a probability per piece of the fixed vocabulary and language.

    Pieces that a language does not use share its least probability.
    """
    ship_code(df.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        lattice = Lattice(piece_list(model_path))
        table = table.sort_by("word")
        prob = fit(dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True)), lattice)[:-1]
        used = np.flatnonzero(prob > prob.min())
        pieces = [lattice.pieces[k] for k in used.tolist()] + [None]
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(pieces)), "piece": pa.array(pieces, pa.string()),
                         "p": pa.array(np.append(prob[used], prob.min()))})

    words = training_words(df, id_col, text_col, lang_col, most)
    found = words.groupBy("lang").applyInArrow(run, "lang string, piece string, p double").toArrow()
    by_language: dict[str, dict[str | None, float]] = defaultdict(dict)
    for lang, piece, p in zip(*(found.column(c).to_pylist() for c in ("lang", "piece", "p")), strict=True):
        by_language[lang][piece] = p
    languages = tuple(sorted(by_language))
    probability = {p: tuple(by_language[x].get(p, by_language[x][None]) for x in languages) for p in sorted(piece_list(model_path))} if languages else {}
    return df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, languages, probability))


def identify(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             most: int = TRAINING_DOCUMENTS) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the posterior of the prediction under equal priors)."""
    model = fitted(df, model_path, id_col, text_col, lang_col, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(rows_of(batches))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer_of(*model.value)
        for batch in portions(batches, 1):
            found = score.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])
        score.forget()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return (rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
            .select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score"))


def keep_identified(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    least: float = 0.5, most: int = TRAINING_DOCUMENTS) -> DataFrame:
    """The rows of `df` whose text is in a learned language with a posterior of at least `least`, all columns kept.

    The rows are judged where they are: predictions are not joined back.
    """
    model = fitted(df, model_path, id_col, text_col, lang_col, most)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(rows_of(batches))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer_of(*model.value)
        for batch in portions(batches, at):
            found = score.scores(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x[0] != "und" and x[1] >= least for x in found], pa.bool_()))
        score.forget()

    return df.mapInArrow(run, df.schema)
