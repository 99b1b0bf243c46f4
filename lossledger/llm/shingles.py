"""Hashes of byte stretches, words and word shingles for many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
STEP = U(0xD1342543DE82EF95)
#: A random 64-bit value for each byte (a fixed generator's), so that sums of them are spread.
BYTES = np.random.Generator(np.random.PCG64(12)).integers(0, 1 << 64, 256, U)
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
_POWERS = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2^64; kept and grown as needed."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(max(n, 1 << 20), base, U)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0][:n], _POWERS[1][:n]


class Prefixes:
    """Hashes of any stretches of one byte string, equal for equal stretches wherever they stand."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(BYTES[data] * up[:-1], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U) * STEP)


def pieces(texts: list[str | None], most: int = 1 << 20):
    """Cut a list of texts into stretches of about `most` characters, at least one text each: (first, past the last)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def shingle_sets(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text: (number of the text, hash), sorted by both.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A
    text with fewer words than `width` has one shingle, the whole sequence;
    one without words has none.
    """
    raw = [(t or "").encode().lower() for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    begin = np.cumsum([1] + [len(r) + 1 for r in raw])  # where each text begins
    blank = BLANK[data]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U)
    owner = np.searchsorted(begin, starts, "right") - 1
    word = Prefixes(data).hashes(starts, ends)
    words = np.bincount(owner, minlength=len(texts))
    left = np.cumsum(words)[owner] - np.arange(len(owner))  # words from here to the end of the text
    total, seen = np.zeros(len(word), U), np.minimum(left, width)
    factor = U(1)
    for j in range(min(width, int(words.max()))):
        here = np.flatnonzero(seen > j)
        total[here] += word[here + j] * factor
        factor = U(int(factor) * int(BASE) % (1 << 64))
    whole = (left >= width) | ((left == words[owner]) & (words[owner] < width))
    owner, total = owner[whole], mix(total[whole] + seen[whole].astype(U) * STEP)
    order = np.lexsort((total, owner))
    owner, total = owner[order], total[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (total[1:] != total[:-1])
    return owner[new], total[new]
