"""Token counts of every prefix by dynamic programming over byte-level BPE.

A sequence of tokens is the encoding of its bytes exactly when each two
neighbours are, encoded together, left as they are. So the encoding of a
prefix ends in the one token that fits behind the encoding of a shorter
prefix, and

    count[i] = count[i - len(t)] + 1

with t that last token. The table holds count and last token's length for
each prefix of each word (a match of the pre-tokeniser) and is shared by the
words: one goes on where another with the same beginning left off. A text's
table chains those of its words. Any question about a prefix, such as
where a budget of tokens ends, is then read off without encoding again.

Cases: null text counts as empty (0 tokens); the special string inside a text
is one token, as the library's default has it; repeated rows give repeated
results; an empty table gives no rows; further input columns are ignored.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lossledger.llm.common import id_and_text, ship_code
from lossledger.llm.merging import Memo, merge_pairs

#: Unicode white space, as the pre-tokeniser's \s has it.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The byte-level pre-tokeniser's pattern (fixed by the vocabulary's format).
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+"
           rf"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: A single blank between two characters that are no white space: no match of PATTERN runs over its left side.
SEAM = rf"(?<=[^{SPACES}])(?= [^{SPACES}])"


def byte_letters() -> dict[int, str]:
    """The letter by which a byte stands in the vocabulary: itself if printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


#: The entries of longer words are not kept: their prefixes would be many and large.
LONG = 48


class PrefixTable:
    """For one word: counts[i] tokens encode its first i bytes, the last of them `last[i]` bytes long."""

    __slots__ = ("counts", "last")

    def __init__(self, counts: tuple, last: tuple):
        self.counts, self.last = counts, last

    def cut(self, tokens: int) -> int:
        """Bytes of the word's first `tokens` tokens."""
        at = len(self.counts) - 1
        while self.counts[at] > tokens:
            at -= self.last[at]
        return at


class TokenCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level BPE without normalisation or a leading blank is read")
        back = {c: b for b, c in byte_letters().items()}
        raw = lambda s: bytes(back[c] for c in s)
        added = [t["content"] for t in spec["added_tokens"]]
        self.tokens = {raw(s) for s in spec["model"]["vocab"] if s not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        #: The last three bytes of a prefix -> the lengths that its last token can have, longest first.
        lengths: dict[bytes, set[int]] = {}
        for t in self.tokens:
            if len(t) > 2:
                lengths.setdefault(t[-3:], {2, 1}).add(len(t))
        self.lengths = {end: tuple(sorted(found, reverse=True)) for end, found in lengths.items()}
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.words, self.seams = regex.compile(PATTERN), regex.compile(SEAM)
        self.fits = Memo(self._fits, most=400_000)
        self.states: dict[bytes, int] = {}
        self.most_states = 1_000_000
        self.totals = Memo(self._total, most=400_000)

    def _fits(self, pair: tuple[bytes, bytes]) -> bool:
        joined = pair[0] + pair[1]
        return merge_pairs([joined[i:i + 1] for i in range(len(joined))], self.rank) == list(pair)

    def _last(self, word: bytes, end: int, ending) -> int:
        """Length of the last token of the first `end` bytes; ending(i) is the last token of the first i."""
        tokens = self.tokens
        for k in self.lengths.get(word[max(0, end - 3):end], (2, 1)):
            if k <= end:
                token = word[end - k:end]
                if token in tokens and (k == end or self.fits[ending(end - k), token]):
                    return k
        raise ValueError(f"no token ends at byte {end} of {word!r}")

    def state(self, word: bytes) -> int:
        """The table's entry for all of `word`: its count * 256 + the length of its last token.

        Entries are kept by prefix, so a word goes on from the longest prefix
        that any word before it had.
        """
        states = self.states
        if (found := states.get(word)) is not None:
            return found
        if len(word) > LONG:
            table = self.table_of(word)
            return table.counts[-1] << 8 | table.last[-1]
        if len(states) > self.most_states:
            states.clear()
        known = len(word) - 1
        while known and word[:known] not in states:
            known -= 1
        ending = lambda i: word[i - (states[word[:i]] & 255):i]
        for end in range(known + 1, len(word) + 1):
            k = self._last(word, end, ending)
            found = ((states[word[:end - k]] & ~255) + 256 if k < end else 256) | k
            states[word[:end]] = found
        return found

    def table_of(self, word: bytes) -> PrefixTable:
        """Counts and last tokens of all prefixes of one word."""
        counts, last = [0], [0]
        if len(word) <= LONG:
            for i in range(1, len(word) + 1):
                entry = self.state(word[:i])
                counts.append(entry >> 8)
                last.append(entry & 255)
        else:
            for end in range(1, len(word) + 1):
                k = self._last(word, end, lambda i: word[i - last[i]:i])
                counts.append(counts[end - k] + 1)
                last.append(k)
        return PrefixTable(tuple(counts), tuple(last))

    def _total(self, chunk: str) -> int:
        """Tokens of a stretch of words that no match crosses."""
        return sum([self.state(w.encode()) >> 8 for w in self.words.findall(chunk)])

    def stretches(self, text: str) -> Iterator[str | None]:
        """The text between special tokens; None for each special token."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at:m.start()]
            yield None
            at = m.end()
        yield text[at:]

    def count(self, text: str) -> int:
        total, get = 0, self.totals
        for s in self.stretches(text):
            total += 1 if s is None else sum([get[c] for c in self.chunks(s)])
        return total

    def count_and_cut(self, text: str, tokens: int) -> tuple[int, int]:
        """All tokens of the text, and the UTF-8 bytes of its first `tokens` ones; only the chunk at the border is looked into."""
        total, done, cut, get = 0, 0, -1, self.totals
        for s in self.stretches(text):
            chunks = [None] if s is None else self.chunks(s)
            sizes = [1] if s is None else [get[c] for c in chunks]
            here = sum(sizes)
            if cut < 0 and total + here > tokens:
                before = list(accumulate(sizes, initial=total))
                k = bisect_right(before, tokens) - 1
                cut = len(text[:done + (sum(map(len, chunks[:k])) if s is not None else 0)].encode())
                left = tokens - before[k]
                for word in self.words.findall(chunks[k]) if s is not None else ():
                    table = self.table_of(word.encode())
                    cut += table.cut(left)
                    left -= table.counts[-1]
                    if left < 0:
                        break
            total += here
            done += len(s) if s is not None else len(self.special.match(text, done)[0])
        return total, cut if cut >= 0 else len(text.encode())

    def chunks(self, s: str) -> list[str]:
        """Cut at each single blank between words; the words of a chunk don't depend on its neighbours."""
        if not s:
            return []
        parts = s.split(" ")
        if "" not in parts and not any(p[0].isspace() or p[-1].isspace() for p in parts if not (p[0].isalnum() and p[-1].isalnum())):
            return [parts[0], *[" " + p for p in parts[1:]]]
        return self.seams.split(s)

    def table(self, text: str) -> TextTable:
        return TextTable(self, text)


class TextTable:
    """The counts of all prefixes of one text: its words, the tokens before each, and the words' own tables."""

    def __init__(self, counter: TokenCounter, text: str):
        self.counter, self.text = counter, text
        self.words: list[str] = []
        self.special: set[int] = set()
        for s in counter.stretches(text):
            if s is None:
                m = counter.special.match(text, sum(map(len, self.words)))
                self.special.add(len(self.words))
                self.words.append(m[0])
            else:
                self.words += counter.words.findall(s)
        self.starts = list(accumulate(map(len, self.words), initial=0))
        sizes = (1 if i in self.special else counter.state(w.encode()) >> 8 for i, w in enumerate(self.words))
        self.before = list(accumulate(sizes, initial=0))

    def total(self) -> int:
        return self.before[-1]

    def at(self, prefix: int) -> int:
        """Tokens of the first `prefix` characters, as if they were the whole text.

        Only the word that the prefix ends in can differ from the whole text's
        words, and with it the white space before it.
        """
        if prefix >= len(self.text):
            return self.total()
        k = max(0, bisect_right(self.starts, prefix) - 1)
        while k and (k in self.special or self.starts[k] == prefix or self.text[self.starts[k]].isspace()):
            k -= 1
        return self.before[k] + self.counter.count(self.text[self.starts[k]:prefix])

    def cut(self, tokens: int) -> int:
        """UTF-8 bytes of the longest run of whole tokens, from the start, within the budget."""
        k = bisect_right(self.before, tokens) - 1
        done = len(self.text[:self.starts[k]].encode())
        if k == len(self.words) or k in self.special:
            return done
        return done + self.counter.table_of(self.words[k].encode()).cut(tokens - self.before[k])


@lru_cache(maxsize=4)
def token_counter(path: str) -> TokenCounter:
    """One counter, with the words it has seen, per Python worker and path."""
    return TokenCounter(path)


def token_counts(df: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cut_bytes (bytes of the first `limit` tokens).

    Arrow batches in, one row per document out; nothing is shuffled.
    """
    ship_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer_path)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                n, cut = counter.count_and_cut(text, limit)
                rows.append((len(text.encode()), n, n > limit, cut))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.int64()), strict=True))],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_bytes"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long")
