"""Greedy pair merging (BPE) of one short text, and a bounded memo for words that recur."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from itertools import repeat

#: Up to this many symbols, scanning all pairs for the best beats a heap.
SHORT = 48
NEVER = float("inf")


def merge_pairs(parts: list, rank: dict) -> list:
    """Merge adjacent parts until no pair has a rank: lowest rank first, leftmost on ties.

    `rank` is keyed by pairs (a, b). Long inputs use a linked list and a
    heap, O(n log n), so that a megabyte without a blank stays cheap.
    """
    if len(parts) > SHORT:
        return _merge_long(parts, lambda a, b: rank.get((a, b)))
    parts, get = list(parts), rank.get
    ranks = [get(pair, NEVER) for pair in zip(parts, parts[1:])]
    ranks.append(NEVER)
    while (best := min(ranks)) != NEVER:
        at = ranks.index(best)
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
        del ranks[at]
        if at:
            ranks[at - 1] = get((parts[at - 1], parts[at]), NEVER)
        if at + 1 < len(parts):
            ranks[at] = get((parts[at], parts[at + 1]), NEVER)
    return parts


def merge_joined(parts: list | str, rank: dict, pairs: dict | None = None) -> list:
    """The same with `rank` keyed by the joined parts a + b; `pairs` holds its entries for the first parts by (a, b)."""
    if len(parts) > SHORT:
        return _merge_long(parts, lambda a, b: rank.get(a + b))
    get = rank.get
    if pairs is None:
        ranks = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
    else:
        ranks = list(map(pairs.get, zip(parts, parts[1:]), repeat(NEVER)))
    parts = list(parts)
    ranks.append(NEVER)
    last = len(ranks) - 1
    while (best := min(ranks)) != NEVER:
        at = ranks.index(best)
        both = parts[at] = parts[at] + parts.pop(at + 1)
        del ranks[at]
        last -= 1
        if at:
            ranks[at - 1] = get(parts[at - 1] + both, NEVER)
        if at < last:
            ranks[at] = get(both + parts[at + 1], NEVER)
    return parts


def _merge_long(parts: list, rank: Callable) -> list:
    part: list = list(parts)
    n = len(part)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank(part[i], part[i + 1])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = after[i] if part[i] is not None else -1
        if j < 0 or part[i] != a or part[j] != b:
            continue
        part[i], part[j] = a + b, None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and (r := rank(part[x], part[y])) is not None:
                heapq.heappush(queue, (r, x, part[x], part[y]))
    return [p for p in part if p is not None]


class Memo(dict):
    """word -> what `make` gives for it. Emptied when it holds `most` words; long words are not kept."""

    def __init__(self, make: Callable, most: int = 600_000, longest: int = 48):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, word):
        value = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value
