"""The conversation trie against a plain trie of dictionaries and against SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lossledger.llm import prefix_trie, registry
from tests.oracle_compare import compare, duck

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """rows: (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((t is not None, t or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()), (role, text)))
    plain = {c: [x for _, x in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = plain.get(c - c % 20, [])  # ids of the tests are not negative
        full = tuple(base[:h] + own[h:])
        ends[full].append(c)
        for d in range(len(full) + 1):
            members[full[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for path, m in members.items():
        below, stack = [], [path]
        while stack:
            below.append(stack.pop())
            stack += children[below[-1]]
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children[path]), sum(not children[p] for p in below),
                    sum((len(members[p]) - 1) * words(p) for p in below), hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, key string, node string")


def found(df, **kwargs):
    return sorted([tuple(r) for r in prefix_trie.nodes(df, **kwargs).select(*COLUMNS).collect()], key=str)


@pytest.mark.parametrize("chunk", [1, 2, 7, 8192])
def test_equals_a_plain_trie(spark, chunk):
    r = random.Random(chunk)
    rows = []
    for c in r.sample(range(130), 90):
        for t in range(r.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, r.choice(["user", "user", None]), r.choice(["a b", "a b", "c", "", None, "d\te f"])))
    rows += [(200 + k, t, "user", f"same {t}") for k in range(40) for t in range(4)]  # copies over many chunks
    rows += [(300, None, "user", "first"), (300, 0, "user", "second"), (301, 5, "a", "tie"), (301, 5, "b", "tie"), (301, 5, "b", "tie"),
             (None, 0, "user", "nobody"), (305, 0, None, None)]
    assert found(table(spark, rows), chunk=chunk) == brute(rows)


def test_empty_and_turnless(spark):
    assert found(table(spark, [(1, 0, "u", "x")]).limit(0)) == []
    only = [(c, 0, "u", "x") for c in range(1, 20)]  # the base is absent: conversations with h > 0 have no turns
    assert found(table(spark, only)) == brute(only)


def test_wide_nodes_and_long_paths(spark):
    rows = [(20 * k, 0, "u", f"t{k}") for k in range(700)] + [(20 * 701, t, "u", f"long {t}") for t in range(400)]
    assert found(table(spark, rows), chunk=300) == brute(rows)


def test_radix_tree_grows_and_compresses():
    tree = prefix_trie.RadixTree()
    keys = [bytes([b]) + bytes(15) for b in range(256)]
    rooms = set()
    for i, k in enumerate(keys):
        tree.insert(k, i)
        rooms.add(tree.root.room)
    assert rooms == {4, 16, 48, 256} and all(tree.root.child(k[0]).prefix == bytes(15) for k in keys)
    parent, turn, ends = tree.turns()
    assert sorted(turn[1:]) == keys and set(parent[1:]) == {0} and sorted(e for x in ends for e in x) == list(range(256))


def test_equals_sql(spark):
    df = registry.QUERIES["op12_prefix_trie"](spark, SMALL)
    res = duck(SMALL).execute(registry.SQL["op12_prefix_trie"])
    assert compare([tuple(r) for r in df.collect()], df.columns, res.fetchall(), [d[0] for d in res.description]) is None
