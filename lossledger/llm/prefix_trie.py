"""The trie of conversations that share their first turns, by adaptive radix trees.

Each turn (role, text) has a fixed-width, big-endian id: the 128 bits of its
MD5. A conversation is the byte string of its turns' ids. Conversations are
ordered by (byte string, conv_id), numbered, and cut into chunks of `CHUNK`
neighbours. A task builds one adaptive radix tree for a chunk: nodes grow
from 4 to 16, 48 and 256 children, runs of bytes without a branch lie in one
node, and only depths that are a multiple of the id's width emit a node of
the trie. Texts never move: only ids and word counts are shuffled.

A node of the trie whose conversations lie in several chunks is emitted by
each, with sums that add up. So that distinct nodes count once, each chunk
also gets its neighbours' adjoining conversations: a node on the path of the
one before was counted there, and a node on the path of the one after may yet
get a child. Equal conversations are neighbours with a number each, so a
conversation that a third of all rows repeat spreads over many chunks. The
members that end at a node arrive as sorted lists, one per chunk, and are
hashed one after the other.

A conversation is one row of ids from there on, 16 bytes a turn.

Cases: rows with a null conv_id belong to no conversation and are left out;
null turns come first; turns with equal number go by id; null role or text is
empty; equal turns repeat as often as they occur; a base conversation that is
absent gives no turns; further columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.llm.common import WORDS, discard, ship_code, written
from lossledger.operators.keys import sequential_key

#: Bytes of a turn's id.
WIDTH = 16
#: Conversations in one tree.
CHUNK = 8192


class Node:
    """A node of the radix tree: the bytes after the parent's branch, its children by next byte, and who ends here.

    Up to 4 or 16 children: their bytes in a row. Up to 48: a table from byte
    to place. Beyond: one place per byte.
    """

    __slots__ = ("prefix", "ends", "room", "bytes", "children")

    def __init__(self, prefix: bytes, ends: list[int]):
        self.prefix, self.ends = prefix, ends
        self.room, self.bytes, self.children = 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.room <= 16:
            at = self.bytes.find(byte)
            return self.children[at] if at >= 0 else None
        if self.room == 48:
            at = self.bytes[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def add(self, byte: int, node: Node) -> None:
        if self.room < 256 and len(self.children) == self.room:
            self._grow()
        if self.room <= 16:
            self.bytes.append(byte)
            self.children.append(node)
        elif self.room == 48:
            self.children.append(node)
            self.bytes[byte] = len(self.children)
        else:
            self.children[byte] = node

    def _grow(self) -> None:
        pairs = list(self.branches())
        self.room = {4: 16, 16: 48, 48: 256}[self.room]
        self.bytes = bytearray(256) if self.room == 48 else bytearray()
        self.children = [None] * 256 if self.room == 256 else []
        for byte, node in pairs:
            self.add(byte, node)

    def branches(self) -> Iterator[tuple[int, Node]]:
        if self.room <= 16:
            return zip(list(self.bytes), list(self.children), strict=True)
        if self.room == 48:
            return ((b, self.children[at - 1]) for b, at in enumerate(self.bytes) if at)
        return ((b, node) for b, node in enumerate(self.children) if node is not None)


class RadixTree:
    def __init__(self):
        self.root = Node(b"", [])

    def insert(self, key: bytes, member: int) -> None:
        """Members of equal keys are kept in the order of their insertion."""
        node, at = self.root, 0
        while True:
            prefix = node.prefix
            if not key.startswith(prefix, at):
                self._split(node, key, at)
                prefix = node.prefix
            at += len(prefix)
            if at == len(key):
                node.ends.append(member)
                return
            below = node.child(key[at])
            if below is None:
                node.add(key[at], Node(key[at + 1:], [member]))
                return
            node, at = below, at + 1

    @staticmethod
    def _split(node: Node, key: bytes, at: int) -> None:
        """Cut the node's bytes where `key` leaves them; what follows becomes its only child."""
        prefix, same = node.prefix, 0
        while at + same < len(key) and key[at + same] == prefix[same]:
            same += 1
        below = Node(prefix[same + 1:], node.ends)
        below.room, below.bytes, below.children = node.room, node.bytes, node.children
        node.prefix, node.ends, node.room, node.bytes, node.children = prefix[:same], [], 4, bytearray(), []
        node.add(prefix[same], below)

    def turns(self) -> tuple[list[int], list[bytes], list[list[int]]]:
        """The trie by turns, parents first: each node's parent, last turn, and the members that end there."""
        parent, turn, ends = [-1], [b""], [[]]
        stack = [(self.root, 0, b"")]  # a tree node, the trie node above it, and the bytes since then
        while stack:
            node, above, rest = stack.pop()
            rest += node.prefix
            while len(rest) >= WIDTH:
                parent.append(above)
                turn.append(rest[:WIDTH])
                ends.append([])
                above, rest = len(parent) - 1, rest[WIDTH:]
            if node.ends:
                ends[above] = node.ends
            stack += [(below, above, rest + bytes([b])) for b, below in node.branches()]
        return parent, turn, ends


PARTIAL = ("node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, "
           "saved_tokens long, chunk long, ends string")


def partial_nodes(members: list[tuple[int, bytes]], words: dict[bytes, int], before: bytes | None, after: bytes | None, chunk: int) -> list[tuple]:
    """Rows of PARTIAL for one chunk: `members` (conv_id, key) in order of key, then conv_id; the neighbours' keys."""
    tree = RadixTree()
    for conv, key in members:
        tree.insert(key, conv)
    parent, turn, ends = tree.turns()
    size = len(parent)
    depth, node = [0] * size, [hashlib.md5(b"").digest()] * size
    old, open_ = [before is not None] * size, [after is not None] * size
    for i in range(1, size):
        p = parent[i]
        d = depth[i] = depth[p] + 1
        node[i] = hashlib.md5(node[p] + turn[i]).digest()
        old[i] = old[p] and before[(d - 1) * WIDTH:d * WIDTH] == turn[i]
        open_[i] = open_[p] and after[(d - 1) * WIDTH:d * WIDTH] == turn[i]
    n = [len(e) for e in ends]
    least = [min(e, default=None) for e in ends]
    inside, children, leaves, saved = [0] * size, [0] * size, [0] * size, [0] * size
    for i in range(size - 1, -1, -1):
        if not inside[i] and not open_[i]:
            leaves[i] = 1
        w = words[turn[i]] if i else 0
        saved[i] += n[i] * w - (0 if old[i] else w)
        if i:
            p = parent[i]
            n[p] += n[i]
            least[p] = least[i] if least[p] is None else min(least[p], least[i])
            inside[p] += 1
            children[p] += not old[i]
            leaves[p] += leaves[i]
            saved[p] += saved[i]
    return [(node[i], node[parent[i]] if i else None, depth[i], least[i], n[i], children[i], leaves[i], saved[i], chunk,
             ",".join(map(str, ends[i])) if ends[i] else None) for i in range(size)]


def rebuilt(conversations: DataFrame, every: int = 20) -> DataFrame:
    """conv_id, key (the ids of its turns), words (of each turn), the first turns taken from the conversation `every` divides.

    h = CRC-32 of the decimal conv_id modulo 4 turns come from there.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn_id = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turns = (conversations.where(F.col("conv_id").isNotNull())
             .select(F.col("conv_id").cast("long").alias("conv_id"),
                     F.struct(F.col("turn").alias("turn"), turn_id.alias("id"), F.regexp_count(text, F.lit(WORDS)).alias("words")).alias("t")))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    joined = own.withColumn("base", base).join(heads, "base", "left").withColumn("h", h)
    sequence = F.concat(F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("own", 1, 0)),
                        F.slice("own", F.col("h") + 1, F.size("own")))
    return joined.withColumn("s", sequence).select(
        "conv_id", F.unhex(F.array_join(F.transform("s", lambda t: t["id"]), "")).alias("key"), F.transform("s", lambda t: t["words"]).alias("words"))


def _chunked(numbered: DataFrame, chunk: int) -> DataFrame:
    """Rows with their chunk, and copies of each chunk's first and last row for the chunks beside it (`side` 1 and -1)."""
    own = F.floor((F.col("n") - 1) / chunk).cast("long")
    place = lambda to, side: F.struct(to.alias("chunk"), F.lit(side).alias("side"))
    last, first = F.col("n") % chunk == 0, (F.col("n") % chunk == 1 % chunk) & (F.col("n") > 1)
    places = F.filter(F.array(place(own, 0), F.when(last, place(own + 1, -1)), F.when(first, place(own - 1, 1))), lambda x: x.isNotNull())
    return numbered.withColumn("place", F.explode(places)).select("place.chunk", "place.side", "n", "conv_id", "key", "words")


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("n")
    sides, convs, keys, words = (table.column(c).to_pylist() for c in ("side", "conv_id", "key", "words"))
    before = next((k for k, s in zip(keys, sides, strict=True) if s < 0), None)
    after = next((k for k, s in zip(keys, sides, strict=True) if s > 0), None)
    members = [(c, k) for c, k, s in zip(convs, keys, sides, strict=True) if not s]
    count = {k[i * WIDTH:(i + 1) * WIDTH]: w for k, ws, s in zip(keys, words, sides, strict=True) if not s for i, w in enumerate(ws)}
    rows = partial_nodes(members, count, before, after, table.column("chunk")[0].as_py()) if members else []
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in PARTIAL.split(", ")])


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of one node, in order, into one hash; no more than a batch of lists is held."""
    rows = (r for batch in batches for r in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True))
    done: list[tuple] = []
    names = ["node", "ends_sha256"]
    for node, group in groupby(rows, key=lambda r: r[0]):
        digest, comma = hashlib.sha256(), b""
        for _, ends in group:
            digest.update(comma + ends.encode())
            comma = b","
        done.append((node, digest.hexdigest()))
        if len(done) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=names)
            done = []
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=names)


def trie(sequences: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Nodes of the trie of `sequences` (conv_id, key, words): node and parent ids, depth and the statistics of `nodes`."""
    ship_code(sequences.sparkSession)
    rows = written(sequences, "conversations")
    numbered = sequential_key(rows, ["key", "conv_id"], "n")
    partial = written(_chunked(numbered, chunk).groupBy("chunk").applyInArrow(_build, PARTIAL), "trie")
    stats = partial.groupBy("node", "parent", "depth").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    ends = (partial.where(F.col("ends").isNotNull()).select("node", "chunk", "ends").repartition("node").sortWithinPartitions("node", "chunk")
            .mapInArrow(_hash_ends, "node binary, ends_sha256 string"))
    found = written(stats.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))), "nodes")
    discard(rows, partial)
    return found


def nodes(conversations: DataFrame, chunk: int = CHUNK, every: int = 20) -> DataFrame:
    """Per node of the rebuilt conversations' trie: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    found = trie(rebuilt(conversations, every), chunk)
    # The children's side is the one that a node with very many children makes large, and the one that can be split.
    parents = found.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return found.join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: DuckDB SQL for `nodes` of the table `conversations`.
SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT conv_id, role, text, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS place
  FROM turns
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
             lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM numbered)
), parts AS (
  SELECT c.conv_id, t.place, t.role, t.text, t.words FROM convs c JOIN numbered t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL
  SELECT c.conv_id, t.place + 3, t.role, t.text, t.words FROM convs c JOIN numbered t ON t.conv_id = c.conv_id AND t.place > c.h
), sequences AS (
  SELECT c.conv_id, coalesce(p.turns, []) AS turns, coalesce(p.words, []) AS words
  FROM convs c LEFT JOIN (SELECT conv_id, list(sha256(strlen(role) || ':' || role || text) ORDER BY place) AS turns, list(words ORDER BY place) AS words
                          FROM parts GROUP BY conv_id) p USING (conv_id)
), steps AS (
  SELECT conv_id, d AS depth, array_to_string(turns[1:d], '/') AS node, CASE WHEN d > 0 THEN array_to_string(turns[1:d - 1], '/') END AS parent,
         CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words, d = len(turns) AS ends
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM sequences)
), trie AS (
  SELECT depth, node, parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM steps GROUP BY depth, node, parent
), children AS (
  SELECT parent, count(*) AS n FROM trie WHERE depth > 0 GROUP BY parent
), full_trie AS (
  SELECT t.*, coalesce(c.n, 0) AS n_children FROM trie t LEFT JOIN children c ON c.parent = t.node
), members AS (
  SELECT DISTINCT s.node AS top, s.depth AS top_depth, u.node AS node FROM steps s JOIN steps u ON u.conv_id = s.conv_id AND u.depth >= s.depth
), sums AS (
  SELECT m.top, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(f.saved) AS saved_tokens
  FROM members m JOIN full_trie f ON f.node = m.node GROUP BY m.top
)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_trie f JOIN sums s ON s.top = f.node LEFT JOIN full_trie p ON p.node = f.parent
"""
