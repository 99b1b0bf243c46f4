"""Removal of byte strings that occur more than once, found in suffix arrays built by linear grouping.

A string of LENGTH bytes that starts at two places of the corpus has, at both,
the same anchor: the ANCHOR bytes in it with the smallest hash. Suffixes can
only share LENGTH bytes around such an anchor, so the corpus falls apart into
many small texts, one for each anchor that occurs twice, and each task builds
suffix arrays for its share:

1. Each document is cut into stretches of string starts with one anchor; only
   hashes and places are shuffled, to count anchors. What the strings of a
   stretch cover is its context; equal contexts are counted, then kept once.
2. The texts of the contexts that are left are cut out of the documents and
   meet by anchor. Read in blocks of BLOCK bytes, aligned at the anchor, a task's
   contexts form one text. In its suffix array, neighbours that agree in as
   many blocks as any repeated string must hold form a class; within each class
   the strings at every byte are grouped by a 64-bit hash.
3. An anchor with more than `CROWD` different contexts would be a hot group.
   Its contexts are dealt out in pieces of PIECE starts, which meet by all the
   bytes that their strings share and go through 2 in their turn; a piece
   that still draws a crowd has its strings counted by a 128-bit hash.
4. The repeated starts return to the documents that hold the contexts and are
   merged into removed runs.

Cases: a null text counts as empty; texts shorter than LENGTH lose nothing;
strings are judged on the input, so every copy is removed, the first included;
rows that repeat id and text are copies of each other; a string that overlaps
its own copy (a period) counts; bytes may be cut inside a character; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.llm.common import discard, id_and_text, ship_code, written
from lossledger.llm.shingles import U, Prefixes, mix, pieces

#: Length in bytes of a string that counts as repeated, and of the anchor inside it.
LENGTH, ANCHOR = 200, 40
BLOCK = 16
#: Whole blocks that any string of LENGTH bytes holds, wherever the blocks' borders lie.
SHARED = (LENGTH - BLOCK + 1) // BLOCK
#: Most different contexts that meet at an anchor before they are dealt out in pieces of so many starts.
CROWD, PIECE = 256, 24
#: A suffix array is built over about so many contexts, whole anchors at a time.
CHUNK = 2_048


def grouped_suffix_array(text: list[int]) -> list[int]:
    """The suffix array of `text`, whose last symbol must be its smallest and occur once.

    Linear grouping construction. Phase one sorts suffixes into groups by
    their longest Lyndon prefix. Groups are processed in descending order. The
    previous smaller suffix of i is the nearest one before i whose group is
    yet to be processed; pointers over processed ones are shortened as they
    are followed. The suffixes that a group's members point at move into new
    groups just above their old ones, higher the more members point at them.
    Phase two walks the order from its start: whatever precedes a placed suffix,
    along the pointers, takes the next place of its group. No renaming, no recursion.
    """
    n = len(text)
    number = {c: g for g, c in enumerate(sorted(set(text)))}
    group = [number[c] for c in text]
    members: list[list[int]] = [[] for _ in number]
    for i, g in enumerate(group):
        members[g].append(i)
    below, above = [*range(-1, len(number) - 1)], [*range(1, len(number)), -1]
    skip = list(range(n))  # skip[i] == i until i's group is processed, then some place before it
    prev = [-1] * n
    g = len(members) - 1
    while g >= 0:
        mine = [i for i in members[g] if group[i] == g]
        for i in mine:
            skip[i] = i - 1
        pointed: dict[int, int] = {}
        for i in mine:
            p = i - 1
            while p >= 0 and skip[p] != p:
                p = skip[p]
            q = i
            while q > p and skip[q] != p:  # shorten the way for those that follow
                skip[q], q = p, skip[q]
            prev[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        members[g] = mine
        if pointed:
            most = max(pointed.values())
            ranks: list[list[int]] = [[] for _ in range(most + 1)]
            for p, times in pointed.items():
                ranks[times].append(p)
            for same in reversed(ranks):
                fresh: dict[int, int] = {}
                for p in same:
                    old = group[p]
                    new = fresh.get(old)
                    if new is None:
                        new = fresh[old] = len(members)
                        members.append([])
                        below.append(old)
                        above.append(above[old])
                        if above[old] >= 0:
                            below[above[old]] = new
                        above[old] = new
                    group[p] = new
                    members[new].append(p)
        g = below[g]
    place, at = [0] * len(members), 0
    g = group[n - 1]  # the lowest group: the last symbol alone
    while g >= 0:
        place[g] = at
        at += len(members[g])
        g = above[g]
    order = [-1] * n
    order[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[place[g]] = j
            place[g] += 1
            placed[j] = 1
            j = prev[j]
    return order


def anchors(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """The stretches of string starts that share an anchor, over texts that lie one after the other in `data`.

    Each string of LENGTH bytes has an anchor: of the ANCHOR bytes long pieces
    in it the one with the smallest hash, leftmost on ties. Equal strings have
    equal anchors at equal places. Returned per stretch: the text's number, the
    first start, the number of starts, the anchor's place, a hash of the
    anchor, and one of the context, all bytes that the stretch's strings cover
    (with the anchor's place in it). Places count from the text's beginning.
    """
    whole = Prefixes(data)
    n = len(data)
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U),) * 2
    if n < LENGTH:
        return none
    at = np.arange(n - ANCHOR + 1)
    found = whole.hashes(at, at + ANCHOR)
    # The smallest hash and its place in one number: 40 bits of the one, 24 of the other.
    low = (found & ~U((1 << 24) - 1)) | at.astype(U)
    width, reach = 1, LENGTH - ANCHOR + 1
    while 2 * width <= reach:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:len(low) - (reach - width)], low[reach - width:])
    anchor = (low & U((1 << 24) - 1)).astype(np.int64)
    start = np.arange(len(anchor))
    owner = np.searchsorted(edges, start, "right") - 1
    inside = start + LENGTH <= edges[owner + 1]
    start, anchor, owner = start[inside], anchor[inside], owner[inside]
    if not len(start):
        return none
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    start, anchor, owner = start[first], anchor[first], owner[first]
    context = mix(whole.hashes(start, start + count - 1 + LENGTH) ^ (anchor - start).astype(U))
    return owner, start - edges[owner], count, anchor - edges[owner], found[anchor], context


def anchored(df: DataFrame) -> DataFrame:
    """_d, _t, first, size (number of starts * 256 + the anchor's place behind the first), anchor, context: a row per stretch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            for i, j in pieces(texts):
                data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
                for owner, first, count, place, anchor, context in _bounded(data, [len(t) for t in texts[i:j]]):
                    rows = pa.array(owner + i)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first, pa.int64()), pa.array(count * 256 + place - first, pa.int64()),
                         pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64))], names=["_d", "_t", "first", "size", "anchor", "context"])

    return df.select("_d", "_t", "text").mapInArrow(run, "_d long, _t long, first long, size long, anchor long, context long")


def _bounded(data: np.ndarray, lengths: list[int], most: int = 1 << 23):
    """`anchors` over parts of at most `most` bytes; a longer text in parts that overlap by what a string's anchor can depend on.

    A part's strings are exactly those that start in its share of the text, so
    a stretch that a border cuts comes out as two.
    """
    edges = np.cumsum([0, *lengths])
    if len(data) <= most:
        yield anchors(data, edges)
        return
    for owner, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
        for at in range(low, high, most):
            part = data[at:min(high, at + most + LENGTH - 1)]
            _, first, count, place, anchor, context = anchors(part, np.array([0, len(part)]))
            yield np.full(len(first), owner), first + (at - low), count, place + (at - low), anchor, context


def repeated_starts(texts: list[bytes], weights: list[int], places: list[int], counts: list[int]) -> list[list[tuple[int, int]]]:
    """For each context the runs (first, last) of starts whose string of LENGTH bytes occurs twice among them.

    places: where in the context the anchor begins; counts: how many starts it has.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum([0, *(len(t) for t in texts)])
    hashed = Prefixes(data)
    # The contexts as one text of blocks, aligned at their anchors, a separator after each.
    lead = np.array(places) % BLOCK
    blocks = (np.diff(base) - lead) // BLOCK
    owner = np.repeat(np.arange(len(texts)), blocks + 1)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(np.append(0, blocks[:-1] + 1)), blocks + 1)
    at = base[owner] + lead[owner] + number * BLOCK
    solid = number < blocks[owner]
    symbols = np.ones(len(owner) + 1, np.int64)
    symbols[-1] = 0
    symbols[:-1][solid] = np.unique(hashed.hashes(at[solid], at[solid] + BLOCK), return_inverse=True)[1] + 2
    order = np.array(grouped_suffix_array(symbols.tolist()))[1:]
    # Neighbours that agree in SHARED blocks are in one class.
    order = order[number[order] + SHARED <= blocks[owner[order]]]
    if not len(order):
        return [[] for _ in texts]
    reach = hashed.hashes(at[order], at[order] + SHARED * BLOCK)
    kind = np.cumsum(np.append(True, reach[1:] != reach[:-1]))
    # The strings whose first whole block stands there: they start up to a block before it.
    shift = np.arange(BLOCK)
    member = owner[order]
    start = (at[order] - base[member])[:, None] - shift
    good = (start >= 0) & (start < np.array(counts)[member][:, None])
    member, kind, shift, start = (np.broadcast_to(x, good.shape)[good] for x in (member[:, None], kind[:, None], shift, start))
    begin = base[member] + start
    string = hashed.hashes(begin, begin + LENGTH)
    by = np.lexsort((string, kind * BLOCK + shift))
    key = kind[by] * BLOCK + shift[by]
    new = np.append(True, (key[1:] != key[:-1]) | (string[by][1:] != string[by][:-1]))
    which = np.cumsum(new) - 1
    twice = np.bincount(which, np.array(weights)[member[by]])[which] >= 2
    return runs_of(member[by][twice], start[by][twice], len(texts))


def runs_of(member: np.ndarray, start: np.ndarray, n: int) -> list[list[tuple[int, int]]]:
    """For each of n members its starts as runs (first, last) of consecutive numbers."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if len(member):
        by = np.lexsort((start, member))
        member, start = member[by], start[by]
        new = np.append(True, (member[1:] != member[:-1]) | (start[1:] > start[:-1] + 1))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        for m, a, z in zip(member[first].tolist(), start[first].tolist(), start[last].tolist()):
            out[m].append((a, z))
    return out


RUNS = "array<struct<lo: long, hi: long>>"
FOUND = f"anchor long, context long, runs {RUNS}"
UNIT = "anchor long, context long, base long, size long, weight long, body binary"


def dealt(units: DataFrame) -> DataFrame:
    """Units (anchor, context, size, weight, crowded, body) -> FOUND rows, or for crowded ones their pieces, as `piece` and UNIT."""
    schema = f"{FOUND}, piece long, base long, size long, weight long, body binary"

    def cut(anchor: int, context: int, size: int, weight: int, body: bytes) -> list[tuple]:
        count, place = size >> 8, size & 255
        rows = []
        for j in range((place - count + 1) // PIECE, place // PIECE + 1):
            far, near = min(place, PIECE * j + PIECE - 1), max(place - count + 1, PIECE * j)  # how far before the anchor a start lies
            first = place - far
            core = body[place - PIECE * j:place - PIECE * j - PIECE + 1 + LENGTH]
            name = hashlib.blake2b(core, digest_size=8, key=f"{anchor},{j}".encode()).digest()
            rows.append((anchor, context, None, int.from_bytes(name, "little", signed=True), first, ((far - near + 1) << 8) + far, weight,
                         body[first:first + far - near + LENGTH]))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), *[pa.int64()] * 4, pa.binary()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                              names=["anchor", "context", "runs", "piece", "base", "size", "weight", "body"])

        def solved(held: list[tuple]) -> pa.RecordBatch:
            found = repeated_starts([x[4] for x in held], [x[3] for x in held], [x[2] & 255 for x in held], [x[2] >> 8 for x in held])
            return out([(x[0], x[1], [{"lo": a, "hi": z} for a, z in runs], None, None, None, None, None) for x, runs in zip(held, found) if runs])

        held: list[tuple] = []
        for batch in batches:
            crowd = []
            for *unit, crowded in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if crowded:
                    crowd += cut(*unit)
                    continue
                if len(held) >= CHUNK and unit[0] != held[-1][0]:
                    yield solved(held)
                    held = []
                held.append(tuple(unit))
            if crowd:
                yield out(crowd)
        if held:
            yield solved(held)

    deal = F.when(F.col("crowded"), F.xxhash64("context")).otherwise(F.col("anchor"))
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = units.withColumn("deal", deal).repartition(parts, "deal").sortWithinPartitions("deal", "context")
    return rows.select("anchor", "context", "size", "weight", "body", "crowded").mapInArrow(run, schema)


def crowds(units: DataFrame, by: str) -> DataFrame:
    """Units whose group has a weight of two or more, with `crowded` where it has too many different members."""
    groups = units.groupBy(by).agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("different")).where("total > 1")
    return units.join(written(groups.select(by, (F.col("different") > CROWD).alias("crowded")), "crowds"), by)


def solve_pieces(cut: DataFrame) -> DataFrame:
    """FOUND rows for the contexts whose pieces (piece and UNIT) are given."""
    cut = cut.select("piece", "anchor", "context", "base", "size", "weight", "body", F.xxhash64("body", "size").alias("sub"))
    same = cut.groupBy("piece", "sub").agg(F.sum("weight").alias("weight"), F.first("size").alias("size"), F.first("body").alias("body"))
    units = written(crowds(same, "piece").select(F.col("piece").alias("anchor"), F.col("sub").alias("context"), "size", "weight", "body", "crowded"), "pieces")
    found = dealt(units.where("not crowded")).select("anchor", "context", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every string of a unit with a 128-bit hash."""
        for batch in batches:
            for anchor, context, size, weight, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = size >> 8
                names = [hashlib.blake2b(body[k:k + LENGTH], digest_size=16).digest() for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * n, pa.int64()), pa.array([context] * n, pa.int64()), pa.array(range(n), pa.int64()),
                                                  pa.array([weight] * n, pa.int64()), pa.array(names, pa.binary())], names=["anchor", "context", "at", "weight", "string"])

    strings = units.where("crowded").select("anchor", "context", "size", "weight", "body").mapInArrow(
        run, "anchor long, context long, at long, weight long, string binary")
    twice = strings.groupBy("string").agg(F.sum("weight").alias("total")).where("total > 1").select("string")
    single = strings.join(twice, "string").select("anchor", "context", F.array(F.struct(F.col("at").alias("lo"), F.col("at").alias("hi"))).alias("runs"))
    back = cut.select(F.col("piece").alias("p"), F.col("sub").alias("s"), "anchor", "context", "base")
    found = found.unionByName(single).select(F.col("anchor").alias("p"), F.col("context").alias("s"), "runs")
    return back.join(found, ["p", "s"]).select(
        "anchor", "context", F.transform("runs", lambda r: F.struct((r["lo"] + F.col("base")).alias("lo"), (r["hi"] + F.col("base")).alias("hi"))).alias("runs"))


def keyed(df: DataFrame) -> DataFrame:
    """doc_id, text with _d, _t: the id and, where ids repeat, a hash of the text."""
    repeated = not df.groupBy("doc_id").count().where("count > 1").isEmpty()
    return df.withColumns({"_d": F.coalesce("doc_id", F.lit(-(1 << 63))), "_t": F.xxhash64("text") if repeated else F.lit(0).cast("long")})


def packed(docs: DataFrame) -> DataFrame:
    """_d, _t, doc_id and the text's bytes, compressed for the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([press.compress(t.encode()) for t in batch.column(3).to_pylist()], pa.binary())],
                                             names=["_d", "_t", "doc_id", "packed"])

    return docs.select("_d", "_t", "doc_id", "text").mapInArrow(run, "_d long, _t long, doc_id long, packed binary")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """_d, _t, spans: per document the stretches (lo, past hi) of bytes that repeated strings cover, unmerged."""
    stretches = written(anchored(docs), "stretches")  # read twice: for the anchors that repeat, and for their members
    # Written: a join whose sides both come straight from a shuffle can be split where an anchor is hot.
    twice = written(stretches.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    members = written(stretches.join(twice, "anchor"), "members")
    discard(stretches, twice)
    contexts = members.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("_d", "_t", "first", "size")).alias("at"))
    contexts = crowds(written(contexts.select("anchor", "context", "weight", "at.*"), "contexts"), "anchor")
    wanted = contexts.groupBy("_d", "_t").agg(F.collect_list(F.struct("anchor", "context", "first", "size", "weight", "crowded")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        names = ["anchor", "context", "size", "weight", "body", "crowded"]
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.bool_()]
        for batch in batches:
            for body, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = unpress.decompress(body)
                rows = [(w["anchor"], w["context"], w["size"], w["weight"], body[w["first"]:w["first"] + (w["size"] >> 8) - 1 + LENGTH], w["crowded"]) for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    texts = packed(docs).join(wanted, ["_d", "_t"]).dropDuplicates(["_d", "_t"]).select("packed", "wanted")
    units = texts.mapInArrow(run, "anchor long, context long, size long, weight long, body binary, crowded boolean")
    result = written(dealt(units), "found")
    found = result.where("piece is null").select("anchor", "context", "runs")
    cut = result.where("piece is not null")
    if not cut.isEmpty():
        found = found.unionByName(solve_pieces(cut))
    spans = members.join(found, ["anchor", "context"]).select("_d", "_t", "first", F.explode("runs").alias("run"))
    return spans.groupBy("_d", "_t").agg(F.collect_list(F.struct((F.col("first") + F.col("run.lo")).alias("lo"), (F.col("first") + F.col("run.hi") + LENGTH).alias("hi"))).alias("spans"))


def removed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept: the bytes that remain."""
    ship_code(df.sparkSession)
    docs = keyed(id_and_text(df, id_col, text_col))
    spans = repeated_runs(docs)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = []
                for doc_id, body, spans in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                    body, merged = unpress.decompress(body), []
                    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                        if merged and lo <= merged[-1][1]:
                            merged[-1][1] = max(hi, merged[-1][1])
                        else:
                            merged.append([lo, hi])
                    cuts = [0, *(x for pair in merged for x in pair), len(body)]
                    kept = b"".join(body[a:z] for a, z in zip(cuts[::2], cuts[1::2]))
                    rows.append((doc_id, len(body), len(body) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return (packed(docs).join(spans, ["_d", "_t"], "left").select("doc_id", "packed", "spans")
            .mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
