"""Near-duplicates by HyperMinHash: compressed registers, banded, then confirmed on whole shingle sets.

A document's shingle hashes fall into 128 buckets by their top bits. A
bucket's register describes the smallest hash in it by the number of leading
zeros (6 bits) and the 10 bits behind the leading one: 16 bits instead of 64,
0 if the bucket is empty. Bands of four registers, 32 of them, are the keys
under which documents meet. Two sets with a similarity of exactly 0.75 agree
in a register about as often, so they meet in none of the bands about five
times in a million; at 0.8 it is five times in a hundred million.

1. Documents with equal sets become one node, named by a hash of the set.
2. In each band's bucket every node is paired with the bucket's smallest node
   only, so a bucket makes as many pairs as it has nodes. A pair that one
   bucket of several nodes makes alone waits for step 5.
3. Pairs whose registers, corrected for accidental agreement, leave no doubt
   are let go; the others are confirmed on the whole texts: of each node the
   most promising pair first, the others only where that has not joined both.
4. A bucket whose nodes are then in one component is done: further links in
   it join nothing new. In the others a few turns choose new pivots, first the
   node that shares its buckets with most others (the middle of a family of
   copies), then at random in proportion to that; nodes of other components
   are paired with the pivot alone. What a turn joins is one component in the
   next, so a family at the threshold costs rows by its size, not its square.
5. The nodes of the buckets still open are the rest. They are
   compared by their rarest shingles: in any order of all shingles, two sets
   with a similarity of 0.75 have one in common among the first quarter of
   each. Frequent shingles, estimated on a bounded sample, come last in the
   order, so a passage that many documents share makes no pairs. Holders of a
   shingle in its largest component meet those outside it, not each other.
6. Components are the smallest labels that spread over the confirmed links.

Nothing is capped: step 5 takes whatever the turns left, and its filter is exact
for any sample. Texts are shuffled once, compressed, for steps 3 to 5; no
task and no driver sees a bucket, a component or a set of links whole.

Cases: a null or blank text has no shingles and no links; a text of fewer
than five words has one shingle; rows that repeat id and text are one node,
and `near_duplicates` calls each row with the smallest id kept, while
`deduplicated` leaves one row of each component, whatever ids are null or
repeat; null ids are ignored when the smallest id is sought; an empty table
gives no rows; further columns are ignored by `near_duplicates` and kept by
`deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossledger.llm.common import boxed, discard, id_and_text, portions, ship_code, trimmed, unboxed, written
from lossledger.llm.shingles import U, mix, pieces, shingle_sets

BUCKET_BITS, MANTISSA = 7, 10
BANDS, ROWS = 32, 4
REGISTERS = 1 << BUCKET_BITS
WIDTH = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Pairs are let go below this estimate, more than six standard deviations under the threshold,
#: and only where so many registers are filled that the estimate has that precision.
HOPELESS, SURE = 0.5, 64
#: The order of shingles is estimated on at most about so many nodes, and holds so many frequent ones.
SAMPLE_NODES, FREQUENT = 4_000, 200_000
#: A shingle of more holders is hot; a pair looks back over so many hot shingles for an earlier one in common.
FEW, LOOK_BACK = 8, 32
#: Turns of new pivots before the exact filter, at most, and while one pair in so many is a link; they change what the
#: filter costs, not what is found.
TURNS, WORTH = 3, 4
NO_BAND = bytes(2 * ROWS)


def registers(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """The registers (n x 128, 16 bits) of n sets, from (set, hash) in order."""
    out = np.zeros((n, REGISTERS), np.uint16)
    bucket = (hashes >> U(64 - BUCKET_BITS)).astype(np.int64)
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])
    rest = (hashes[first] >> U(8)) & U((1 << 49) - 1)  # 49 bits: exact as a float
    size = np.frexp(rest.astype(float))[1]
    shift = size - 1 - MANTISSA
    mantissa = np.where(shift >= 0, rest >> np.maximum(shift, 0).astype(U), rest << np.maximum(-shift, 0).astype(U)) & U((1 << MANTISSA) - 1)
    out[owner[first], bucket[first]] = (49 - size + 1) * (1 << MANTISSA) + mantissa.astype(np.int64)
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard similarity of rows of registers, and how many registers are filled in either.

    Of two independent sets 0.17 * 2^(p - r) registers agree by accident (the
    limit for large sets); these are taken off.
    """
    filled = ((a | b) > 0).sum(1)
    accident = 0.169919487159739 * 2.0 ** (BUCKET_BITS - MANTISSA) * filled / REGISTERS
    agree = ((a == b) & (a > 0)).sum(1)
    return np.maximum(agree - accident, 0) / np.maximum(filled - accident, 1), filled


def signatures(df: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, two hashes of the whole set, registers; from doc_id, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            texts = batch.column(1).to_pylist()
            for i, j in pieces(texts):
                owner, hashes = shingle_sets(texts[i:j], WIDTH)
                count = np.bincount(owner, minlength=j - i)
                edge = np.concatenate([[0], np.cumsum(count)])
                sums = [np.concatenate([[0], np.cumsum(h)]).astype(U) for h in (hashes, mix(hashes ^ U(0x5DEECE66D)))]
                regs = registers(owner, hashes, j - i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(count, pa.int64()),
                     *(pa.array((s[edge[1:]] - s[edge[:-1]]).view(np.int64), pa.int64()) for s in sums),
                     pa.array([r.tobytes() for r in regs], pa.binary())], names=["doc_id", "text_hash", "n_shingles", "s1", "s2", "regs"])

    return df.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        lambda batches: trimmed(run(batches)), "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, regs binary")


SET = ["n_shingles", "s1", "s2"]


def band_keys(nodes: DataFrame, *more: str) -> DataFrame:
    """A row per node and band that is not empty: key, node, and the columns `more`."""
    part = F.substring("regs", F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS))
    return (nodes.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).withColumn("part", part)
            .where(F.col("part") != F.lit(NO_BAND)).select(F.xxhash64("band", "part").alias("key"), "node", *more))


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) with their estimate, without those whose sizes or registers rule them out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2, 3):
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (2, 3))
                score, filled = similarity(left, right)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["a", "b", "score"]).filter(
                    pa.array((score >= HOPELESS) | (filled < SURE)))

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    near = (F.col("n_a") * 100 >= F.col("n_b") * PERCENT) & (F.col("n_b") * 100 >= F.col("n_a") * PERCENT)
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").where(near).select("a", "b", "regs_a", "regs_b")
    return both.mapInArrow(lambda batches: trimmed(run(batches)), "a long, b long, score double")


def packed(df: DataFrame) -> DataFrame:
    """doc_id, text_hash and the text's bytes, compressed for the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in portions(batches, 2):
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([press.compress(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())],
                                             names=["doc_id", "text_hash", "packed"])

    return df.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        lambda batches: trimmed(run(batches)), "doc_id long, text_hash long, packed binary")


def unpacked(column: pa.Array) -> list[str]:
    import zstandard

    unpress = zstandard.ZstdDecompressor()
    return [unpress.decompress(x).decode() for x in column.to_pylist()]


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough; texts: node, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2, 3, most=1 << 20):
            left, right = (unpacked(batch.column(k)) for k in (2, 3))
            good = np.zeros(len(left), bool)
            for i, j in pieces([x + y for x, y in zip(left, right, strict=True)]):
                owner, hashes = shingle_sets([t for k in range(i, j) for t in (left[k], right[k])], WIDTH)
                size = np.bincount(owner, minlength=2 * (j - i))
                order = np.lexsort((hashes, owner // 2))
                pair, h = owner[order] // 2, hashes[order]
                twice = (pair[1:] == pair[:-1]) & (h[1:] == h[:-1])
                common = np.bincount(pair[1:][twice], minlength=j - i)
                good[i:j] = common * 100 >= (size[::2] + size[1::2] - common) * PERCENT
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    side = lambda x: texts.select(F.col("node").alias(x), F.col("packed").alias(f"text_{x}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(lambda batches: trimmed(run(batches)), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label: of each node in a link (a, b) the smallest node that it is joined with.

    Each round every node takes the smallest label around it, then the label
    of its label; a chain of n nodes takes about log n rounds.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
                     .withColumn("label", F.least("node", "label")), "labels")
    while True:
        around = (edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = (labels.join(around, "node").join(hop, "label", "left")
               .select("node", F.least("label", "near", "far").alias("new"), F.col("label").alias("old")))
        # A label that shrank pulls along the node it named: else two trees meet only along single links.
        pulled = new.where("new < old").groupBy(F.col("old").alias("node")).agg(F.min("new").alias("pull"))
        new = written(new.join(pulled, "node", "left").select("node", F.least("new", "pull").alias("label"), "old"), "labels")
        discard(labels)
        labels = new
        if labels.where("label < old").isEmpty():
            discard(edges)
            return labels.select("node", "label")


def met(nodes: DataFrame) -> DataFrame:
    """key, node, pivot, members: the nodes of each bucket that holds several, and the smallest node in it."""
    keys = band_keys(nodes)
    buckets = written(keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1"), "buckets")
    found = written(keys.join(buckets, "key"), "met")
    discard(buckets)
    return found


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (node, label) after more links (a, b): only what the links join is labelled anew."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    ends = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    ends = written(ends.select("a", "b", F.coalesce("label_a", "a").alias("label_a"), F.coalesce("label_b", "b").alias("label_b")), "ends")
    moved = components(ends.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).where("a != b").distinct())
    every = labels.unionByName(ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct()
                               .join(labels, "node", "left_anti").withColumn("label", F.col("node")))
    to = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    out = written(every.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    discard(ends, moved, labels)
    return out


def unfinished(meetings: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, label, weight of the buckets that hold several components; the one pair of a bucket of two was tested.

    The weight of a node is the number of nodes in all its buckets: large in the middle of a family.
    """
    rows = meetings.where("members > 2")
    if "weight" in rows.columns:
        rows = rows.select("key", "node", "members", "weight").join(labels, "node", "left")
    else:
        rows = rows.select("key", "node", "members").join(labels, "node", "left").withColumn("weight", F.sum("members").over(Window.partitionBy("node")))
    rows = rows.withColumn("label", F.coalesce("label", "node"))
    split = written(rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key"), "split")
    rest = written(rows.join(split, "key", "left_semi").select("key", "node", "label", "members", "weight"), "rest")
    discard(split)
    return rest


def turned(rest: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of a bucket's pivot of this turn and its nodes in other components, if they meet twice."""
    u = (F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
    order = F.col("weight").cast("double") if turn == 0 else F.log(u) / F.col("weight")
    pivots = rest.groupBy("key").agg(F.max(F.struct(order.alias("order"), F.col("node").alias("a"), F.col("label").alias("of"))).alias("pivot"))
    # Written: a join whose sides both come straight from a shuffle can be split where a bucket is hot.
    pivots = written(pivots.select("key", "pivot.a", "pivot.of"), "pivots")
    pairs = rest.join(pivots, "key").where("label != of").groupBy("a", F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    pairs = written(pairs.where("shared > 1").select("a", "b"), "pairs")
    discard(pivots)
    return pairs


def frequent_shingles(texts: DataFrame) -> dict[int, int]:
    """Hash -> count of the shingles that several of the sampled nodes hold, the most frequent ones; bounded on the driver."""
    share = min(1.0, SAMPLE_NODES / max(1, texts.count()))
    sample = texts.where(F.pmod(F.xxhash64(F.lit("sample"), "node"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 0, most=1 << 20):
            found = unpacked(batch.column(0))
            for i, j in pieces(found):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(found[i:j], WIDTH)[1].view(np.int64))], names=["shingle"])

    counts = sample.select("packed").mapInArrow(lambda batches: trimmed(run(batches)), "shingle long").groupBy("shingle").count().where("count > 1")
    return {r[0]: r[1] for r in counts.orderBy(F.col("count").desc(), "shingle").limit(FREQUENT).collect()}


def pairs_of_rest(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of the rest (node, label) in two components that share a shingle among the first of each.

    Sets with a similarity of 0.75 overlap in three quarters of either, so
    one that they share is among the first n - 3n/4 + 1 of both. At the first
    one they share, at places i and j, no more than min(n - i, n - j) can be
    shared in all; the pair counts only where that is enough.
    """
    own = texts.join(rest, "node")
    order = texts.sparkSession.sparkContext.broadcast(frequent_shingles(own.select("node", "packed")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array(sorted(order.value.items()), np.int64).reshape(-1, 2)
        for batch in portions(batches, 2, most=1 << 20):
            found = unpacked(batch.column(2))
            for i, j in pieces(found):
                owner, hashes = shingle_sets(found[i:j], WIDTH)
                hashes = hashes.view(np.int64)
                at = np.minimum(np.searchsorted(known[:, 0], hashes), max(0, len(known) - 1))
                count = np.where(known[at, 0] == hashes, known[at, 1], 0) if len(known) else np.zeros(len(hashes), np.int64)
                by = np.lexsort((hashes, count, owner))
                owner, hashes = owner[by], hashes[by]
                size = np.bincount(owner, minlength=j - i)
                place = np.arange(len(owner)) - np.concatenate([[0], np.cumsum(size)[:-1]])[owner]
                n = size[owner]
                first = place <= n - (n * PERCENT + 99) // 100
                rows = pa.array(owner[first] + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(hashes[first]), pa.array(n[first].astype(np.int32)),
                     pa.array(place[first].astype(np.int32))], names=["node", "label", "shingle", "n", "place"])

    prefix = written(own.select("node", "label", "packed").mapInArrow(lambda batches: trimmed(run(batches)), "node long, label long, shingle long, n int, place int"), "prefix")
    # The largest component among a shingle's holders: two holders in it are joined already, and are never paired.
    shared = prefix.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle").agg(
        F.max(F.struct("n", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("holders")).where("labels > 1")
    shared = written(shared.select("shingle", "main", (F.col("holders") > FEW).alias("hot")), "shared")
    every, prefix = prefix, prefix.join(shared, "shingle")
    # Copies of one text share many shingles: a pair is made at the first of them, not at each.
    before = F.collect_list(F.when(F.col("hot"), F.col("shingle"))).over(Window.partitionBy("node").orderBy("place").rowsBetween(-LOOK_BACK, -1))
    prefix = written(prefix.withColumn("before", F.when(F.col("hot"), before).otherwise(F.array().cast("array<long>"))), "prefix")
    discard(every, shared)
    side = lambda x: [F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("label", "main", "n", "place", "before")]]
    both = prefix.where("label != main").select("shingle", *side("a")).join(prefix.select("shingle", *side("b")), "shingle")
    once = (F.col("a") < F.col("b")) | (F.col("b_label") == F.col("b_main"))
    an, bn = F.col("a_n"), F.col("b_n")
    enough = F.least(an - F.col("a_place"), bn - F.col("b_place")) * (100 + PERCENT) >= (an + bn) * PERCENT
    near = (an * 100 >= bn * PERCENT) & (bn * 100 >= an * PERCENT)
    first = ~F.arrays_overlap("a_before", "b_before")
    found = both.where(once & (F.col("a_label") != F.col("b_label")) & near & enough & first)
    pairs = written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    discard(prefix)
    return pairs


def linked(df: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """From doc_id, text: (doc_id, text_hash, n_shingles, node) of each row, (node, label) of the nodes that have links,
    and the written frames to discard once the rows were read."""
    ship_code(df.sparkSession)
    signed = written(signatures(df), "signatures")
    # One row of each set stands for it; which one makes no difference.
    nodes = written(signed.where("n_shingles > 0").dropDuplicates(SET).withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = signed.select("doc_id", "text_hash", *SET).join(nodes.select(*SET, "node"), SET, "left").select("doc_id", "text_hash", "n_shingles", "node")
    meetings = met(nodes)
    pairs = meetings.where("node != pivot").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"), F.min("members").alias("fewest"))
    pairs = pairs.where((F.col("shared") > 1) | (F.col("fewest") == 2)).select("a", "b")
    candidates = written(estimated(pairs, nodes), "candidates")
    first = candidates.groupBy("b").agg(F.max_by(F.col("a"), F.struct("score", -F.col("a"))).alias("a")).select("a", "b")

    # The texts of all nodes that may be compared: those of the candidates and of buckets that may be left unfinished.
    ends = reduce(DataFrame.unionByName, [candidates.select(F.col("a").alias("node")), candidates.select(F.col("b").alias("node")),
                                          meetings.where("members > 2").select("node")]).distinct()
    reps = nodes.join(ends, "node", "left_semi").select("node", F.col("doc_id").alias("rep"), F.col("text_hash").alias("rep_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))
    texts = written(packed(df).join(reps, same).select("node", "packed").dropDuplicates(["node"]), "texts")

    links = written(confirmed(first, texts), "links")
    labels = components(links)
    side = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    apart = F.coalesce("label_a", "a") != F.coalesce("label_b", "b")
    second = candidates.select("a", "b").join(first, ["a", "b"], "left_anti")
    second = written(second.join(side("a"), "a", "left").join(side("b"), "b", "left").where(apart).select("a", "b"), "pairs")
    rest, tested = unfinished(meetings, labels), candidates.select("a", "b")
    discard(meetings)
    for turn in range(TURNS):
        best = estimated(turned(rest, turn), nodes).groupBy("b").agg(F.max_by(F.col("a"), F.struct("score", -F.col("a"))).alias("a"))
        best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        best = written(best if turn else best.unionByName(second), "pairs")
        found = written(confirmed(best, texts), "links")
        tested, n = tested.unionByName(best), found.count()
        if not n:
            break
        labels, before = joined(labels, found), rest
        rest = unfinished(before.drop("label"), labels)
        discard(before)
        if n * WORTH < best.count():
            break
    if not rest.isEmpty():
        rest = written(rest.select("node", "label").distinct(), "rest")
        third = written(estimated(pairs_of_rest(rest, texts).join(tested, ["a", "b"], "left_anti"), nodes), "candidates")
        if not third.isEmpty():
            labels = joined(labels, written(confirmed(third, texts), "links"))
    discard(texts, candidates)
    return rows, labels, [signed, nodes]


def grouped(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """doc_id, n_shingles, group (null without shingles) and the columns `more` of each row."""
    rows, labels, used = linked(id_and_text(df, id_col, text_col))
    out = written(rows.join(labels, "node", "left").withColumn("group", F.coalesce("label", "node")).select("doc_id", "n_shingles", "group", *more), "grouped")
    discard(*used)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    rows = grouped(df, id_col, text_col)
    # Written: a join whose sides both come straight from a shuffle can be split where a group is hot.
    heads = written(rows.where(F.col("group").isNotNull()).groupBy("group").agg(F.min("doc_id").alias("head")), "heads")
    return (rows.join(heads, "group", "left").withColumn("component_id", F.coalesce("head", "doc_id"))
            .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that stay: of each component one, and all without shingles. All columns are kept.

    The one has the smallest id, null ids last; of several texts under that id
    the one with the smallest hash; of rows that repeat id and text the one
    whose columns have the smallest hash.
    """
    rows = grouped(df, id_col, text_col, "text_hash")
    key = ["doc_id", "text_hash"]
    blank = rows.where(F.col("group").isNull()).select(*key, F.lit(False).alias("repeats")).distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), *key, (F.col("n") > 1).alias("repeats"))).alias("least")
    heads = rows.where(F.col("group").isNotNull()).groupBy("group", *key).agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(least)
    stay = written(heads.select(*[f"least.{c}" for c in (*key, "repeats")]).unionByName(blank), "near-kept")
    rows = boxed(df, id=F.col(id_col).cast("long"), hash=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    out = rows.join(stay.where(~F.col("repeats")), same, "left_semi").select("row")
    repeats = stay.where("repeats")
    if not repeats.isEmpty():
        # Combined on the map side: rows that repeat id and text cost each task one row.
        twins = rows.join(repeats, same, "left_semi").groupBy("id", "hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        out = out.unionByName(twins.select("row"))
    return unboxed(out, df.columns)
