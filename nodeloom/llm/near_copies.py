"""One document of each class of near copies: wide SimHash fingerprints, verified on the shingles.

Texts are alike if the Jaccard similarity of their sets of five-word shingles (A-Z
lower-cased) is at least LEAST; fingerprints too are those of the sets, so repeated lines count once.  At 0.8 a 64-bit fingerprint differs in 4 to 17 bits, which
no exact cell of 64 bits can find; so texts get WIDTH fingerprints of 64 bits each, from
independently mixed shingle hashes, and:

1. Copies (equal words) are collapsed.
2. Cells.  Each of ``tables`` cells fixes ``bits`` positions of the wide fingerprint, so many
   that a cell expects CROWD texts, and there are so many tables that a pair at LEAST shares
   one with probability RECALL.  Both follow from the number of texts.
3. Candidates.  In a cell, texts within the radius that a pair at LEAST keeps (mean and
   SIGMAS deviations) are connected: the popcounts of the fingerprint's segments of four bits are
   compared first, as their Manhattan distance never exceeds the differing bits, then the bits of what is left.
4. Verification.  The candidate classes' texts, one per distinct text, are fetched and
   compared by their shingle sets, exactly; only verified links join a class.

A crowded cell or class is thinned first: its texts are linked to one text of it, the hub, and
by the triangle inequality (differing bits and Jaccard distance are metrics) those so near the
hub that no text beyond its reach can be in theirs are settled.  A dense group of any size
goes in one round, with one link a text.  What stays is dealt in blocks, each pair of
blocks a group of bounded size, so no group grows with the data and nothing is dropped.
Texts of no candidate class are never shuffled, and rows are removed by a join on keys alone.

Edge cases: null and empty texts, and texts of blanks, are copies of one another; rows without
doc_id are kept only if their class has no row with one; a row that is there twice is kept
once; shorter texts are one shingle; very long texts are compared whole, in groups of their own if they
fill a block; of a class without doc_ids the row with the smallest hash of its text stays; an empty table gives an empty result; other columns
go along, whatever their names.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .components import components
from .shared import free_name, materialize, runs
from .simhash import majority, shingles

WORDS, LEAST, RECALL, WIDTH, SEED = 5, 0.8, 0.98, 4, 42
#: Deviations of the number of differing bits that the radius allows for.
SIGMAS = 4.0
#: Texts that a cell expects, texts and bytes in a block.
CROWD, BLOCK, BLOCK_BYTES = 1024, 2048, 16 << 20
#: Most rounds of thinning, and the least share of rows that a round must settle to be followed by another; the result is the same for all values.
ROUNDS, WORTH = 6, 0.1
#: Keys (a few longs each) that may be broadcast; beyond, the join is a shuffle.
BROADCAST_KEYS = 250_000


def differing(least: float) -> tuple[float, float]:
    """Share of bits, and its deviation over a wide fingerprint, in which equally large sets with this similarity differ."""
    share = math.acos(2 * least / (1 + least)) / math.pi
    return share, math.sqrt(share * (1 - share) / (64 * WIDTH))


def radius(least: float = LEAST) -> int:
    share, deviation = differing(least)
    return int(64 * WIDTH * (share + SIGMAS * deviation))


def plan(texts: int, least: float = LEAST, recall: float = RECALL) -> tuple[int, int]:
    """Bits that a cell fixes and number of tables, for a number of texts; few texts share one cell."""
    bits = max(0, math.ceil(math.log2(max(texts, 1) / CROWD)))
    share, deviation = differing(least)
    hit = (1 - share - deviation) ** bits
    return bits, 1 if not bits else math.ceil(math.log(1 - recall) / math.log(1 - hit))


def distinct(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's different hashes, ascending, and their number; ``count`` has the number of its hashes in ``h``."""
    doc = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(count))


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, h, t, size, w0, w1, ...) of ``docs(doc_id, h, text)``: hash of the words, bytes, wide fingerprint."""
    words = [f"w{i}" for i in range(WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in tk.chunks(batch):
                h, count, texts = shingles(data, offsets, WORDS, SEED)
                h, count = distinct(h, count)
                t = np.array([xxhash.xxh3_64_intdigest(x) for x in texts], np.uint64)
                wide = [majority(h if i == 0 else tk.mix(h + np.uint64(i)), count) for i in range(WIDTH)]
                keys = [batch.column(c).slice(row, stop - row) for c in ("doc_id", "h")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(t.view(np.int64)), pa.array(np.diff(offsets).astype(np.int64)), *[pa.array(w.view(np.int64)) for w in wide]], names=["doc_id", "h", "t", "size", *words])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "h", "text").mapInArrow(run, f"doc_id {kind}, h long, t long, size long, {', '.join(f'{w} long' for w in words)}")


#: Each byte with the set bits of its two segments of four bits moved to the segments' ends.
COUNTED = np.array([((1 << (x >> 4).bit_count()) - 1) << 4 | (1 << (x & 15).bit_count()) - 1 for x in range(256)], np.uint8)


def counts(fp: np.ndarray) -> np.ndarray:
    """The segments' bit counts of the rows of ``fp``, each written as so many ones: differing bits of two such rows are the Manhattan distance of their counts."""
    return COUNTED[np.ascontiguousarray(fp).view(np.uint8)].view(np.uint64).reshape(fp.shape)


def close(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges that connect the rows of ``fp`` (uint64, WIDTH columns) within ``most`` bits: each to the first of its class.

    The segments' popcounts come first: their Manhattan distance is never more than the differing bits, so pairs beyond ``most``
    by it are none.  The others are compared exactly.
    """
    linked = np.zeros((len(fp), len(fp)), bool)
    fp = np.ascontiguousarray(fp)
    bound = [np.ascontiguousarray(w) for w in counts(fp).T]
    for a in range(0, len(fp), 256):
        apart = sum(np.bitwise_count(w[a : a + 256, None] ^ w[None, a:]).astype(np.uint16) for w in bound)
        x, y = np.nonzero(apart <= most)
        near = np.bitwise_count(fp[x + a] ^ fp[y + a]).sum(axis=1, dtype=np.uint16) <= most
        linked[x[near] + a, y[near] + a] = True
        linked[a:, a : a + 256] = linked[a : a + 256, a:].T
    return stars(len(fp), np.flatnonzero(linked.sum(axis=1) > 1), lambda x: np.flatnonzero(linked[x]))


def stars(n: int, begin, near) -> list[tuple[int, int]]:
    """Edges from the first of each class to its others; ``near(x)`` gives the linked ones."""
    new, out = np.ones(n, bool), []
    for root in begin:
        queue = [root] if new[root] else []
        new[root] = False
        while queue:
            got = near(queue.pop())
            got = got[new[got]]
            new[got] = False
            queue += got.tolist()
            out += [(int(root), int(y)) for y in got]
    return out


def alike(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges that connect the shingle sets with a Jaccard similarity of at least ``least``."""
    size = np.array([len(x) for x in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]

    def near(x: int) -> np.ndarray:
        first, last = np.searchsorted(every, sets[x], "left"), np.searchsorted(every, sets[x], "right")
        n = last - first
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        shared = np.bincount(owner[at], minlength=len(sets))
        return np.flatnonzero((shared > 0) & (shared >= least * (size[x] + size - shared) - 1e-9))

    return stars(len(sets), range(len(sets)), near)


def _pairs_of_blocks(rows: DataFrame, by: str) -> DataFrame:
    """``rows(by, blocks, own, ...)`` once for each pair of blocks (i, j) that its block is in, groups whole and sorted."""
    each = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select(by, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *[c for c in rows.columns if c not in (by, "own", "blocks")])
    return each.repartition(by, "i", "j").sortWithinPartitions(by, "i", "j", "t")


def union(edges: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, edges)


def _own(blocks: str = "blocks") -> F.Column:
    return F.pmod(F.xxhash64(F.lit(3), "t"), F.col(blocks)).cast("int")


def _settled(near: DataFrame, by: str, reach: float) -> tuple[DataFrame, DataFrame]:
    """Edges to the hub, and the rows that may be linked to one that is not; ``near(by, t, hub, d, linked, ...)``.

    d is the distance from the group's hub.  A row at d and one that is not linked, at m or more,
    are at least m - d apart, so rows below m - reach have no link but those of the hub's class.
    """
    bound = near.filter("NOT linked").groupBy(by).agg(F.min("d").alias("m"))
    edges = near.filter("linked AND t <> hub").select(F.col("hub").alias("a"), F.col("t").alias("b"))
    return edges, near.join(bound, by).filter(F.col("d") >= F.col("m") - reach)


def _thin_cells(dealt: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """``dealt(t, w0, ..., cell)`` less the settled rows of crowded cells, and the edges that settle them."""
    crowded = materialize(dealt.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("cell"))
    if crowded.isEmpty():
        return dealt, []
    few, edges, words = _small(crowded, crowded), [], [f"w{i}" for i in range(WIDTH)]
    rest, hot = dealt.join(few, "cell", "left_anti").select(*dealt.columns), materialize(dealt.join(few, "cell").select(*dealt.columns))
    rows = hot.count()
    for _ in range(ROUNDS):
        hubs = hot.groupBy("cell").agg(F.count("*").alias("n"), F.min(F.struct("t", *words)).alias("at")).filter(F.col("n") > BLOCK)
        hubs = materialize(hubs.select("cell", F.col("at.t").alias("hub"), *[F.col(f"at.{w}").alias(f"h{w}") for w in words]))
        if hubs.isEmpty():
            break
        d = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"h{w}"))) for w in words), F.lit(0))
        all_rows = hot.join(_small(hubs, hubs), "cell", "left").withColumn("d", d)
        near = all_rows.filter("hub IS NOT NULL").withColumn("linked", F.col("d") <= most)
        found, left = _settled(near, "cell", most)
        edges.append(found)
        hot = materialize(all_rows.filter("hub IS NULL").select(*dealt.columns).unionByName(left.select(*dealt.columns)))
        before, rows = rows, hot.count()
        if rows > before * (1 - WORTH):
            break
    return rest.unionByName(hot), edges


def candidates(texts: DataFrame, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """Edges (a, b) that connect close fingerprints of ``texts(t, w0, ...)``."""
    bits, tables = plan(texts.count(), least, recall)
    draw, words = random.Random(SEED), [f"w{i}" for i in range(WIDTH)]
    keys = []
    for i in range(tables):
        mask = sum(1 << b for b in draw.sample(range(64 * WIDTH), bits))
        parts = [(w, mask >> 64 * k & (1 << 64) - 1) for k, w in enumerate(words)]
        keys.append(F.xxhash64(F.lit(i), *[F.col(w).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for w, m in parts if m]))
    dealt = texts.select("t", *words, F.explode(F.array(*keys)).alias("cell"))
    most = radius(least)
    dealt, edges = _thin_cells(dealt, most)
    crowd = dealt.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    groups = _pairs_of_blocks(dealt.join(crowd, "cell").withColumn("own", _own()), "cell")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["cell", "i", "j"]):
            t, fp = group.column("t").to_numpy(), np.stack([group.column(w).to_numpy().view(np.uint64) for w in words], axis=1)
            if found := close(fp, most):
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(t[a]), pa.array(t[b])], names=["a", "b"])

    return union([groups.mapInArrow(link, "a long, b long"), *edges])


def _sets(group: pa.RecordBatch) -> list[np.ndarray]:
    """Each text's set of shingle hashes."""
    sets = []
    for _, _, data, offsets in tk.chunks(group):
        h, count, _ = shingles(data, offsets, WORDS, SEED)
        sets += [np.unique(x) for x in np.split(h, np.cumsum(count)[:-1])]
    return sets


def _blocks() -> F.Column:
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("blocks")


def _thin_classes(rows: DataFrame, least: float) -> tuple[DataFrame, list[DataFrame]]:
    """``rows(c, t, size, text)`` of crowded classes less the settled ones, and the edges that settle them."""
    edges, kind, reach = [], rows.schema["c"].dataType.simpleString(), 1 - least + 1e-6

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["c", "i"]):
            t, hub = group.column("t").to_numpy(), group.column("hub").to_numpy()
            sets = _sets(group)
            center = sets[int(np.flatnonzero(t == hub)[0])]
            shared = np.array([len(np.intersect1d(x, center, assume_unique=True)) for x in sets])
            whole = np.array([len(x) for x in sets]) + len(center) - shared
            columns = [group.column("c"), pa.array(t), pa.array(hub), pa.array(1 - shared / np.maximum(whole, 1)), pa.array(shared >= least * whole - 1e-9)]
            yield pa.RecordBatch.from_arrays(columns, names=["c", "t", "hub", "d", "linked"])

    count = rows.count()
    for _ in range(ROUNDS):
        hubs = materialize(rows.groupBy("c").agg(_blocks(), F.min("t").alias("hub")).filter("blocks > 1"))
        if hubs.isEmpty():
            break
        part = F.when(F.col("t") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_own()))
        dealt = rows.join(_small(hubs, hubs), "c").select("c", "t", "hub", "text", F.explode(part).alias("i"))
        near = materialize(dealt.repartition("c", "i").sortWithinPartitions("c", "i").mapInArrow(measure, f"c {kind}, t long, hub long, d double, linked boolean"))
        found, left = _settled(near, "c", reach)
        edges.append(found)
        done = near.select("t").distinct().join(left.select("t").distinct(), "t", "left_anti")
        before, rows = count, materialize(rows.join(done, "t", "left_anti").select(*rows.columns))
        count = rows.count()
        if count > before * (1 - WORTH):
            break
    return rows, edges


def verified(docs: DataFrame, members: DataFrame, least: float = LEAST) -> DataFrame:
    """Edges (a, b) between texts of one candidate class that are alike; ``members(c, t, size, doc_id, h)``, ``docs(doc_id, h, text)``."""
    keys = members.select("c", "t", "size", F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    crowded, edges = materialize(members.groupBy("c").agg(_blocks()).filter("blocks > 1").select("c")), []

    def fetch(some: DataFrame) -> DataFrame:
        """Texts of some members; a text may be there twice."""
        return docs.join(_small(some, members), docs.doc_id.eqNullSafe(F.col("_id")) & (docs.h == F.col("_h"))).select("c", "t", "size", "text")

    if crowded.isEmpty():
        rows = fetch(keys)
    else:
        few = _small(crowded, crowded)
        hot, edges = _thin_classes(materialize(fetch(keys.join(few, "c"))), least)
        rows = fetch(keys.join(few, "c", "left_anti")).unionByName(hot)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["c", "i", "j"]):
            t, at = np.unique(group.column("t").to_numpy(), return_index=True)  # a row may be there twice
            if len(t) < 2:
                continue
            sets = _sets(group)
            if found := alike([sets[k] for k in at], least):
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(t[a]), pa.array(t[b])], names=["a", "b"])

    # A class's blocks follow from its members, or from what is left of it.
    sizes = members.select("c", "size") if crowded.isEmpty() else keys.join(few, "c", "left_anti").select("c", "size").unionByName(hot.select("c", "size"))
    dealt = rows.drop("size").join(sizes.groupBy("c").agg(_blocks()), "c").withColumn("own", _own())
    return union([_pairs_of_blocks(dealt, "c").mapInArrow(link, "a long, b long"), *edges])


def _small(keys: DataFrame, counted: DataFrame) -> DataFrame:
    return F.broadcast(keys) if counted.count() <= BROADCAST_KEYS else keys


def near_copies(docs: DataFrame, least: float = LEAST, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, t) of ``docs(doc_id, h, text)``, and each distinct text's class and first row (t, class, best)."""
    rows = materialize(profiles(docs))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("best")
    texts = materialize(rows.groupBy("t").agg(best, F.max("size").alias("size"), *[F.min(f"w{i}").alias(f"w{i}") for i in range(WIDTH)]))
    label = components(candidates(texts, least, recall))
    members = materialize(label.join(texts, label.node == texts.t).select(F.col("label").alias("c"), "t", "size", "best.doc_id", "best.h"))
    final = components(verified(docs, members, least))
    named = texts.join(final, texts.t == final.node, "left").select("t", F.coalesce("label", "t").alias("class"), "best")
    return rows, named


def deduplicate(docs: DataFrame, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """One document of each class, all columns: the one with the smallest doc_id."""
    h, key_id, key_h = (free_name(docs, x) for x in ("text_hash", "key_id", "key_hash"))
    hashed = docs.withColumn(h, F.xxhash64("text"))
    rows, named = near_copies(hashed.select("doc_id", F.col(h).alias("h"), "text"), least, recall)
    stay = named.groupBy("class").agg(F.min("best").alias("b")).select(F.col("b.doc_id").alias("_id"), F.col("b.h").alias("_h"))
    keys = rows.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    stays = keys.join(stay, keys.doc_id.eqNullSafe(stay._id) & (keys.h == stay._h), "left")
    judged = materialize(stays.select(F.col("doc_id").alias(key_id), F.col("h").alias(key_h), "n", F.col("_h").isNotNull().alias("stays")))
    gone, again = judged.filter("NOT stays").select(key_id, key_h), judged.filter("stays AND n > 1").select(key_id, key_h)
    same = (F.col(h) == F.col(key_h)) & F.col("doc_id").eqNullSafe(F.col(key_id))
    kept = hashed.join(_small(gone, gone), same, "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    # Rows that are there twice are few keys; only they are made distinct.
    once = kept.join(_small(again, again), same, "left_semi").dropDuplicates(["doc_id", h])
    return kept.join(_small(again, again), same, "left_anti").unionByName(once).select(*docs.columns)
