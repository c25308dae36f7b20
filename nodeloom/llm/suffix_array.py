"""Suffix array of a corpus by the distributed difference cover modulo 3, and repeats from it.

Positions not divisible by 3 are sampled; their symbol triples are sorted and named; while
names repeat, the string of names is sorted the same way, recursively; the remaining
suffixes follow from their first symbols and the ranks behind them, and are merged by
counting.  Each sort is a range-partitioned one, each look-up a join, so no step
gathers a group in one task.  Documents end in symbols of their own, so no match crosses them.

This is the method in full; it moves some hundreds of bytes per byte of text, which is why
the query on whole tables samples by content instead (``exact_substrings``).  It is for
corpora small enough for that, and as an independent check.

Edge cases: null and empty texts have no suffixes; repeated rows are documents of their own;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as tk
from .shared import materialize

BEYOND = -(1 << 62)


def indexed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the row's place, from 0, in the global order: a sort, and offsets from the partitions' sizes."""
    rows = materialize(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # one row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("_before"))
    placed = rows.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    return placed.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_before")


def ranks(symbols: DataFrame) -> DataFrame:
    """(doc, i, r): the place of each suffix of ``symbols(doc, i, c)``; each document's last symbol is its own."""
    along = Window.partitionBy("doc").orderBy("i")
    nxt = lambda k: F.coalesce(F.lead("c", k).over(along), F.lit(BEYOND)).alias(f"c{k}")
    triples = materialize(symbols.select("doc", "i", "c", nxt(1), nxt(2)))
    sample = triples.filter("i % 3 <> 0")
    names = materialize(indexed(sample.select("c", "c1", "c2").distinct(), ["c", "c1", "c2"], "name"))
    named = materialize(sample.join(names, ["c", "c1", "c2"]).select("doc", "i", "name"))
    if names.count() < named.count():
        firsts = named.filter("i % 3 = 1").groupBy("doc").agg(F.count("*").alias("n1"))
        moved = named.join(firsts, "doc").select("doc", "i", F.when(F.col("i") % 3 == 1, F.floor(F.col("i") / 3)).otherwise(F.col("n1") + F.floor(F.col("i") / 3)).alias("j"), "name")
        moved = materialize(moved)
        deeper = ranks(moved.select("doc", F.col("j").alias("i"), F.col("name").alias("c"))).withColumnRenamed("i", "j")
        sampled = moved.join(deeper, ["doc", "j"]).select("doc", "i", "r")
    else:
        sampled = named.select("doc", "i", F.col("name").alias("r"))
    sampled = materialize(sampled)
    behind = lambda k: sampled.select("doc", (F.col("i") - k).alias("i"), F.col("r").alias(f"r{k}"))
    known = triples.join(sampled, ["doc", "i"], "left").join(behind(1), ["doc", "i"], "left").join(behind(2), ["doc", "i"], "left")
    known = materialize(known.select("doc", "i", (F.col("i") % 3).alias("m"), "c", "c1", "r", *[F.coalesce(f"r{k}", F.lit(BEYOND)).alias(f"r{k}") for k in (1, 2)]))
    key = ["doc", "i"]
    # Among suffixes of residue 0 and 1 the order is (c, r1), of 0 and 2 it is (c, c1, r2).
    with_1 = indexed(known.filter("m < 2").select(*key, "m", "c", "r1"), ["c", "r1"], "in_01").select(*key, "in_01")
    with_2 = indexed(known.filter("m <> 1").select(*key, "m", "c", "c1", "r2"), ["c", "c1", "r2"], "in_02").select(*key, "in_02")
    alone = indexed(known.filter("m = 0").select(*key, "c", "r1"), ["c", "r1"], "in_own").select(*key, "in_own")
    for m in (1, 2):
        alone = alone.unionByName(indexed(known.filter(f"m = {m}").select(*key, "r"), ["r"], "in_own").select(*key, "in_own"))
    both = indexed(known.filter("m > 0").select(*key, "r"), ["r"], "in_12").select(*key, "in_12")
    every = known.select(*key, "m").join(alone, key)
    for table in (with_1, with_2, both):
        every = every.join(table, key, "left")
    place = F.when(F.col("m") == 0, F.col("in_01") + F.col("in_02") - F.col("in_own")).when(F.col("m") == 1, F.col("in_12") + F.col("in_01") - F.col("in_own")).otherwise(F.col("in_12") + F.col("in_02") - F.col("in_own"))
    return materialize(every.select(*key, place.alias("r")))


def repeated_starts(docs: DataFrame, length: int) -> DataFrame:
    """(doc, i): starts of the strings of ``length`` bytes that also start elsewhere; docs(doc long, text), doc unique."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in tk.chunks(batch):
                for row in range(first, last):
                    text = data[offsets[row - first] : offsets[row - first + 1]]
                    n, doc = len(text), batch.column("doc")[row].as_py()
                    whole = max(0, n - length + 1)
                    at = np.arange(whole)
                    prefix = np.zeros(n + 1, np.int64)
                    prefix[:whole] = tk.RangeHash(text)(at, at + length).view(np.int64)
                    c = np.append(text.astype(np.int64), -1 - doc)
                    mask = np.arange(n + 1) >= whole
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, doc)), pa.array(np.arange(n + 1)), pa.array(c), pa.array(prefix, mask=mask)], names=["doc", "i", "c", "prefix"])

    rows = materialize(docs.select("doc", "text").mapInArrow(spell, "doc long, i long, c long, prefix long"))
    places = ranks(rows.select("doc", "i", "c")).join(rows.filter("prefix IS NOT NULL").select("doc", "i", "prefix"), ["doc", "i"])
    neighbour = places.select((F.col("r") + 1).alias("r"), F.col("prefix").alias("before"), F.struct("doc", "i").alias("a"))
    same = places.join(neighbour, "r").filter("prefix = before")
    return same.select(F.inline(F.array("a", F.struct("doc", "i")))).distinct()
