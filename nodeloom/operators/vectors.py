"""An index of vectors: cells around trained middles, read in the order of what they may hold.

Vectors are normalised and stored by cell; each cell has its middle and the least similarity of its vectors to it.  By the triangle
inequality of angles no vector of a cell is more similar to a query than the cell's bound says.  A search reads the
cells with the highest bounds first; once ``k`` hits are known, cells whose bound is below the last of them cannot change the
result.  So the result is exact, and as many cells are read as the vectors' structure demands; ``probe`` sets a number of cells
to read instead, for which ``recall`` measures what is found.

The middles are trained on at most SAMPLE vectors, drawn by the hash of their id; all vectors are in the index.  Vectors that are
null, of another length, zero, or have null, NaN or infinite components are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Store, Table
from ..storage import materialize
from .search import cosine

#: Most vectors that the middles are trained on, rounds of training, vectors that a cell expects.
SAMPLE, ROUNDS, CROWD = 20_000, 8, 256
SLACK = 1e-6


def store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    return Store(spark, path, {"vectors": Table("cell int, id long, tag string, vector array<double>", ("cell",), buckets), "cells": Table("cell int, n long, least double, middle array<double>", ("cell",), 1)})


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def train(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Middles of unit vectors: each round every vector goes to the most similar one, which becomes their mean; the first are drawn evenly."""
    middles = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(rounds):
        own = (sample @ middles.T).argmax(axis=1)
        total = np.zeros_like(middles)
        np.add.at(total, own, sample)
        middles = np.where(np.linalg.norm(total, axis=1, keepdims=True) > 1e-12, _unit(total), middles)
    return middles


def drawn_by_hash(rows: DataFrame, n: int, most: int = SAMPLE) -> DataFrame:
    """(id, vector) of the ``most`` of ``n`` rows with the smallest hashes of their ids.

    A sort with a limit sends ``most`` vectors of every task to the driver.  So the hash of the last one is found without the
    vectors, and only the drawn rows have theirs read and sent.
    """
    hashed = rows.select("id", "vector", F.xxhash64(F.lit(5), "id").alias("h"))
    if n > most:
        low = -(1 << 63)
        end = min((1 << 63) - 1, low + int((1 << 64) * min(1.0, 1.5 * most / n)))  # hashes are even, so half more than are asked for lie below
        near = materialize(hashed.select("h", "id").filter(F.col("h") <= end))
        if near.count() < most:
            near = hashed.select("h", "id")
        last = materialize(near.orderBy("h", "id").limit(most)).agg(F.max(F.struct("h", "id")).alias("x")).first().x
        hashed = hashed.filter((F.col("h") < last.h) | ((F.col("h") == last.h) & (F.col("id") <= last.id)))
    return materialize(hashed).orderBy("h", "id").select("id", "vector")


def build(index: Store, vectors: DataFrame, size: int) -> None:
    """Writes ``vectors(id, vector, tag)`` into the index; the number of cells follows from the number of vectors."""
    fine = (F.size("vector") == size) & F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))) & F.exists("vector", lambda x: x != 0)
    rows = materialize(vectors.filter(fine).select(F.col("id").cast("long").alias("id"), F.col("tag").cast("string").alias("tag"), F.col("vector").cast("array<double>").alias("vector")))
    n = rows.count()
    if not n:
        index.commit(0, {"vectors": (index.read("vectors"), None), "cells": (index.read("cells"), None)})
        return
    drawn = drawn_by_hash(rows, n).collect()
    sample = _unit(np.array([r.vector for r in drawn]))
    middles = train(sample, max(1, min(len(sample) // 4, math.ceil(n / CROWD))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _unit(batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1))
                like = v @ middles.T
                own = like.argmax(axis=1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("id"), batch.column("tag"), flat, pa.array(like[np.arange(len(own)), own])], names=["cell", "id", "tag", "vector", "near"])

    placed = materialize(rows.mapInArrow(place, "cell int, id long, tag string, vector array<double>, near double"))
    named = index.spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(middles)], "cell int, middle array<double>")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least")).join(named, "cell")
    index.commit(0, {"vectors": (placed, None), "cells": (cells, None)})


def bounds(index: Store, query: Sequence[float]) -> list[tuple[float, int, int]]:
    """(most similar that a vector of the cell can be, cell, vectors), best first; a row per cell comes to the driver."""
    q = _unit(np.array([query], float))[0]
    out = []
    for r in index.read("cells").collect():
        apart = math.acos(max(-1.0, min(1.0, float(q @ np.array(r.middle)))))
        out.append((math.cos(max(0.0, apart - math.acos(max(-1.0, min(1.0, r.least))))) + SLACK, r.cell, r.n))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def _hits(index: Store, cells: Sequence[int], query: Sequence[float], k: int, tag: str | None) -> DataFrame:
    keys = index.spark.createDataFrame([(c,) for c in cells], "cell int")
    rows = index.read("vectors", buckets=index.touched("vectors", keys)).filter(F.col("cell").isin(list(cells)))
    rows = rows if tag is None else rows.filter(F.col("tag") == tag)
    similarity = F.round(cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])), 6)
    return rows.select("id", similarity.alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def search(index: Store, query: Sequence[float], k: int = 10, tag: str | None = None, probe: int | None = None) -> DataFrame:
    """(id, similarity) of the ``k`` most similar vectors (with a tag), best first, ties by id.

    Exact, or from the ``probe`` best cells.  The exact way reads cells that expect four times ``k`` vectors, then those whose
    bound is not below the last hit.
    """
    order = bounds(index, query)
    if probe is not None:
        return _hits(index, [c for _, c, _ in order[:probe]] or [-1], query, k, tag)
    first, held = 0, 0
    while first < len(order) and held < 4 * k:
        held += order[first][2]
        first += 1
    found = _hits(index, [c for _, c, _ in order[:first]] or [-1], query, k, tag).collect()
    least = found[-1].similarity if len(found) == k else -2.0
    return _hits(index, [c for b, c, _ in order if b >= least - SLACK] or [-1], query, k, tag)


def recall(index: Store, queries: DataFrame, probe: int, k: int = 10) -> tuple[float, float]:
    """Share of the true ``k`` nearest of ``queries(vector)``, a few, that ``probe`` cells hold, and the share of vectors in these cells."""
    met = asked = read = total = 0
    for r in queries.select("vector").collect():
        want = {x.id for x in search(index, r.vector, k).collect()}
        met += len(want & {x.id for x in search(index, r.vector, k, probe=probe).collect()})
        asked += len(want)
        order = bounds(index, r.vector)
        read += sum(n for _, _, n in order[:probe])
        total += sum(n for _, _, n in order)
    return met / max(asked, 1), read / max(total, 1)
