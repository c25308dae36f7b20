"""Hashed n-gram logistic regression: FTRL-proximal fitting and sparse scoring on Spark.

Features are the *presence* of hashed word n-grams in a space of 2**30 buckets.
Fitting reads a bounded sample of labelled rows (``max_rows``); each shard of the
sample runs FTRL by itself and the shards' weights are averaged by their row
counts.  Only the non-zero weights come to the driver (L1 keeps them few, and the
sample bounds them).  Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk

BUCKETS = np.uint64((1 << 30) - 1)


@dataclass(frozen=True)
class FtrlParams:
    """Parameters of the fit.

    max_rows: bound of the labelled sample (expected size; drawn by a hash of the id).
    rows_per_shard: the sample is fitted in shards of about this many rows.
    orders: lengths of the word n-grams.
    prefixes: byte lengths of word beginnings that are features too (inflected words share them).
    runs: lengths from which a word said again and again is a feature, whatever the word.
    pair_weight: weight of the squared score change between a row and its counterfactual.
    """

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1
    epochs: int = 3
    orders: tuple[int, ...] = (1, 2)
    prefixes: tuple[int, ...] = ()
    runs: tuple[int, ...] = ()
    max_rows: int = 16_000
    rows_per_shard: int = 4_000
    pair_weight: float = 0.0
    seed: int = 11


@dataclass
class LinearModel:
    """Bias and the non-zero weights, by bucket in ascending order."""

    bias: float = 0.0
    buckets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0, np.float64))

    def logits(self, buckets: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
        """Sparse dot products with binary features; repeats within a document count once."""
        out = np.full(n_docs, self.bias)
        if len(self.buckets) and len(buckets):
            at = np.minimum(np.searchsorted(self.buckets, buckets), len(self.buckets) - 1)
            hit = self.buckets[at] == buckets
            pairs = np.unique(docs[hit].astype(np.int64) * len(self.buckets) + at[hit])
            np.add.at(out, pairs // len(self.buckets), self.weights[pairs % len(self.buckets)])
        return out


Swap = Callable[[np.ndarray], np.ndarray]


def features(t: tk.Tokens, p: FtrlParams, swap: Swap | None = None, swapped: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and documents of all features of a chunk; terms that ``swap`` moves have no prefix features."""
    parts = [tk.ngrams(t, n, swapped) for n in p.orders]
    long = t.end - t.start
    if swap is not None:
        long = np.where(swap(t.hash) == t.hash, long, 0)
    for size in p.prefixes:
        at = long > size
        parts.append((tk.mix(t.ranges(t.start[at], t.start[at] + size) + np.uint64(size)), t.doc[at]))
    if p.runs and len(t.doc):
        new = np.ones(len(t.doc) + 1, bool)
        new[1:-1] = (t.hash[1:] != t.hash[:-1]) | (t.doc[1:] != t.doc[:-1])
        at = np.flatnonzero(new)
        for size in p.runs:
            docs = t.doc[at[:-1][np.diff(at) >= size]]
            parts.append((np.full(len(docs), tk.mix(np.array([size + 1000], np.uint64))[0]), docs))
    return np.concatenate([(h & BUCKETS).astype(np.int64) for h, _ in parts]), np.concatenate([d for _, d in parts])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray | None, int]], size: int, p: FtrlParams) -> np.ndarray:
    """Weights (the last is the bias) of one shard; rows: feature indices, those of the swapped text, label."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        l1 = np.where(at == size, 0.0, p.l1)  # the bias is not shrunk
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    def update(at: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        g2 = g * g
        z[at] += g - (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / p.alpha * w
        n[at] += g2

    order = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for i in order.permutation(len(rows)):
            own, swapped, label = rows[i]
            at = np.append(own, size)
            w = weights(at)
            update(at, w, np.full(len(at), sigmoid(w.sum()) - label))
            if swapped is not None and p.pair_weight:
                plus, minus = np.setdiff1d(own, swapped), np.setdiff1d(swapped, own)
                wp, wm = weights(plus), weights(minus)
                change = 2 * p.pair_weight * (wp.sum() - wm.sum())
                update(plus, wp, np.full(len(plus), change))
                update(minus, wm, np.full(len(minus), -change))
    return weights(np.arange(size + 1))


def fit(docs: DataFrame, labels: DataFrame, *, label: str, fold: F.Column, classes: np.ndarray, params: FtrlParams, swap: Swap | None = None) -> LinearModel:
    """Fit ``labels[label]`` (0/1) on ``docs.text``.

    fold: condition on ``doc_id`` that a label must meet to be learnt from.
    swap: maps token hashes to those of the counterfactual text.
    Null labels and ids are left out; a doc_id labelled twice counts with its larger label;
    a repeated row of documents is learnt from twice.  No labelled row: bias 0, no weights.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & fold)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    total = known.count()
    if not total:
        return LinearModel()
    spread = F.pmod(F.xxhash64(F.lit(params.seed), "doc_id"), F.lit(1 << 53))  # exact for any number of labels
    sample = known.filter(spread < int((1 << 53) * min(1.0, params.max_rows / total)))
    shards = max(1, round(min(total, params.max_rows) / params.rows_per_shard))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, key = batch.column("y"), batch.column("shard")
            for first, last, data, offsets in tk.chunks(batch):
                t = tk.tokenize(data, offsets, classes)
                found = [features(t, params, swap)]
                if swap is not None:
                    changed = swap(t.hash)
                    found.append(features(t, params, swap, changed))
                    touched = np.zeros(last - first, bool)
                    touched[t.doc[changed != t.hash]] = True
                binary = []
                for buckets, doc in found:
                    by = np.argsort(doc, kind="stable")
                    buckets, cut = buckets[by], np.searchsorted(doc[by], np.arange(last - first + 1))
                    binary.append([np.unique(buckets[cut[i] : cut[i + 1]]).astype(np.int32).tobytes() for i in range(last - first)])
                other = [x if touched[i] else None for i, x in enumerate(binary[1])] if swap is not None else [None] * (last - first)
                yield pa.RecordBatch.from_arrays([key.slice(first, last - first), y.slice(first, last - first), pa.array(binary[0], pa.binary()), pa.array(other, pa.binary())], names=["shard", "y", "own", "swapped"])

    def train(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # The same result however the rows arrived.
        rows = rows.assign(swapped=[x or b"" for x in rows["swapped"]]).sort_values(["own", "y", "swapped"], kind="stable")
        own = [np.frombuffer(x, np.int32) for x in rows["own"]]
        swapped = [np.frombuffer(x, np.int32) if x else None for x in rows["swapped"]]
        space = np.unique(np.concatenate([x for x in own + swapped if x is not None]))
        found = [(np.searchsorted(space, a), None if b is None else np.searchsorted(space, b), int(y)) for a, b, y in zip(own, swapped, rows["y"], strict=True)]
        w = ftrl(found, len(space), params)
        used = np.flatnonzero(w[:-1])
        return pd.DataFrame({"bucket": [-1, *space[used]], "w": w[[-1, *used]], "n": len(rows)})

    # The sample is bounded by max_rows, so its side may be broadcast whatever the tables' size.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(shards)).cast("int").alias("shard"))
    found = rows.mapInArrow(extract, "shard int, y int, own binary, swapped binary")
    got = found.groupBy("shard").applyInPandas(train, "bucket int, w double, n long").toPandas()
    if got.empty:
        return LinearModel()
    got = got.sort_values(["bucket", "w", "n"], kind="stable")  # sums do not depend on which shard was first
    n = got.loc[got.bucket == -1, "n"].sum()
    mean = (got.w * got.n).groupby(got.bucket).sum() / n
    rest = mean[mean.index >= 0].sort_index()
    return LinearModel(float(mean.get(-1, 0.0)), rest.index.to_numpy(np.int64), rest.to_numpy(np.float64))


def score(docs: DataFrame, model: LinearModel, *, classes: np.ndarray, params: FtrlParams, keep: list[str], swap: Swap | None = None, name: str = "score") -> DataFrame:
    """``keep`` columns of ``docs`` and the probability of label 1 for each row's whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = np.empty(batch.num_rows)
            for first, last, data, offsets in tk.chunks(batch):
                buckets, doc = features(tk.tokenize(data, offsets, classes), params, swap)
                scores[first:last] = sigmoid(model.logits(buckets, doc, last - first))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores)], names=[*keep, name])

    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{name}` double"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def validate(docs: DataFrame, labels: DataFrame, *, label: str, fold: F.Column, inner: F.Column, threshold: float, classes: np.ndarray, params: FtrlParams, swap: Swap | None = None) -> DataFrame:
    """One row: log loss and counts of hits and errors on the labels of ``fold`` that meet ``inner``, fitted on its others.

    Parameters are chosen by this, so that labels outside ``fold`` decide nothing.
    """
    model = fit(docs, labels, label=label, fold=fold & ~inner, classes=classes, params=params, swap=swap)
    asked = labels.filter(fold & inner & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    p = F.least(F.greatest(F.col("score"), F.lit(1e-9)), F.lit(1 - 1e-9))
    rows = score(docs.join(asked, "doc_id", "left_semi"), model, classes=classes, params=params, keep=["doc_id"], swap=swap).join(asked, "doc_id")
    hit, y = F.col("score") >= threshold, F.col("y") == 1
    return rows.agg(F.avg(F.when(y, -F.log(p)).otherwise(-F.log(1 - p))).alias("loss"), F.count_if(hit & y).alias("tp"), F.count_if(~hit & y).alias("fn"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"))
