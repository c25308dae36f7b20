"""Removal of every byte that lies in a 400-byte string occurring more than once.

A suffix array of the corpus would sort every byte position.  Only strings of at least
400 bytes matter here, so suffixes are sampled, named and compared at the samples alone:

1. Cover.  Of the grams (200 bytes) inside each 400-byte window the smallest hash is the
   window's sample.  The choice depends on the window's bytes only, so equal windows
   sample alike, wherever they stand; neighbours share samples, about one per 100 bytes.
2. Names.  A sample's gram is named by its hash, its whole context (all windows that
   it stands for) by another.  Names that occur once are settled: no window there repeats.
   Contexts that occur twice are settled too: all their windows repeat.
3. Remaining suffixes.  Where the name repeats but the context does not, the single
   windows are named and counted; of repeated contexts with such a name one copy joins.
4. The covered ranges are joined to their text and cut out.

Passages of over 50 words may be shorter than 400 bytes.  They are found beside by the same
steps over the hashes of words instead of bytes (runs of other than white space, A-Z
lower-cased; 51-word windows, 20-word grams), are told apart from repeats inside one document
by counting a name once a row, and are reported as ranges of words; they remove nothing.

Steps 1 to 3 move hashes and offsets; text is shuffled only by document.  Counts are
partial sums, and joins on names may be split by skew, so a passage in a third of all
documents meets in no single task.  Equality is that of 64-bit hashes.

Edge cases: null and empty texts lose nothing; texts shorter than the length lose
nothing; repeated rows repeat each other and go entirely; rows without doc_id are
handled as any other; very long texts are sampled in segments, and what spans two
segments falls to step 3; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .shared import materialize

LENGTH, GRAM, SEGMENT = 400, 200, 1 << 20
WORDS, WORD_GRAM = 51, 20
_POSITION_BITS = 21  # SEGMENT and a window fit


def samples(grams: np.ndarray, reach: int) -> np.ndarray:
    """For each run of ``reach`` grams, the position of its smallest (the first of equals)."""
    n = len(grams) - reach + 1
    low = np.uint64((1 << _POSITION_BITS) - 1)
    key = grams & ~low | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= reach:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < reach:
        key = np.minimum(key[: len(key) - (reach - size)], key[reach - size :])
    return (key[:n] & low).astype(np.int64)


def contexts(data: np.ndarray, length: int, gram: int, segment: int = SEGMENT, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window, name and context of each sample of one document, or of those that ``rows`` tells apart."""
    parts = []
    for base in range(0, len(data) - length + 1, segment):
        piece = data[base : base + segment + length - 1]
        r = tk.RangeHash(piece)
        n = len(piece) - gram + 1
        grams = tk.mix((r.prefix[gram:] - r.prefix[:n]) * r.inverse[:n])
        at = samples(grams, length - gram + 1)
        cut = at[1:] != at[:-1]
        if rows is not None:
            row = rows[base : base + len(at)]
            inside = row == rows[base + length - 1 : base + length - 1 + len(at)]
            cut |= (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(np.concatenate([[True], cut]))
        last = np.append(first[1:], len(at)) - 1
        if rows is not None:
            first, last = first[inside[first]], last[inside[first]]
        sample = at[first]
        place = tk.mix(((sample - first) << 32 | (last - first)).astype(np.uint64))
        parts.append((first + base, last + base, grams[sample], tk.mix(r(first, last + length) ^ place)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2


def word_contexts(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, segment: int) -> tuple[np.ndarray, ...]:
    """Row, first window, last window, name and context of each sample of a chunk's words, counted in words of the row."""
    words = tk.tokenize(data, offsets, tk.NON_SPACE)
    first, last, name, context = contexts(words.hash, length, gram, segment, words.doc)
    row = words.doc[first]
    start = np.searchsorted(words.doc, np.arange(len(offsets) - 1))[row]
    return row, first - start, last - start, name, context


def _once(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The positions of one of each row's equal keys."""
    order = np.lexsort((key, row))
    a, b = row[order], key[order]
    return order[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])] if len(row) else order


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text): rows with equal keys are equal."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a.h == b.h) & a.doc_id.eqNullSafe(b.doc_id)


def names(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, segment: int = SEGMENT, words: int = WORDS, word_gram: int = WORD_GRAM) -> DataFrame:
    """(key) the names and contexts of all samples, those of words once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in tk.chunks(batch):
                keys = [k for a, b in zip(offsets[:-1], offsets[1:], strict=True) for k in contexts(data[a:b], length, gram, segment)[2:]]
                row, _, _, name, context = word_contexts(data, offsets, words, word_gram, segment)
                keys += [name[_once(row, name)], context[_once(row, context)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64))], names=["key"])

    return docs.select("text").mapInArrow(run, "key long")


def sampled(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, segment: int = SEGMENT, words: int = WORDS, word_gram: int = WORD_GRAM) -> DataFrame:
    """(doc_id, h, words, first, last, name, context) of each sample of ``keyed`` documents, of bytes or of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in tk.chunks(batch):
                got = [contexts(data[a:b], length, gram, segment) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                of_bytes = (np.repeat(np.arange(stop - row), [len(x[0]) for x in got]), *(np.concatenate(x) for x in zip(*got, strict=True)))
                for kind, (at, first, last, name, context) in enumerate((of_bytes, word_contexts(data, offsets, words, word_gram, segment))):
                    take = pa.array(at + row)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(take), batch.column("h").take(take), pa.array(np.full(len(at), kind > 0)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(name.view(np.int64)), pa.array(context.view(np.int64))],
                        names=["doc_id", "h", "words", "first", "last", "name", "context"],
                    )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, h long, words boolean, first int, last int, name long, context long")


def _windows(data: np.ndarray, first: np.ndarray, last: np.ndarray, single: np.ndarray, length: int, segment: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start, single and hash of each window in the ranges, segment by segment."""
    for base in range(0, len(data), segment):
        here = (first >= base) & (first < base + segment)
        if not here.any():
            continue
        size = (last - first + 1)[here]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[here], size)
        r = tk.RangeHash(data[base : last[here].max() + length])
        yield at, np.repeat(single[here], size).astype(bool), r(at - base, at - base + length)


def windows(docs: DataFrame, ranges: DataFrame, length: int = LENGTH, segment: int = SEGMENT, words: int = WORDS) -> DataFrame:
    """(doc_id, h, words, at, single, new, window): the hash of each window in ``ranges(doc_id, h, words, first, last, single)``; of a row's equal windows of words one is new."""
    per_doc = ranges.groupBy("doc_id", "h").agg(F.collect_list(F.struct("first", "last", "single", "words")).alias("ranges"))
    rows = docs.join(per_doc, _same(docs, per_doc)).select(docs.doc_id, docs.h, "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ranges")
            cut, fields = column.offsets.to_numpy(), [column.values.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
            for row, stop, data, offsets in tk.chunks(batch):
                for i in range(row, stop):
                    text = data[offsets[i - row] : offsets[i - row + 1]]
                    first, last, single, kind = (f[cut[i] : cut[i + 1]] for f in fields)
                    kind = kind.astype(bool)
                    found = [(False, at, alone, np.ones(len(at), bool), window) for at, alone, window in _windows(text, first[~kind], last[~kind], single[~kind], length, segment)]
                    if kind.any():
                        tokens = tk.tokenize(text, np.array([0, len(text)]), tk.NON_SPACE).hash
                        at, alone, window = (np.concatenate(x) for x in zip(*_windows(tokens, first[kind], last[kind], single[kind], words, segment), strict=True))
                        new = np.zeros(len(at), bool)
                        new[np.unique(window, return_index=True)[1]] = True
                        found.append((True, at, alone, new, window))
                    for of_words, at, alone, new, window in found:
                        take = pa.array(np.full(len(at), i))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(take), batch.column("h").take(take), pa.array(np.full(len(at), of_words)), pa.array(at.astype(np.int32)), pa.array(alone), pa.array(new), pa.array(window.view(np.int64))],
                            names=["doc_id", "h", "words", "at", "single", "new", "window"],
                        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, h long, words boolean, at int, single boolean, new boolean, window long")


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, segment: int = SEGMENT, words: int = WORDS, word_gram: int = WORD_GRAM) -> DataFrame:
    """(doc_id, h, covers): per document of ``keyed`` rows the ranges (words, first, last) of starts of repeated strings and of words that another row has too."""
    found = sampled(docs, length, gram, segment, words, word_gram)
    twice = materialize(names(docs, length, gram, segment, words, word_gram).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    named = found.join(twice, found.name == twice.key).drop("key")
    whole = twice.select("key", F.lit(True).alias("_whole"))
    settled = materialize(named.join(whole, named.context == whole.key, "left").select("doc_id", "h", "words", "first", "last", "name", "context", F.col("_whole").isNotNull().alias("whole")))
    single = settled.filter("NOT whole")
    open_names = single.select("name").distinct()
    # One copy per context first: then no name has more rows than it has contexts. Of words two, from two rows: one of them is not the row that asks.
    copy = F.struct("h", "doc_id", "words", "first", "last", "name")
    ends = settled.filter("whole").groupBy("context").agg(F.min(copy).alias("a"), F.max(copy).alias("b"))
    one = ends.select(F.explode(F.when(F.col("a.words"), F.array_distinct(F.array("a", "b"))).otherwise(F.array("a"))).alias("x")).select("x.*")
    copies = one.join(open_names, "name", "left_semi").select("doc_id", "h", "words", "first", "last")
    each = single.select("doc_id", "h", "words", "first", "last", F.lit(True).alias("single")).unionByName(copies.withColumn("single", F.lit(False)))
    named_windows = materialize(windows(docs, each, length, segment, words))
    again = named_windows.filter("new").groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window")
    hits = named_windows.filter("single").join(again, "window").select("doc_id", "h", "words", F.col("at").alias("first"), F.col("at").alias("last"))
    covers = settled.filter("whole").select("doc_id", "h", "words", "first", "last").unionByName(hits)
    # Written, so that the shuffles of windows are gone before the texts are shuffled.
    return materialize(covers.groupBy("doc_id", "h").agg(F.collect_set(F.struct("words", "first", "last")).alias("covers")))


def _covered(size: int, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, list[dict[str, int]]]:
    """Which of ``size`` places the windows cover, and the runs [start, end) of these."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + length, -1)
    gone = np.cumsum(edge) > 0  # the last is false
    turns = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
    return gone[:-1], [{"start": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, segment: int = SEGMENT, words: int = WORDS, word_gram: int = WORD_GRAM) -> DataFrame:
    """(doc_id, n_bytes, removed, kept, passages) for each row: the removed runs [start, end), the bytes that stay and, in words, the runs that other rows have too."""
    rows = keyed(docs)
    covers = repeated(rows, length, gram, segment, words, word_gram)
    none = F.array().cast("array<struct<words:boolean,first:int,last:int>>")
    joined = rows.join(covers, _same(rows, covers), "left").select(rows.doc_id, "text", F.coalesce("covers", none).alias("covers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("covers")
            cut, kinds, firsts, lasts = column.offsets.to_numpy(), *(column.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for row, stop, data, offsets in tk.chunks(batch):
                size, removed, kept, passages = [], [], [], []
                for i in range(row, stop):
                    text = data[offsets[i - row] : offsets[i - row + 1]]
                    kind, first, last = kinds[cut[i] : cut[i + 1]].astype(bool), firsts[cut[i] : cut[i + 1]], lasts[cut[i] : cut[i + 1]]
                    gone, runs = _covered(len(text), first[~kind], last[~kind], length)
                    size.append(len(text))
                    removed.append(runs)
                    kept.append(text[~gone].tobytes())
                    passages.append(_covered(last[kind].max() + words, first[kind], last[kind], words)[1] if kind.any() else [])
                run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, stop - row), pa.array(size, pa.int64()), pa.array(removed, run_type), pa.array(kept, pa.binary()), pa.array(passages, run_type)],
                    names=["doc_id", "n_bytes", "removed", "kept", "passages"],
                )

    kind, run_kind = docs.schema["doc_id"].dataType.simpleString(), "array<struct<start:long,end:long>>"
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, removed {run_kind}, kept binary, passages {run_kind}")


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.size("passages").cast("long").alias("n_passages"), F.expr("aggregate(passages, 0L, (n, p) -> n + p.end - p.start)").alias("n_passage_words"),
    )
