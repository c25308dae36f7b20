"""A stored full-text index: searches read the buckets of their terms, never the texts.

Tables of a ``Store``, which are committed together:

* ``postings``: a row per term and text with its count and places, the text's length and times.  A row's bucket is the hash of its
  term and slice; a term that is in more than SLICE texts when it is first indexed is dealt in slices by the
  text's id, so that no bucket grows with a frequent term.
* ``terms``: texts with the term, and slices.
* ``forward``: the postings' keys by text, which tell what to take away when a text changes.
* ``corpus``: one row, number of texts and of words.

Upkeep reads and writes the buckets of changed texts and of their old and new terms.  Terms are lower-cased runs of
letters and digits; a search takes all of them (and), those of one written word or within quotes one after another, and ranks by
BM25 over the terms.  Null texts are texts without words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.store import Store, Table
from ..storage import materialize
from .search import K1, B

#: Texts with a term in one of its slices, when it is first indexed.
SLICE = 100_000
#: Least buckets of an index whose size is known when it is made, and texts that a bucket takes then.
LEAST_BUCKETS, BUCKET_ROWS = 16, 250_000


def buckets_for(texts: int, per_bucket: int = BUCKET_ROWS) -> int:
    """Buckets of an index of so many texts: they grow in number, not in size."""
    return max(LEAST_BUCKETS, -(-texts // per_bucket))


def tables(buckets: int) -> dict[str, Table]:
    return {
        "postings": Table("term string, slice int, id string, tf int, positions array<int>, len int, created long, updated long", ("term", "slice"), buckets),
        "terms": Table("term string, df long, slices int", ("term",), buckets),
        "forward": Table("id string, term string, slice int, len int", ("id",), buckets),
        "corpus": Table("part string, n long, total long", ("part",), 1),
    }


COUNTED = "id string, len int, created long, updated long, term string, tf int, positions array<int>"


def counted(docs: DataFrame) -> DataFrame:
    """(id, len, created, updated, term, tf, positions) of ``docs(id, text, created, updated)``; a text without words has one row with a null term.

    Counted within each text, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("w")
            size = np.diff(lists.offsets.to_numpy())
            coded = lists.flatten().dictionary_encode()
            row, code = np.repeat(np.arange(len(size)), size), coded.indices.to_numpy()
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            order = np.lexsort((place, code, row))
            row, code, place = row[order], code[order], place[order]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])])) if len(row) else np.empty(0, np.int64)
            bare = np.flatnonzero(size == 0)
            cut = np.concatenate([new, [len(row)], np.full(len(bare), len(row))])  # texts without words have no places
            own = pa.array(np.concatenate([row[new], bare]))
            term = pa.concat_arrays([coded.dictionary.take(pa.array(code[new])).cast(pa.string()), pa.nulls(len(bare), pa.string())])
            at = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(place.astype(np.int32)))
            columns = [batch.column("id").take(own), pa.array(size[own.to_numpy()].astype(np.int32)), batch.column("created").take(own), batch.column("updated").take(own), term, pa.array(np.diff(cut).astype(np.int32)), at]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "len", "created", "updated", "term", "tf", "positions"])

    w = words(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(F.col("id").cast("string").alias("id"), F.col("created").cast("long").alias("created"), F.col("updated").cast("long").alias("updated"), w.alias("w")).mapInArrow(run, COUNTED)


def parts_of(query: str) -> list[list[str]]:
    """The query's parts, each the terms that stand one after another: a quoted text, or a written word."""
    terms = lambda x: "".join(c if c.isalnum() else " " for c in x.lower()).split()
    return [t for quoted, bare in re.findall(r'"([^"]*)"|(\S+)', query) if (t := terms(quoted or bare))]


def replacements(store: Store, changed: DataFrame, docs: DataFrame) -> dict[str, tuple[DataFrame, DataFrame, Sequence[str]]]:
    """What ``Store.replace`` needs to bring the index from the old texts of ``changed(id)`` to ``docs(id, text, created, updated)``."""
    ids = changed.select("id").distinct()
    old = materialize(store.read("forward", buckets=store.touched("forward", ids)).join(ids, "id", "left_semi"))
    new = materialize(counted(docs))
    # Terms: the difference in texts, and slices of those that are new.
    moved = old.filter("term IS NOT NULL").select("term", F.lit(-1).alias("d")).unionByName(new.filter("term IS NOT NULL").select("term", F.lit(1).alias("d")))
    delta = materialize(moved.groupBy("term").agg(F.sum("d").alias("d")))
    known = store.read("terms", buckets=store.touched("terms", delta)).join(delta, "term", "right")
    slices = F.coalesce("slices", F.greatest(F.lit(1), F.ceil(F.col("d") / SLICE)).cast("int"))
    terms = materialize(known.select("term", "d", (F.coalesce("df", F.lit(0)) + F.col("d")).alias("df"), slices.alias("slices")))
    # Terms of several slices are at least SLICE postings each, so they are few: postings are placed where they stand, not shuffled by term.
    sliced = terms.filter("slices > 1").select("term", "slices")
    placed = new.join(F.broadcast(sliced), "term", "left").withColumn("slice", F.pmod(F.xxhash64("id"), F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")
    size = lambda rows: rows.select("id", "len").distinct().agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).first()
    before, gone, come = store.read("corpus").first() or (None, 0, 0), size(old), size(new)
    corpus = store.spark.createDataFrame([("all", before[1] - gone.n + come.n, before[2] - gone.total + come.total)], store.tables["corpus"].schema)
    return {
        "postings": (old.filter("term IS NOT NULL").select("term", "slice", "id"), placed.filter("term IS NOT NULL"), ["term", "id"]),
        "terms": (terms.filter("d <> 0").select("term"), terms.filter("d <> 0 AND df > 0"), ["term"]),
        "forward": (ids, placed.select("id", "term", "slice", "len"), ["id"]),
        "corpus": (corpus.select("part"), corpus, ["part"]),
    }


def _stands(part: Sequence[str]) -> Column:
    """Whether the terms stand one after another, by ``at``, the map of terms to places."""
    return F.exists(F.col("at")[part[0]], lambda p: reduce(Column.__and__, [F.array_contains(F.col("at")[t], p + k) for k, t in enumerate(part)]))


def update(store: Store, changed: DataFrame, docs: DataFrame) -> None:
    """Commits new texts of ``changed(id)``; ids without a row in ``docs(id, text, created, updated)`` leave the index."""
    store.replace((store.versions() or [-1])[-1] + 1, replacements(store, changed, docs))


def search(store: Store, query: str, limit: int | None = 50, created_after: int | None = None, created_before: int | None = None, updated_after: int | None = None, updated_before: int | None = None) -> DataFrame:
    """(id, score) of the texts with all parts of the query, best first, ties by id; bounds of times are excluded, texts without a time are beyond them.

    As many rows as the query has words come to the driver, to choose buckets.
    """
    spark = store.spark
    parts = parts_of(query)
    asked = sorted({t for part in parts for t in part})
    wanted = spark.createDataFrame([(t,) for t in asked], "term string")
    known = {r.term: r for r in store.read("terms", buckets=store.touched("terms", wanted)).filter(F.col("term").isin(asked)).collect()}
    size = store.read("corpus").first()
    if not asked or len(known) < len(asked) or size is None:
        return spark.createDataFrame([], "id string, score double")
    keys = spark.createDataFrame([(t, s) for t, r in known.items() for s in range(r.slices)], "term string, slice int")
    hits = store.read("postings", buckets=store.touched("postings", keys)).filter(F.col("term").isin(asked))
    for name, test in (("created", (created_after, created_before)), ("updated", (updated_after, updated_before))):
        if test[0] is not None:
            hits = hits.filter(F.col(name) > test[0])
        if test[1] is not None:
            hits = hits.filter(F.col(name) < test[1])
    df: Column = F.create_map(*[F.lit(x) for t, r in known.items() for x in (t, float(r.df))])[F.col("term")]
    idf = F.log((F.lit(float(size.n)) - df + 0.5) / (df + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(size.total / size.n)))
    # A word has one row a text.  Shares are added in one order, so that the last digits do not depend on arrival, and nothing is gathered.
    shares = reduce(Column.__add__, [F.max(F.when(F.col("term") == t, part)) for t in asked], F.lit(0.0))
    phrases = [part for part in parts if len(part) > 1]
    places = [F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at")] if phrases else []
    out = hits.groupBy("id").agg(F.count("*").alias("met"), F.round(shares, 6).alias("score"), *places).filter(F.col("met") == len(asked))
    for part in phrases:
        out = out.filter(_stands(part))
    out = out.select("id", "score")
    return out.orderBy(F.desc("score"), "id").limit(limit) if limit else out
