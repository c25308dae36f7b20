"""Queries that ingest an export made of the tables, and keep an index up to date, each beside its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import STAR_SQL
from .operators import fulltext as ft
from .operators import incremental as inc
from .operators import vectors as vx
from .queries import _VECTORS, _WORDS, EVENTS_FROM, ORACLE_SQL, QUERIES, QUERY_VECTOR, _bm25_sql, catalog_of
from .sources import export_json as ex
from .sources.store import Store
from .storage import shared_dir, spread


def export_of(customers: DataFrame) -> DataFrame:
    """An export's nodes: per customer the node, its attribute as a tuple with label and value, and its tag's application."""
    key = F.col("c_custkey").cast("string")
    ident = lambda x: F.concat(F.lit(f"{x}:"), key)

    def doc(at: Column, name: Column | None, owner: Column | None, kind: str | None, children: list[Column]) -> Column:
        text = lambda c: (F.lit(None) if c is None else c).cast("string")
        props = F.struct(F.lit(1704067200000).alias("created"), text(name).alias("name"), text(owner).alias("_ownerId"), F.lit(kind).cast("string").alias("_docType"), F.lit(None).cast("string").alias("_done"))
        below = F.array(*children) if children else F.array().cast("array<string>")
        return F.struct(at.alias("id"), props.alias("props"), below.alias("children"), F.lit("1704067200001").alias("modifiedTs"))

    per_row = [
        doc(ident("c"), F.col("c_name"), None, None, [ident("f")]), doc(ident("m"), None, ident("c"), None, [ident("g")]),
        doc(ident("g"), None, ident("m"), "tuple", [F.lit(ex.TAG_MARK), F.lit("T")]), doc(ident("f"), None, ident("c"), "tuple", [F.lit("L"), ident("v")]),
        doc(ident("v"), F.col("c_mktsegment"), ident("f"), None, []),
    ]
    schema = [doc(F.lit("T"), F.lit("customer"), None, None, []), doc(F.lit("MT"), None, F.lit("T"), None, [F.lit("XT")]), doc(F.lit("XT"), None, F.lit("MT"), "tuple", [F.lit(ex.TAG_MARK), F.lit(ex.TAG_DEFINITION)]), doc(F.lit("L"), F.lit("Segment"), None, None, [])]
    rows = spread(customers, "c_custkey").select(F.inline(F.array(*per_row)))
    return rows.unionByName(customers.sparkSession.range(1).select(F.inline(F.array(*schema))))


def _ingested(spark: SparkSession, sf_dir: str):
    """The catalog built from the export's lines, written and read again."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    export_of(spark.read.parquet(f"{sf_dir}/customer.parquet")).write.json(folder)
    return ex.build(ex.read_lines(spark, folder))


def ingest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the ingested export by kind, with how many have a parent."""
    return _ingested(spark, sf_dir).nodes.groupBy("tag").agg(F.count("*").alias("n"), F.count("parent_id").alias("with_parent"), F.count("name").alias("named"))


def ingest_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).tags.select("id", "tag")


def ingest_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).fields.select("id", "field", "value", "value_order", "value_id")


def ingest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).links.groupBy("kind").agg(F.count("*").alias("n"))


QUERIES |= {f.__name__: f for f in (ingest_nodes, ingest_tags, ingest_fields, ingest_links)}
ORACLE_SQL |= {
    "ingest_nodes": "WITH c AS (SELECT count(*) AS n FROM customer) SELECT 'node' AS tag, 3 * n + 3 AS n, n + 2 AS with_parent, 2 * n + 2 AS named FROM c UNION ALL SELECT 'tuple', 2 * n + 1, 2 * n + 1, 0 FROM c",
    "ingest_tags": "SELECT 'c:' || c_custkey AS id, 'customer' AS tag FROM customer",
    "ingest_fields": "SELECT 'c:' || c_custkey AS id, 'Segment' AS field, c_mktsegment AS value, 0 AS value_order, 'v:' || c_custkey AS value_id FROM customer",
    "ingest_links": "WITH c AS (SELECT 5 * count(*) + 1 AS n FROM customer) SELECT 'child' AS kind, n FROM c UNION ALL SELECT 'parent', n FROM c",
}


_stores: dict[tuple[str, int, str, str], Store] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], Store]) -> Store:
    """The store that ``build(path)`` fills, once per session and folder of tables; later calls read it."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, name)
    if key not in _stores:
        _stores[key] = build(f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    return _stores[key]


# An index of an export, brought from one version of the customers to the next


_NEW_CUSTOMERS = "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'ROBOTS' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 13 = 0 THEN c_name || ' Ltd' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey + 1000000000, c_mktsegment, c_name FROM customer WHERE c_custkey % 11 = 0"


def _customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment", "c_name")
    key = F.col("c_custkey")
    new = old.filter(key % 5 != 0).withColumns({"c_mktsegment": F.when(key % 7 == 0, "ROBOTS").otherwise(F.col("c_mktsegment")), "c_name": F.when(key % 13 == 0, F.concat("c_name", F.lit(" Ltd"))).otherwise(F.col("c_name"))})
    return old, new.unionByName(old.filter(key % 11 == 0).withColumn("c_custkey", key + 1000000000))


def _index(spark: SparkSession, path: str, sf_dir: str) -> Store:
    """An empty index with buckets for the export's nodes, five a customer."""
    return inc.index_store(spark, path, ft.buckets_for(5 * spark.read.parquet(f"{sf_dir}/customer.parquet").count()))


def _kept_up(spark: SparkSession, sf_dir: str) -> Store:
    """The index of the first version, brought to the second."""

    def build(path: str) -> Store:
        store = _index(spark, path, sf_dir)
        for version in _customers(spark, sf_dir):
            inc.update_export(store, export_of(version))
        return store

    return stored(spark, sf_dir, "export", build)


def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attribute table after the upkeep: rows of changed owners only were written, those of deleted ones are gone."""
    return _kept_up(spark, sf_dir).read("fields").select("id", "field", "value", "value_order", "value_id")


def incremental_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_up(spark, sf_dir).read("tags")


def incremental_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_up(spark, sf_dir).read("links").groupBy("kind").agg(F.count("*").alias("n"))


def incremental_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a word, from the postings after the upkeep."""
    return ft.search(_kept_up(spark, sf_dir), "Ltd customer", None)


def incremental_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners that differ between the versions, by table and kind of change, from one comparison."""
    store = _index(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", sf_dir)
    old, new = _customers(spark, sf_dir)
    inc.update_export(store, export_of(old), searchable=False)
    found = inc.update_export(store, export_of(new), searchable=False)
    return found.groupBy("part", "change").agg(F.count("*").alias("n"))


_EXPORTED = f"WITH new AS ({_NEW_CUSTOMERS}), docs(id, name) AS (SELECT 'c:' || c_custkey, c_name FROM new UNION ALL SELECT 'v:' || c_custkey, c_mktsegment FROM new UNION ALL SELECT unnest(['m:' || c_custkey, 'g:' || c_custkey, 'f:' || c_custkey]), NULL FROM new UNION ALL VALUES ('T', 'customer'), ('MT', NULL), ('XT', NULL), ('L', 'Segment'))"


QUERIES |= {f.__name__: f for f in (incremental_index, incremental_tags, incremental_links, incremental_search, incremental_changes)}
ORACLE_SQL |= {
    "incremental_index": f"WITH new AS ({_NEW_CUSTOMERS}) SELECT 'c:' || c_custkey AS id, 'Segment' AS field, c_mktsegment AS value, 0 AS value_order, 'v:' || c_custkey AS value_id FROM new",
    "incremental_tags": f"WITH new AS ({_NEW_CUSTOMERS}) SELECT 'c:' || c_custkey AS id, 'customer' AS tag FROM new",
    "incremental_links": f"WITH c AS (SELECT 5 * count(*) + 1 AS n FROM ({_NEW_CUSTOMERS})) SELECT 'child' AS kind, n FROM c UNION ALL SELECT 'parent', n FROM c",
    "incremental_search": f"{_EXPORTED}, r AS (SELECT id, w, len(w)::double AS len FROM (SELECT id, coalesce({_WORDS.format('name')}, []) AS w FROM docs)), s AS (SELECT count(*)::double AS n, avg(len) AS avg_len, sum(list_contains(w, 'ltd')::int)::double AS d0, sum(list_contains(w, 'customer')::int)::double AS d1 FROM r) SELECT id, round((ln((n - d0 + 0.5) / (d0 + 0.5) + 1) + ln((n - d1 + 0.5) / (d1 + 0.5) + 1)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len / avg_len)), 6) AS score FROM r, s WHERE list_has_all(w, ['ltd', 'customer'])",
    "incremental_changes": """WITH o AS (SELECT c_custkey AS k FROM customer), x AS (SELECT k, k % 5 = 0 AS gone, k % 7 = 0 AS robots, k % 13 = 0 AS named, k % 11 = 0 AS copied FROM o)
SELECT part, change, sum(n)::bigint AS n FROM (SELECT unnest(['nodes', 'tags', 'fields', 'links']) AS part, 'added' AS change, unnest([5, 1, 1, 5]) * count(*) AS n FROM x WHERE copied UNION ALL SELECT unnest(['nodes', 'tags', 'fields', 'links']), 'deleted', unnest([5, 1, 1, 5]) * count(*) FROM x WHERE gone
UNION ALL SELECT 'nodes', 'modified', count(*) FILTER (robots) + count(*) FILTER (named) FROM x WHERE NOT gone UNION ALL SELECT 'fields', 'modified', count(*) FROM x WHERE NOT gone AND robots
UNION ALL SELECT 'links', 'modified', 2) WHERE n > 0 GROUP BY ALL""",
}


# Stored full-text indexes: built once, then searches read the buckets of their words


def _documents(spark: SparkSession, sf_dir: str) -> Store:
    def build(path: str) -> Store:
        # A document has some hundred words, so a bucket takes fewer of them than of names.
        store = Store(spark, path, ft.tables(max(64, ft.buckets_for(spark.read.parquet(f"{sf_dir}/documents.parquet").count(), 10_000))))
        none = F.lit(None).cast("long")
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "text", none.alias("created"), none.alias("updated"))
        ft.update(store, docs, docs)
        return store

    return stored(spark, sf_dir, "documents", build)


def fts_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with both words, best first, from the stored index."""
    hits = ft.search(_documents(spark, sf_dir), "und der", None).select(F.col("id").cast("long").alias("doc_id"), "score")
    return hits.orderBy(F.desc("score"), "doc_id").limit(50)


def fts_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two words one after the other, by the places in the stored index."""
    hits = ft.search(_documents(spark, sf_dir), '"of The"', None).select(F.col("id").cast("long").alias("doc_id"), "score")
    return hits.orderBy(F.desc("score"), "doc_id").limit(50)


def _names(spark: SparkSession, sf_dir: str) -> Store:
    def build(path: str) -> Store:
        rows = catalog_of(spark, sf_dir).nodes.filter("tag IN ('order', 'event', 'part', 'customer')").select("id", F.col("name").alias("text"), "created", "updated")
        store = Store(spark, path, ft.tables(ft.buckets_for(rows.count())))
        ft.update(store, rows, rows)
        return store

    return stored(spark, sf_dir, "names", build)


def fts_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a word, of nodes created within bounds."""
    return ft.search(_names(spark, sf_dir), "order", 50, created_after=883612800000, created_before=915148800000)


def fts_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a word, of nodes updated within bounds."""
    return ft.search(_names(spark, sf_dir), "Purchase", None, updated_after=EVENTS_FROM + 86400000, updated_before=EVENTS_FROM + 10 * 86400000)


def _searched(word: str, test: str, more: str = "") -> str:
    return f"{STAR_SQL}, r AS (SELECT id, created, updated, w, len(w)::double AS len, len(list_filter(w, lambda x: x = '{word}')) AS tf FROM (SELECT *, coalesce({_WORDS.format('name')}, []) AS w FROM nodes WHERE tag IN ('order', 'event', 'part', 'customer'))), s AS (SELECT count(*)::double AS n, avg(len) AS avg_len, sum((tf > 0)::int)::double AS df FROM r) SELECT id, round(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)), 6) AS score FROM r, s WHERE tf > 0 AND {test}{more}"


QUERIES |= {f.__name__: f for f in (fts_indexed, fts_phrases, fts_created, fts_updated)}
ORACLE_SQL |= {
    "fts_phrases": f"SELECT doc_id, score FROM ({_bm25_sql(['of', 'the'], 1 << 40)}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_WORDS.format('text')}, ' ') || ' ', ' of the ')) ORDER BY score DESC, doc_id LIMIT 50",
    "fts_indexed": _bm25_sql(["der", "und"]),
    "fts_created": _searched("order", "created > 883612800000 AND created < 915148800000", " ORDER BY score DESC, id LIMIT 50"),
    "fts_updated": _searched("purchase", f"updated > {EVENTS_FROM + 86400000} AND updated < {EVENTS_FROM + 10 * 86400000}"),
}


# A stored index of vectors


def _vectors(spark: SparkSession, sf_dir: str) -> Store:
    def build(path: str) -> Store:
        index = vx.store(spark, path)
        vx.build(index, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("tag")), 64)
        return index

    return stored(spark, sf_dir, "vectors", build)


def vec_indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors most like one, from the cells that can hold them."""
    return vx.search(_vectors(spark, sf_dir), QUERY_VECTOR, 10).withColumnRenamed("id", "vec_id")


def vec_indexed_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among the vectors with a tag, which are told apart before the cut."""
    return vx.search(_vectors(spark, sf_dir), QUERY_VECTOR, 10, tag="3").withColumnRenamed("id", "vec_id")


def vec_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: vectors in the cells, which hold every one."""
    return _vectors(spark, sf_dir).read("cells").agg(F.sum("n").alias("vectors"))


QUERIES |= {f.__name__: f for f in (vec_indexed_topk, vec_indexed_tag, vec_cells)}
ORACLE_SQL |= {
    "vec_indexed_topk": f"SELECT vec_id, similarity FROM {_VECTORS} ORDER BY similarity DESC, vec_id LIMIT 10",
    "vec_indexed_tag": f"SELECT vec_id, similarity FROM {_VECTORS} WHERE label = 3 ORDER BY similarity DESC, vec_id LIMIT 10",
    "vec_cells": "SELECT count(*) AS vectors FROM embeddings",
}
