"""Snapshots: differences, checksums and upserts; upkeep of a stored index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..sources.export_json import build_flat, flatten
from ..sources.store import Store, Table
from ..storage import materialize, spread
from . import fulltext


def checksum(columns: Sequence[str]) -> Column:
    """Digest of the columns' texts; null and empty differ."""
    return F.md5(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]).cast("binary"))


def checksum_diff(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, change): added, modified or deleted."""
    a = old.select(F.col(key), checksum(columns).alias("_a"))
    b = new.select(F.col(key), checksum(columns).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_a") != F.col("_b"), "modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change IS NOT NULL")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events between snapshots (id, name, updated, tags): create, modify or delete, with what changed."""
    a = old.select("id", *[F.col(c).alias(f"old_{c}") for c in ("name", "updated", "tags")], F.lit(True).alias("_a"))
    b = new.select("id", "name", "updated", "tags", F.lit(True).alias("_b"))
    both = a.join(b, "id", "full_outer")
    same = F.col("old_name").eqNullSafe(F.col("name")) & F.col("old_updated").eqNullSafe(F.col("updated")) & F.col("old_tags").eqNullSafe(F.col("tags"))
    kind = F.when(F.col("_a").isNull(), "create").when(F.col("_b").isNull(), "delete").when(~same, "modify")
    none = F.array().cast("array<string>")
    added, removed = F.array_except(F.coalesce("tags", none), F.coalesce("old_tags", none)), F.array_except(F.coalesce("old_tags", none), F.coalesce("tags", none))
    return both.withColumn("type", kind).filter("type IS NOT NULL").select("type", "id", F.coalesce("name", "old_name").alias("name"), F.col("old_name").alias("name_before"), F.array_join(F.array_sort(added), ",").alias("added"), F.array_join(F.array_sort(removed), ",").alias("removed"))


def last_per_key(changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The latest change of each key, ties by all columns."""
    rest = [c for c in changes.columns if c not in order]
    # A task sorts its changes to find the latest, so they are dealt out first: a few large files, or many changes of one key, do not stay one task's.
    return spread(changes, key, order[0]).groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*order, *rest)).alias("x")).select(*[F.col(f"x.{c}").alias(c) for c in changes.columns])


def upsert(target: DataFrame, changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The latest row of each key, of the target and of the changes: a change that is older than the target's row does nothing."""
    return last_per_key(target.unionByName(changes.select(*target.columns)), key, order)


def replace_groups(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``rows`` replaced by them (tags of a node, values of an attribute)."""
    return target.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.select(*target.columns))


def stale(ids: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    return ids.join(valid.select(key), key, "left_anti")


def freshness(items: DataFrame, as_of_ms: int, days: int = 30) -> DataFrame:
    """Age of ``items(id, at)`` in whole days, and whether it is beyond the limit; an unknown time is stale."""
    age = F.floor((F.lit(as_of_ms) - F.col("at")) / 86_400_000).cast("long")
    return items.select("id", age.alias("age_days"), F.coalesce(age > days, F.lit(True)).alias("stale"))


def linked_freshness(items: DataFrame, links: DataFrame, activity: DataFrame, as_of_ms: int, days: int = 30) -> DataFrame:
    """``freshness`` of ``items(id, at)`` that also count as active when something they link to was: ``links(id, target)``, ``activity(target, at)``."""
    seen = links.join(activity.withColumnRenamed("at", "_at"), "target").groupBy("id").agg(F.max("_at").alias("_at"))
    return freshness(items.join(seen, "id", "left").select("id", F.greatest("at", "_at").alias("at")), as_of_ms, days)


#: Tables of a stored index: columns, and the column with the owner of a row.
INDEX: dict[str, tuple[str, str]] = {
    "nodes": ("id string, name string, parent_id string, created long, updated long, tag string", "id"),
    "tags": ("id string, tag string", "id"),
    "fields": ("id string, field string, value string, value_order int, value_id string", "id"),
    "links": ("source string, target string, kind string", "source"),
}
DIGESTS = "owner string, part string, digest string"


def index_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    """The store of an index: each table by the owner of its rows, and per owner and table a digest of these rows."""
    tables = {name: Table(schema, (owner,), buckets) for name, (schema, owner) in INDEX.items()}
    return Store(spark, path, tables | {"digests": Table(DIGESTS, ("owner",), buckets)} | fulltext.tables(buckets))


def owner_digests(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(owner, part, digest) of all rows of each owner in each table, whatever their order; rows that are there twice count twice."""
    parts = []
    for name, table in tables.items():
        schema, owner = INDEX[name]
        columns = Table(schema, (owner,)).columns
        row, low = F.xxhash64(*columns), F.lit(0xFFFFFFFF)
        both = F.concat_ws(":", F.count("*"), F.bit_xor(row), F.sum(row.bitwiseAND(low)), F.sum(F.xxhash64(F.lit(1), *columns).bitwiseAND(low)))
        parts.append(table.groupBy(F.col(owner).alias("owner")).agg(both.alias("digest")).select("owner", F.lit(name).alias("part"), "digest"))
    return reduce(DataFrame.unionByName, parts)


def update_export(store: Store, docs: DataFrame, searchable: bool = True) -> DataFrame:
    """``update_index`` from an export's docs(id, props, children, modifiedTs), which are read once.

    A digest of the whole export is kept too: an export that is no other than the last is only read.
    """
    flat = materialize(flatten(docs))
    row, low = F.xxhash64(*flat.columns), F.lit(0xFFFFFFFF)
    whole = flat.agg(F.concat_ws(":", F.count("*"), F.bit_xor(row), F.sum(row.bitwiseAND(low)), F.sum(F.xxhash64(F.lit(1), *flat.columns).bitwiseAND(low)))).first()[0]
    held = store.read("digests", buckets=store.touched("digests", store.spark.createDataFrame([("",)], "owner string"))).filter("part = 'export'").first()
    if held is not None and held.digest == whole:
        return store.spark.createDataFrame([], "owner string, part string, change string")
    return update_index(store, build_flat(flat), searchable, whole)


def update_index(store: Store, cat: Catalog, searchable: bool = True, whole: str | None = None) -> DataFrame:
    """Brings all tables of the index to the state of ``cat``, in one commit; (owner, part, change) of what differed.

    One comparison of digests finds the owners whose rows differ, in any table, for whatever reason (an attribute changes
    when the text of its value does).  Only their buckets are read and written.  With ``searchable`` the
    postings of names follow the same changes.
    """
    tables = {name: materialize(getattr(cat, name).select(*Table(schema, (owner,)).columns)) for name, (schema, owner) in INDEX.items()}
    new = owner_digests(tables)
    if whole is not None:
        new = new.unionByName(store.spark.createDataFrame([("", "export", whole)], DIGESTS))
    new = materialize(new)
    both = store.read("digests").withColumnRenamed("digest", "old").join(new, ["owner", "part"], "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("digest").isNull(), "deleted").when(F.col("old") != F.col("digest"), "modified")
    changes = materialize(both.select("owner", "part", kind.alias("change"), "digest").filter("change IS NOT NULL"))
    found = changes.filter("part <> 'export'").drop("digest")
    if changes.isEmpty():
        return found
    replaced = {}
    for name, table in tables.items():
        owner = INDEX[name][1]
        of = changes.filter(F.col("part") == name).select(F.col("owner").alias(owner))
        replaced[name] = (of, table.join(of, owner, "left_semi"), [owner])
    keys = changes.select("owner", "part")
    replaced["digests"] = (keys, changes.filter("digest IS NOT NULL").select("owner", "part", "digest"), ["owner", "part"])
    if searchable:
        names = changes.filter("part = 'nodes'").select(F.col("owner").alias("id"))
        replaced |= fulltext.replacements(store, names, replaced["nodes"][1].select("id", F.col("name").alias("text"), "created", "updated"))
    store.replace((store.versions() or [-1])[-1] + 1, replaced)
    return found


def stored_catalog(store: Store) -> Catalog:
    """The index's tables as a catalog; declared attributes and the hierarchy of tags are not kept in it."""
    spark = store.spark
    none = spark.createDataFrame([], "child string, parent string"), spark.createDataFrame([], "tag string, field string, field_order int, kind string")
    return Catalog(*[store.read(name) for name in INDEX], *none)
