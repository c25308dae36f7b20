"""Change feeds: upserts and deletions into a versioned table or index, snapshot events, windowed counts.

The target is a ``Store``: a micro-batch rewrites the buckets that its keys fall into, and no other, as a version with the
batch's number; a batch that is tried again writes the same version again, so nothing is applied twice.  One feed, with one
checkpoint, writes a target.

Of each key the latest row by the feed's order stays, over all batches: a change that comes late does not undo a
newer one, whichever batch had that.  Deleted keys stay as rows with a mark for the same reason; readers do not see them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalog import Catalog
from ..operators.incremental import last_per_key, snapshot_diff
from ..sources import export_json
from ..sources.store import Store, Table

#: Buckets of a target; a batch rewrites those that its keys fall into.
BUCKETS = 64


def read_changes(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Change files as they arrive; a broken record becomes a row of nulls with its text in ``_corrupt``."""
    return spark.readStream.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", files_per_batch).json(folder)


def _free(name: str, taken: Sequence[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def target_store(spark: SparkSession, target: str, schema: str, key: str | None = None) -> tuple[Store, str]:
    """The store of a target with these columns, and the name of the column that marks deleted keys."""
    columns = Table(schema, ()).columns
    gone = _free("is_deleted", columns)
    return Store(spark, target, {"rows": Table(f"{schema}, {gone} boolean", (key or columns[0],), BUCKETS)}), gone


def read_current(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The rows of the newest version."""
    store, gone = target_store(spark, target, schema)
    return store.read("rows").filter(f"NOT {gone}").drop(gone)


def sync(changes: DataFrame, target: str, schema: str, key: str, order: Sequence[str], checkpoint: str, on_events: Callable[[DataFrame, int], None] | None = None, deleted: str | None = None) -> StreamingQuery:
    """Upserts a stream into the target, latest change per key by ``order``; ends when the feed is read.

    deleted: a boolean column of the feed that marks deletions; of changes equal in order a deletion wins, then the larger row.
    ``on_events`` gets each batch's snapshot events (for targets with id, name, updated and tags).
    """

    def apply(batch: DataFrame, number: int) -> None:
        store, gone = target_store(batch.sparkSession, target, schema, key)
        mark = F.lit(False) if deleted is None else F.coalesce(F.col(deleted), F.lit(False))
        columns = Table(schema, ()).columns
        good = batch.filter(F.col(key).isNotNull()).select(*columns, mark.alias(gone))
        good.persist()
        touched = store.touched("rows", good)
        before = store.read("rows", number, touched)
        store.commit(number, {"rows": (last_per_key(before.unionByName(good), key, [*order, gone]), touched)})
        good.unpersist()
        if on_events is not None:
            live = lambda df: df.filter(f"NOT {gone}").drop(gone)
            on_events(snapshot_diff(live(before), live(store.read("rows", number + 1, touched))), number)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Columns of a feed of nodes.
NODE_CHANGE = "id string, name string, parent_id string, created long, updated long, tags array<string>, fields array<struct<field:string,value:string>>, deleted boolean"


def node_store(spark: SparkSession, target: str) -> Store:
    return Store(
        spark,
        target,
        {
            "nodes": Table("id string, name string, parent_id string, created long, updated long, rank string, is_deleted boolean", ("id",), BUCKETS),
            "tags": Table("id string, tag string", ("id",), BUCKETS),
            "fields": Table("id string, field string, value string, value_order int, value_id string", ("id",), BUCKETS),
            "progress": Table("part string, at long, changes long", ("part",), 1),
        },
    )


def sync_nodes(changes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Upserts a feed of nodes (NODE_CHANGE): a change that is the latest of its node replaces the node, its tags and its attributes, in one commit.

    ``progress`` has the latest time that was applied and the number of changes; batches that change nothing leave it alone.
    """

    def apply(batch: DataFrame, number: int) -> None:
        store = node_store(batch.sparkSession, target)
        columns = Table(NODE_CHANGE, ()).columns
        good = batch.filter("id IS NOT NULL").select(*columns).withColumn("is_deleted", F.coalesce("deleted", F.lit(False)))
        # Changes of the same time are ordered by their content, so that batches do not matter.
        good = good.withColumn("rank", F.concat(F.when(F.col("is_deleted"), "1").otherwise("0"), F.md5(F.to_json(F.struct(*columns)).cast("binary"))))
        last = last_per_key(good, "id", ["updated", "rank"]).persist()
        held = store.read("nodes", number, store.touched("nodes", last)).select("id", F.struct("updated", "rank").alias("held"))
        won = last.join(held, "id", "left").filter(F.col("held").isNull() | (F.struct("updated", "rank") > F.col("held"))).drop("held").persist()
        done = won.agg(F.count("*").alias("n"), F.max("updated").alias("at")).first()
        if done.n:
            ids, live = won.select("id"), won.filter("NOT is_deleted")
            tags = live.select("id", F.explode(F.array_distinct("tags")).alias("tag"))
            fields = live.select("id", F.posexplode("fields").alias("place", "x")).select("id", "x.field", "x.value", "place")
            order = F.row_number().over(Window.partitionBy("id", "field").orderBy("place")) - 1
            fields = fields.filter("trim(coalesce(value, '')) <> ''").select("id", "field", "value", order.alias("value_order"), F.lit(None).cast("string").alias("value_id"))
            was = store.read("progress", number).first()
            progress = batch.sparkSession.createDataFrame([("feed", max(done.at or 0, was.at if was else 0), done.n + (was.changes if was else 0))], store.tables["progress"].schema)
            store.replace(number, {"nodes": (ids, won, ["id"]), "tags": (ids, tags, ["id"]), "fields": (ids, fields, ["id"]), "progress": (progress.select("part"), progress, ["part"])})
        won.unpersist()
        last.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, target: str) -> DataFrame:
    """(id, name, updated, tags) of the nodes of a target of ``sync_nodes``, as ``snapshot_diff`` compares them."""
    store = node_store(spark, target)
    tags = store.read("tags").groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    nodes = store.read("nodes").filter("NOT is_deleted").select("id", "name", "updated")
    return nodes.join(tags, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def on_new_export(spark: SparkSession, folder: str, apply: Callable[[Catalog, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``apply`` with the catalog of the newest export in ``folder`` when files arrive; of several that arrive together only the newest is read."""

    def run(batch: DataFrame, number: int) -> None:
        newest = export_json.latest_file(batch.sparkSession, folder)
        if newest is not None and not batch.isEmpty():
            apply(export_json.build(export_json.read_docs(batch.sparkSession, newest)), number)

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*@????-??-??.json").load(folder)
    return files.select("path").writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per window and key of a stream or table; rows later than ``late`` are left out of streams."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def append_events(target: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``on_events``: one JSON line per event, one folder per batch."""

    def write(events: DataFrame, number: int) -> None:
        events.write.mode("overwrite").json(f"{target}/batch={number}")

    return write
