"""Ingest of workspace exports: a JSON document whose ``docs`` are nodes with ordered child ids.

Structural nodes follow conventions of the export format (fixed values): a tuple node whose
children begin with the marker ``SYS_A13`` states tags; under a tag's or attribute's own
metanode the second child ``SYS_T01`` defines a tag and ``SYS_T02`` an attribute; any
other tuple is ``[attribute, value...]``, where the attribute is a node or one of SYSTEM_FIELDS.  Everything is a join
on ids or owners.  What tags and attributes declare is in ``export_schema``, transcripts are in ``export_transcripts``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.text import inline_references, value_type
from ..operators.graph import climb
from ..storage import materialize

DOC = "id string, props struct<created:bigint,name:string,_ownerId:string,_docType:string,_done:string,_sourceId:string,description:string,_color:string>, children array<string>, modifiedTs string"
_DOCS = f"array<struct<{DOC.replace(' string', ':string').replace('props struct', 'props:struct').replace('children array', 'children:array')}>>"
EXPORT = f"formatVersion bigint, docs {_DOCS}, storeData struct<docs:{_DOCS}>"
TAG_MARK, TAG_DEFINITION, FIELD_DEFINITION, MOST_VALUES = "SYS_A13", "SYS_T01", "SYS_T02", 50
#: Attributes that have a mark instead of a node (fixed values).
SYSTEM_FIELDS = {
    "SYS_A13": "Tag", "SYS_A61": "Due date", "SYS_A90": "Date", "SYS_A142": "Attendees", "SYS_T01": "Supertag", "SYS_T02": "Field", "SYS_T03": "Option value",
    "SYS_A15": "Search expression", "SYS_A144": "Search title", "SYS_A130": "Entity type", "SYS_A150": "Speaker", "SYS_A199": "Transcript",
    "SYS_A252": "Transcript speaker", "SYS_A253": "Start time", "SYS_A254": "End time", "SYS_A12": "System reference", "SYS_A16": "Default value", "SYS_A20": "Field reference",
}
#: Tuples within tuples beyond this depth are taken for a cycle.
MOST_NESTED = 1 << 16


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of one export or of a folder of exports, also wrapped in ``storeData``, with their file; unreadable files give no rows.

    A file is one JSON document and so one task; ``read_lines`` reads exports of any size.
    """
    whole = spark.read.schema(EXPORT).json(path, multiLine=True, pathGlobFilter="*.json")
    return whole.select(F.col("_metadata.file_path").alias("file"), F.inline(F.coalesce("docs", "storeData.docs")))


def read_lines(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Nodes of exports with one node a line, which Spark splits; broken lines give no rows, or end the job if ``strict``."""
    if strict:
        return spark.read.schema(DOC).json(path, mode="FAILFAST").select(F.col("_metadata.file_path").alias("file"), "*").filter("id IS NOT NULL")
    rows = spark.read.schema(f"{DOC}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), "*").filter("id IS NOT NULL").drop("_corrupt")


def confirmed(learnings: DataFrame, since: str | None = None) -> DataFrame:
    """Learnings that were confirmed, after ``since`` where it is given."""
    kept = learnings.filter("confirmed")
    return kept if since is None else kept.filter(F.col("confirmed_at") > F.lit(since).cast("timestamp"))


def latest_file(spark: SparkSession, folder: str) -> str | None:
    """The newest export by the date in its name ``*@YYYY-MM-DD.json``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*@????-??-??.json").load(folder)
    return files.agg(F.max_by("path", F.struct(F.regexp_extract("path", r"@(\d{4}-\d{2}-\d{2})\.json$", 1), "path"))).first()[0]


def latest_export(spark: SparkSession, folder: str) -> str | None:
    """Name of the newest export in a folder, file or folder of parts, by the date in its name ``*@YYYY-MM-DD.json``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
    dated = [(found[1], n) for n in names if (found := re.search(r"@(\d{4}-\d{2}-\d{2})\.json$", n))]
    return max(dated)[1] if dated else None


def live(docs: DataFrame) -> DataFrame:
    """Docs that are neither trash nor directly below it."""
    trash = F.col("id").contains("TRASH")
    below = docs.filter(trash).select(F.explode("children").alias("id")).distinct()
    return docs.filter(~trash).join(below, "id", "left_anti")


def flatten(docs: DataFrame) -> DataFrame:
    """(id, name, created, owner, kind, source, description, color, children, updated) of docs(id, props, children, modifiedTs); what an export leaves out is null."""
    known = {f.name for f in docs.schema["props"].dataType.fields}
    prop = lambda key, name: (F.col(f"props.{key}") if key in known else F.lit(None).cast("string")).alias(name)
    updated = F.regexp_extract("modifiedTs", r"(\d+)", 1).try_cast("bigint").alias("updated")
    return docs.select("id", prop("name", "name"), prop("created", "created"), prop("_ownerId", "owner"), prop("_docType", "kind"), prop("_sourceId", "source"), prop("description", "description"), prop("_color", "color"), "children", updated)


def build(docs: DataFrame, keep: bool = False) -> Catalog:
    """The catalog of an export's docs(id, props, children, modifiedTs), which are read once and written flat."""
    return build_flat(materialize(flatten(docs)), keep)


def build_flat(flat: DataFrame, keep: bool = False) -> Catalog:
    """The catalog of an export's nodes as ``flatten`` gives them; with ``keep`` tags and attributes are found once and written, for what reads them often."""
    flat = live(flat)
    child = flat.select(F.col("id").alias("parent_id"), F.posexplode("children").alias("position", "id"))
    parent = child.groupBy("id").agg(F.max_by("parent_id", F.struct("parent_id", "position")).alias("parent_id"))
    tuples = flat.filter("kind = 'tuple'").select(F.col("id").alias("tuple_id"), "owner", "children", (F.coalesce(F.col("name") == "Values", F.lit(False)) | F.coalesce(F.col("source") == "SYS_A02", F.lit(False))).alias("of_schema"))
    marked = tuples.filter(F.array_contains("children", TAG_MARK))
    owners = flat.select(F.col("id").alias("_id"), F.col("owner").alias("data_id"))
    on_data = marked.join(owners, marked.owner == owners._id).select("tuple_id", "data_id", "children")
    defined = lambda mark: on_data.filter(F.array_contains("children", mark)).select(F.col("data_id").alias("id")).distinct()
    tag_ids = defined(TAG_DEFINITION).unionByName(flat.filter("kind = 'tagDef'").select("id")).distinct()
    tag_names = flat.join(tag_ids, "id", "left_semi").select(F.col("id").alias("tag_id"), F.col("name").alias("tag"))
    applied = on_data.filter(~F.array_contains("children", TAG_DEFINITION) & ~F.array_contains("children", FIELD_DEFINITION)).select(F.col("data_id").alias("id"), F.explode("children").alias("tag_id"))
    tags = applied.join(tag_names, "tag_id").select("id", "tag").distinct()
    tags = materialize(tags) if keep else tags
    stated = on_data.filter(F.array_contains("children", TAG_DEFINITION)).select(F.col("data_id").alias("tag_id"), F.explode("children").alias("parent_tag"))
    names = lambda a, b: tag_names.select(F.col("tag_id").alias(a), F.col("tag").alias(b))
    tag_parents = stated.join(names("parent_tag", "parent"), "parent_tag").join(names("tag_id", "child"), "tag_id").select("child", "parent").filter("child <> parent").distinct()
    fields = field_values(flat, tuples)
    fields = materialize(fields) if keep else fields
    of_tag = fields.join(tags, "id").groupBy("tag", "field").agg(F.min("value_order").alias("field_order"), F.coalesce(F.mode(value_type(F.col("value")), True), F.lit("text")).alias("kind"))
    rank = F.row_number().over(Window.partitionBy("tag").orderBy("field_order", "field")) - 1
    inline = flat.select(F.col("id").alias("source"), F.explode(inline_references(F.coalesce("name", F.lit("")))).alias("target")).join(flat.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target", F.lit("inline_ref").alias("kind"))
    down = child.select(F.col("parent_id").alias("source"), F.col("id").alias("target"), F.lit("child").alias("kind")).join(flat.select(F.col("id").alias("target")), "target", "left_semi")
    up = down.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("parent").alias("kind"))
    nodes = flat.join(parent, "id", "left").select("id", "name", "parent_id", "created", "updated", F.coalesce("kind", F.lit("node")).alias("tag"))
    links = inline.unionByName(down.select("source", "target", "kind")).unionByName(up).distinct()
    return Catalog(nodes, tags, fields, links, tag_parents, of_tag.select("tag", "field", rank.alias("field_order"), "kind"))


def field_values(flat: DataFrame, tuples: DataFrame) -> DataFrame:
    """(id, field, value, value_order, value_id) of the tuples ``[attribute, value...]``; tuples below tuples, at any depth, belong to the node above all.

    Tuples that list an attribute's options or state its type hold no values.
    """
    plain = tuples.filter(~F.col("of_schema") & ~F.array_contains("children", TAG_MARK) & F.size("children").between(2, MOST_VALUES))
    placed = plain.join(tuple_owner(tuples), "tuple_id").select("tuple_id", "id", "children")
    label = flat.select(F.col("id").alias("label_id"), F.col("name").alias("label"))
    system = F.create_map(*[F.lit(x) for pair in SYSTEM_FIELDS.items() for x in pair])
    named = placed.withColumn("label_id", F.get("children", F.lit(0))).join(label, "label_id", "left").withColumn("field", F.coalesce("label", system[F.col("label_id")]))
    each = named.filter("field IS NOT NULL").select("id", "tuple_id", "field", F.posexplode(F.slice("children", 2, MOST_VALUES)).alias("position", "value_id"))
    value = flat.select(F.col("id").alias("value_id"), F.col("name").alias("value"))
    order = F.row_number().over(Window.partitionBy("id", "field").orderBy("tuple_id", "position")) - 1
    kept = each.join(value, "value_id").filter("trim(coalesce(value, '')) <> ''")
    return kept.select("id", "field", "value", order.alias("value_order"), "value_id")


def tuple_owner(tuples: DataFrame) -> DataFrame:
    """(tuple_id, id): the nearest owner of each of ``tuples(tuple_id, owner)`` that is no tuple itself."""
    outer = tuples.select(F.col("tuple_id").alias("owner"), F.lit(False).alias("hit")).distinct()
    up = tuples.select(F.col("tuple_id").alias("id"), "owner").join(outer, "owner", "left")
    found = climb(up.select("id", F.col("owner").alias("parent_id"), F.coalesce("hit", F.lit(True)).alias("hit")), MOST_NESTED)
    return found.select(F.col("id").alias("tuple_id"), F.col("ancestor").alias("id"))


def nested_text(flat: DataFrame, ids: DataFrame, depth: int = 2) -> DataFrame:
    """(id, text) of ``ids(id)``: a node's name and below it the names of its children, in order, line by line to ``depth`` levels; nodes without any are left out.

    ``flat(id, name, children)``.  First the nodes below are found, level by level, then the texts are joined from the lowest level up.
    """
    down = flat.select(F.col("id").alias("above"), F.posexplode("children").alias("place", "id"))
    levels = [ids.select("id").distinct()]
    for _ in range(depth):
        levels.append(materialize(down.join(levels[-1].select(F.col("id").alias("above")), "above", "left_semi").select("id").distinct()))
    names = flat.select("id", F.when(F.col("name") != "", F.col("name")).alias("name"))
    text = names.join(levels[-1], "id", "left_semi").select("id", F.col("name").alias("text"))
    for level in reversed(levels[:-1]):
        each = down.join(level.select(F.col("id").alias("above")), "above", "left_semi").join(text.filter("text <> ''"), "id")
        parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
        below = each.groupBy(F.col("above").alias("id")).agg(F.array_join(parts, "\n").alias("below"))
        text = materialize(names.join(level, "id", "left_semi").join(below, "id", "left").select("id", F.concat_ws("\n", "name", "below").alias("text")))
    return text.filter("text <> ''")


_ITEM = "array<struct<id:string,content:string,source:string,extractedAt:string,confirmedAt:string,confirmed:boolean,tags:array<string>>>"
_SEED = f"learned struct<patterns:{_ITEM},insights:{_ITEM},selfKnowledge:{_ITEM}>"


def _learnings(learned: DataFrame) -> DataFrame:
    parts = [learned.select(F.lit(c).alias("category"), F.inline(f"learned.{c}")) for c in ("patterns", "insights", "selfKnowledge")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.select("category", "id", "content", "confirmed", F.col("confirmedAt").try_cast("timestamp").alias("confirmed_at"), "tags")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(category, id, content, confirmed, confirmed_at, tags) of a seed file's three lists of learnings."""
    return _learnings(spark.read.schema(_SEED).json(path, multiLine=True))


def read_seed_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of files with one seed a line, which Spark splits."""
    return _learnings(spark.read.schema(_SEED).json(path))
