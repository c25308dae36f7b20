"""Sinks: delimited text, JSON, ids and text renderings of the tag hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..operators.schema import tag_graph
from ..storage import materialize

FORMATS = ("tsv", "csv", "json", "jsonl", "ids", "minimal")


def write(df: DataFrame, path: str, kind: str, header: bool = True) -> None:
    """Writes rows in a format; nulls become empty in delimited text."""
    if kind == "tsv":
        df.write.csv(path, sep="\t", header=header, emptyValue="", nullValue="")
    elif kind == "csv":
        df.write.csv(path, header=header, escape='"', emptyValue="", nullValue="")
    elif kind == "json":
        json_array(df).write.text(path)
    elif kind == "jsonl":
        df.write.json(path)
    elif kind == "ids":
        df.select(F.col("id").cast("string")).write.text(path)
    elif kind == "minimal":
        df.select(*[c for c in ("id", "name", "tags") if c in df.columns]).write.json(path)
    else:
        raise ValueError(f"{kind!r} is none of {FORMATS}")


def json_array(df: DataFrame) -> DataFrame:
    """Lines of one JSON array, which the files hold one after another in the order of their names; rows keep their order."""
    rows = materialize(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).withColumn("at", F.monotonically_increasing_id()))
    first = rows.agg(F.min("at")).first()[0]
    comma = F.when(F.col("at") == (-1 if first is None else first), "").otherwise(",")
    edge = lambda text: df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1)
    return edge("[").unionByName(rows.orderBy("at").select(F.concat(comma, "value").alias("value"))).unionByName(edge("]"))


def graph_json(cat: Catalog) -> DataFrame:
    """One row: the tag hierarchy as JSON, nodes by name with their number of attributes, links in order; a schema's worth of rows."""
    tags = tag_graph(cat).select("tag", "fields", "uses")
    nodes = tags.agg(F.array_sort(F.collect_list(F.struct(F.col("tag").alias("id"), "fields", "uses"))).alias("nodes"))
    links = cat.tag_parents.distinct().agg(F.array_sort(F.collect_list(F.struct(F.col("child").alias("source"), F.col("parent").alias("target")))).alias("links"))
    return nodes.join(F.broadcast(links)).select(F.to_json(F.struct("nodes", "links")).alias("line"))  # one row each


def schema_lines(cat: Catalog) -> DataFrame:
    """(tag, line): each tag with its attributes in order as JSON, the cache that tools read instead of the catalog."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("field_order", "field", "kind"))), lambda x: F.struct(x["field"].alias("field"), x["kind"].alias("kind")))
    rows = cat.tag_fields.groupBy("tag").agg(entries.alias("fields"))
    return rows.select("tag", F.to_json(F.struct("tag", "fields")).alias("line"))


def save_schema(cat: Catalog, path: str) -> None:
    schema_lines(cat).select("line").write.mode("overwrite").text(path)


def mermaid(cat: Catalog) -> DataFrame:
    """The tag hierarchy as lines of a Mermaid graph, in order."""
    edges = cat.tag_parents.select(F.concat(F.lit("  "), "child", F.lit(" --> "), "parent").alias("line")).distinct()
    return edges.select(F.lit(1).alias("part"), "line").unionByName(edges.sparkSession.createDataFrame([(0, "graph BT")], "part int, line string")).orderBy("part", "line").select("line")


def dot(cat: Catalog) -> DataFrame:
    """The tag hierarchy as lines of a DOT graph, in order."""
    edges = cat.tag_parents.select(F.concat(F.lit('  "'), "child", F.lit('" -> "'), "parent", F.lit('";')).alias("line")).distinct()
    frame = edges.sparkSession.createDataFrame([(0, "digraph tags {"), (2, "}")], "part int, line string")
    return edges.select(F.lit(1).alias("part"), "line").unionByName(frame).orderBy("part", "line").select("line")
