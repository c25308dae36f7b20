"""Attachments: addresses in nodes' names, with their files and the tags of the node and of its parent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import url_extension, url_file
from ..sources.export_json import build

ADDRESS = r"""https?://[^\s"'<>)]+"""


def scan(nodes: DataFrame, tags: DataFrame, wanted: Sequence[str] | None = None, extensions: Sequence[str] | None = None, address: str = ADDRESS) -> DataFrame:
    """(id, url, file, extension, tags) of ``nodes(id, name, parent_id)`` whose name holds an address; ``tags(id, tag)``."""
    found = nodes.select("id", "parent_id", F.regexp_extract("name", address, 0).alias("url")).filter("url <> ''")
    of = tags.groupBy("id").agg(F.collect_set("tag").alias("t"))
    above = of.select(F.col("id").alias("parent_id"), F.col("t").alias("above"))
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_union(F.coalesce("t", none), F.coalesce("above", none)))
    out = found.join(of, "id", "left").join(above, "parent_id", "left").select("id", "url", url_file(F.col("url")).alias("file"), url_extension(F.col("url")).alias("extension"), both.alias("tags"))
    if wanted is not None:
        out = out.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in wanted])))
    return out if extensions is None else out.filter(F.col("extension").isin([e.lower() for e in extensions]))


def by(found: DataFrame, key: Column, name: str) -> DataFrame:
    """Attachments per key (extension, host, a tag)."""
    return found.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def scan_export(docs: DataFrame, wanted: Sequence[str] | None = None, extensions: Sequence[str] | None = None) -> DataFrame:
    """``scan`` of an export's nodes (id, props, children, modifiedTs) and the tags that it applies to them."""
    cat = build(docs)
    return scan(cat.nodes, cat.tags, wanted, extensions)


def by_tag(found: DataFrame) -> DataFrame:
    """(tag, n): attachments of nodes with a tag, or below one."""
    return found.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
