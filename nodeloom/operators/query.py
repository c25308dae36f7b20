"""Flat queries: find nodes by tag and predicates, hydrate attributes, order, page, project."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.text import number_prefix
from ..plans.predicates import CORE, AnyOf, Where, apply
from .schema import descendants

MOST_ROWS = 1000


def find(cat: Catalog, tag: str | None, where: Sequence[Where | AnyOf] = (), as_of: datetime | None = None) -> DataFrame:
    """Nodes with the tag (None: all) that satisfy all predicates, each once, core columns."""
    nodes = (cat.nodes if tag is None else cat.tagged(tag)).select(*CORE)
    return apply(cat, nodes, where, as_of)


def find_family(cat: Catalog, tag: str, where: Sequence[Where | AnyOf] = (), as_of: datetime | None = None) -> DataFrame:
    """Nodes with the tag or one that inherits from it."""
    family = descendants(cat).filter(F.col("tag") == tag).select(F.col("descendant").alias("tag"))
    names = family.unionByName(family.sparkSession.createDataFrame([(tag,)], "tag string")).distinct()
    ids = cat.tags.join(names, "tag", "left_semi").select("id")
    return apply(cat, cat.nodes.select(*CORE).join(ids, "id", "left_semi"), where, as_of)


def order(cat: Catalog, rows: DataFrame, by: str = "created", descending: bool = True, numeric: bool = False) -> DataFrame:
    """Sorted by a core column or by the first value of an attribute; ties by id."""
    if by not in CORE:
        first = cat.fields.filter(F.col("field") == by).groupBy("id").agg(F.min_by("value", "value_order").alias("_by"))
        rows = rows.join(first, "id", "left")
        key = number_prefix(F.col("_by")) if numeric else F.col("_by")
    else:
        key = F.col(by)
    return rows.orderBy(key.desc() if descending else key.asc(), "id").drop("_by")


def page(rows: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= MOST_ROWS or offset < 0:
        raise ValueError(f"limit is 1 to {MOST_ROWS}, offset is not negative")
    return rows.offset(offset).limit(limit) if offset else rows.limit(limit)


def has_more(rows: DataFrame, limit: int, offset: int = 0) -> bool:
    """Whether rows remain behind the page: one row beyond it is looked for."""
    return not rows.offset(offset + limit).limit(1).isEmpty()


def hydrate(cat: Catalog, rows: DataFrame, names: Sequence[str] | None = None, tag: str | None = None) -> DataFrame:
    """Adds ``fields``: map of attribute to its values, joined in their order.

    tag: a primary tag that all rows have; attributes of other nodes are not read.
    """
    values = cat.of(cat.fields, tag)
    values = values if names is None else values.filter(F.lower("field").isin([n.lower() for n in names]))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value_order", "value"))), lambda x: x["value"]), ", ")
    # An inner join stays behind the union of attributes, where a semi join would be repeated in each of its branches.
    wanted = values.join(rows.select("id").distinct(), "id").groupBy("id", "field").agg(ordered.alias("value"))
    maps = wanted.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
    return rows.join(maps, "id", "left").withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))


def project(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Core columns by name, attributes by name (exactly, else without case); what is missing is null."""
    out = []
    for n in names:
        if n in rows.columns:
            out.append(F.col(n))
        else:
            out.append(F.coalesce(F.try_element_at("fields", F.lit(n)), _any_case(n)).alias(n))
    return rows.select(*out)


def _any_case(name: str) -> Column:
    return F.get(F.map_values(F.map_filter("fields", lambda k, _: F.lower(k) == name.lower())), F.lit(0))


def batch_get(cat: Catalog, ids: DataFrame) -> DataFrame:
    """``ids(position, id)`` with their nodes, input order and repeats kept, unknown ids with a null name."""
    return ids.join(cat.nodes.select(*CORE), "id", "left").select("position", *CORE).orderBy("position")


def children(cat: Catalog, parent: str, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(cat.nodes.filter(F.col("parent_id") == parent).select(*CORE).orderBy("id"), limit, offset)


def recent(cat: Catalog, limit: int = 50) -> DataFrame:
    """Newest by update, else creation."""
    at = F.coalesce("updated", "created")
    return page(cat.nodes.select("id", "name", at.alias("at")).orderBy(F.desc("at"), "id"), limit)


def recently_updated(cat: Catalog, limit: int = 50) -> DataFrame:
    return page(cat.nodes.filter("updated IS NOT NULL").select("id", "name", "updated").orderBy(F.desc("updated"), "id"), limit)


def run(cat: Catalog, tag: str | None, where: Sequence[Where | AnyOf] = (), as_of: datetime | None = None, by: str = "created", descending: bool = True, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of found nodes; those of a tag come with all their attributes, those of no tag (None) without."""
    if tag is not None and not tag.strip():
        raise ValueError("a tag, or None for all nodes")
    rows = page(order(cat, find(cat, tag, where, as_of), by, descending), limit, offset)
    return rows if tag is None else hydrate(cat, rows, tag=tag)


def project_paths(rows: DataFrame, paths: Sequence[str]) -> DataFrame:
    """``rows`` cut to dotted paths, nested as the paths are; names in ``fields`` go without case, what is missing is null."""
    flat, nested = [], {}
    for path in paths:
        head, _, rest = path.partition(".")
        if not rest:
            flat.append(F.col(head) if head in rows.columns else F.lit(None).cast("string").alias(head))
        else:
            nested.setdefault(head, []).append(rest)
    for head, names in nested.items():
        if head == "fields":
            parts = [F.coalesce(F.try_element_at("fields", F.lit(n)), _any_case(n)).alias(n) for n in names]
        else:
            known = {f.name for f in getattr(rows.schema[head].dataType, "fields", [])} if head in rows.columns else set()
            parts = [F.col(f"{head}.{n}").alias(n) if n in known else F.lit(None).cast("string").alias(n) for n in names]
        flat.append(F.struct(*parts).alias(head))
    return rows.select(*flat)


def created_between(rows: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Created from first to last, both included."""
    rows = rows if first is None else rows.filter(F.col("created") >= first)
    return rows if last is None else rows.filter(F.col("created") <= last)


def updated_between(rows: DataFrame, after: int | None = None, before: int | None = None) -> DataFrame:
    """Updated after and before, both excluded; without an update no."""
    rows = rows.filter("updated IS NOT NULL")
    rows = rows if after is None else rows.filter(F.col("updated") > after)
    return rows if before is None else rows.filter(F.col("updated") < before)


def cell(value: Column, kind: Column) -> Column:
    """value, raw text and type of a table's cell; an empty value is null."""
    raw = F.when(value != "", value)
    return F.struct(F.when(kind == "number", number_prefix(raw).cast("string")).otherwise(raw).alias("value"), raw.alias("raw"), F.when(raw.isNotNull(), kind).alias("type"))
