"""Contents of nodes: attributes, tags and children, to a depth; contexts around seeds within a budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..storage import materialize
from .graph import traverse
from .search import relevance, within_budget

#: Kinds of calendar nodes, which are shown one level deeper (fixed values).
CALENDAR_KINDS = ("journal", "journalPart")


def meaningful(value: Column) -> Column:
    """Not a bare id: dates and bracketed references count, other runs of 12 or more id characters do not."""
    return value.rlike(r"^\d{4}-\d{2}-\d{2}") | value.startswith("[[") | ~value.rlike("^[a-zA-Z0-9_-]{12,}$")


def node_contents(cat: Catalog, rows: DataFrame, tag: str | None = None) -> DataFrame:
    """``rows(id, name)`` with ``fields`` (array of field and value, by name), ``tags`` and ``children`` (ids in order).

    tag: a primary tag that all rows have; attributes, tags and links of other nodes are not read.
    """
    ids = rows.select("id").distinct()
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value_order", "value"))), lambda x: x["value"]), ", ")
    values = cat.of(cat.fields, tag).join(ids, "id").filter(meaningful(F.col("value"))).groupBy("id", "field").agg(joined.alias("value"))
    fields = values.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("field", "value"))).alias("fields"))
    tags = cat.of(cat.tags, tag).join(ids, "id").groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    if tag is not None and cat.ends and tag in cat.primary:
        below = cat.of(cat.links, tag).filter("kind = 'child'").select(F.col("source").alias("parent_id"), F.col("target").alias("child"))
    else:
        below = cat.nodes.select(F.col("parent_id"), F.col("id").alias("child"))
    below = below.join(ids.select(F.col("id").alias("parent_id")), "parent_id")
    children = below.groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list("child")).alias("children"))
    out = rows.select("id", F.coalesce("name", F.lit("(unnamed)")).alias("name"))
    for table in (fields, tags, children):
        out = out.join(table, "id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"fields": F.coalesce("fields", F.array().cast("array<struct<field:string,value:string>>")), "tags": F.coalesce("tags", none), "children": F.coalesce("children", none)})


def expand(cat: Catalog, roots: DataFrame, depth: int) -> DataFrame:
    """(root, id, parent_id, depth) of each ``roots(id)`` and the nodes below it, level by level."""
    below = cat.nodes.select(F.col("id").alias("_child"), F.col("parent_id").alias("_at"))
    level = roots.select(F.col("id").alias("root"), "id", F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"))
    out = level
    for d in range(1, depth + 1):
        level = level.join(below, F.col("id") == F.col("_at")).select("root", F.col("_child").alias("id"), F.col("_at").alias("parent_id"), F.lit(d).alias("depth"))
        out = out.unionByName(level)
    return out


def smart_depth(kind: Column, given: Column | None = None, calendar: Sequence[str] = CALENDAR_KINDS) -> Column:
    """The depth asked for, else 2 for calendar nodes and 1 for others."""
    usual = F.when(kind.isin(list(calendar)), 2).otherwise(1)
    return usual if given is None else F.coalesce(given, usual)


def boost(score: Column, tags: Column, wanted: Sequence[str]) -> Column:
    """A tenth more for a node with one of the lens's tags, 1 at most."""
    return F.when(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in wanted])), F.least(F.lit(1.0), score + 0.1)).otherwise(score)


def context(cat: Catalog, seeds: DataFrame, as_of_ms: int, budget: int, depth: int = 1, kinds: Sequence[str] = ("inline_ref", "child", "parent", "field"), wanted: Sequence[str] = ()) -> DataFrame:
    """(id, distance, score, tokens) of the nodes around ``seeds(id)`` that fit the budget, best first and greedily.

    A node reached from several seeds counts from the nearest.
    """
    near = materialize(traverse(cat, seeds, "both", kinds, depth).groupBy("id").agg(F.min("distance").alias("distance")))
    of = cat.kinds_of(near)
    tags = cat.of(cat.tags, of).join(near, "id", "left_semi").groupBy("id").agg(F.collect_set("tag").alias("tags"))
    rows = near.join(cat.of(cat.nodes, of, "tag").select("id", "name", "created"), "id")
    rows = rows.join(tags, "id", "left") if wanted else rows
    age = (F.lit(as_of_ms) - F.col("created")) / 86_400_000
    score = F.round(relevance(F.col("distance"), F.lit(None).cast("double"), age), 6)
    rows = rows.select("id", "distance", F.round(boost(score, F.col("tags"), wanted), 6).alias("score") if wanted else score.alias("score"), F.ceil(F.length(F.coalesce("name", F.lit(""))) / 4).alias("tokens"))
    rows = materialize(rows)
    taken = within_budget(rows.withColumn("all", F.lit(0)), budget, "all")
    return rows.join(taken.select("id", "position"), "id").select("position", "id", "distance", "score", "tokens")


def ranked(counts: DataFrame, by: str, name: str) -> DataFrame:
    """Adds ``rank`` (from 1) by falling ``by``, ties by name; counts of names are few."""
    # One partition: counts of names are a schema's worth of rows.
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(by), name)))
