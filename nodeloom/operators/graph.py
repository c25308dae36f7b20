"""Traversal, connections between found sets, and ancestors of nodes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog, both_ways
from ..functions.text import NODE_SPAN, inline_dates, number_prefix, strip_html
from ..storage import materialize


def edges(cat: Catalog, kinds: Sequence[str] = ("inline_ref", "child", "parent", "field"), between: tuple[str, str] | None = None) -> DataFrame:
    """(source, target, kind): links, and attribute values that reference nodes.

    between: primary tags at the ends, either way round; with a catalog that knows them, other edges are not read.
    """
    links, values = cat.links.filter(F.col("kind").isin(list(kinds))), cat.fields.filter("value_id IS NOT NULL")
    if between is not None and cat.ends:
        a, b = between
        these = ((F.col("source_tag") == a) & (F.col("target_tag") == b)) | ((F.col("source_tag") == b) & (F.col("target_tag") == a))
        links, values = links.filter(these), values.filter(these)
    out = links.select("source", "target", "kind")
    if "field" in kinds:
        out = out.unionByName(values.select(F.col("id").alias("source"), F.col("value_id").alias("target"), F.lit("field").alias("kind")))
    return out


def _steps(cat: Catalog, level: DataFrame, direction: str, kinds: Sequence[str]) -> DataFrame:
    """(origin, to, path, kind, direction) one step on from ``level(origin, id, path)``; only edges at its nodes' tags are read."""
    tags, out = cat.kinds_of(level), []
    for name, a, b in (("out", "source", "target"), ("in", "target", "source")):
        if direction not in (name, "both"):
            continue
        links = cat.of(cat.links, tags, f"{a}_tag").filter(F.col("kind").isin(list(kinds))).select(F.col(a).alias("at"), F.col(b).alias("to"), "kind")
        if "field" in kinds:
            ends = {"source": "id", "target": "value_id"}
            values = cat.of(cat.fields, tags, f"{a}_tag").filter("value_id IS NOT NULL")
            links = links.unionByName(values.select(F.col(ends[a]).alias("at"), F.col(ends[b]).alias("to"), F.lit("field").alias("kind")))
        out.append(level.select("origin", "id", "path").join(links, F.col("id") == F.col("at")).select("origin", "to", "path", "kind", F.lit(name).alias("direction")))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def traverse(cat: Catalog, start: DataFrame, direction: str = "both", kinds: Sequence[str] = ("inline_ref", "child", "parent", "field"), depth: int = 1, limit: int | None = None) -> DataFrame:
    """(origin, id, kind, direction, distance, path) of the nodes within ``depth`` steps of each ``start(id)``.

    Breadth first; of several ways to a node on its first level the smallest path is kept, so
    one row per node goes on, however many ways lead there.  Unknown targets are left out.
    limit: nodes per origin, nearest first and then by path; what lies beyond is not gone through.
    Each level is written, joined with the edges at it and, once per node, with the nodes that exist.
    """
    if depth < 1:
        raise ValueError("depth is at least 1")
    if limit is not None and limit < 1:
        raise ValueError("limit is at least 1")
    none = F.lit(None).cast("string")
    seen = materialize(start.select(F.col("id").alias("origin"), "id", none.alias("kind"), none.alias("direction"), F.lit(0).alias("distance"), F.col("id").alias("path")).distinct())
    level = seen
    for distance in range(1, depth + 1):
        first = F.min(F.struct(F.concat("path", F.lit(" > "), "to").alias("path"), "kind", "direction")).alias("best")
        new = _steps(cat, level, direction, kinds).groupBy("origin", "to").agg(first)
        new = new.select("origin", F.col("to").alias("id"), "best.kind", "best.direction", F.lit(distance).alias("distance"), "best.path")
        new = materialize(new.join(seen.select("origin", "id"), ["origin", "id"], "left_anti"))
        known = cat.of(cat.nodes, cat.kinds_of(new), "tag").select("id")
        level = new.join(known, "id", "left_semi").select(*seen.columns)
        if limit is not None:
            had = seen.groupBy("origin").agg((F.count("*") - 1).alias("_had"))
            rank = F.row_number().over(Window.partitionBy("origin").orderBy("path"))
            level = level.withColumn("_r", rank).filter(F.col("_r") <= limit).join(had, "origin").filter(F.col("_r") + F.col("_had") <= limit).select(*seen.columns)
        if distance < depth:
            level = materialize(level)
        seen = seen.unionByName(level)
    return seen.filter("distance > 0")


def reference_graph(cat: Catalog, start: DataFrame) -> DataFrame:
    """One step in both directions over links, with the other node's name (null if unknown)."""
    ids, names = start.select("id").distinct(), cat.nodes.select(F.col("id").alias("other"), "name")
    out = cat.links.join(ids, F.col("source") == F.col("id"), "left_semi").select(F.col("source").alias("id"), F.col("target").alias("other"), "kind", F.lit("out").alias("direction"))
    back = cat.links.join(ids, F.col("target") == F.col("id"), "left_semi").select(F.col("target").alias("id"), F.col("source").alias("other"), "kind", F.lit("in").alias("direction"))
    return out.unionByName(back).join(names, "other", "left").select("id", "other", "name", "kind", "direction")


def connect(cat: Catalog, left: DataFrame, right: DataFrame, via: str | None = None, between: tuple[str, str] | None = None) -> DataFrame:
    """(id, other): nodes of ``left(id)`` and ``right(id)`` joined by a link either way, or by the attribute ``via`` only.

    between: the primary tags of both sides, which spares reading other edges.
    """
    if via is None:
        e = edges(cat, between=between).select("source", "target")
    else:
        e = cat.fields.filter((F.col("field") == via) & F.col("value_id").isNotNull()).select(F.col("id").alias("source"), F.col("value_id").alias("target"))
    both = both_ways(e, "source", "target").distinct()
    pairs = both.join(left.select(F.col("id").alias("source")).distinct(), "source", "left_semi")
    return pairs.join(right.select(F.col("id").alias("target")).distinct(), "target", "left_semi").select(F.col("source").alias("id"), F.col("target").alias("other"))


def chain(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, other) over two hops: the middle node's pairs are joined, origins are carried along."""
    middle = second.select(F.col("id").alias("_via"), F.col("other").alias("_far"))
    return first.join(middle, F.col("other") == F.col("_via")).select("id", F.col("_far").alias("other")).distinct()


def collect_connected(cat: Catalog, pairs: DataFrame) -> DataFrame:
    """(id, names): the connected nodes' names in order."""
    names = cat.nodes.select(F.col("id").alias("other"), "name")
    return pairs.join(names, "other").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("names"))


def connected_measures(cat: Catalog, pairs: DataFrame, field: str) -> DataFrame:
    """One row: connected nodes, and sum and mean of their attribute's numbers."""
    others = pairs.select(F.col("other").alias("id")).distinct()
    numbers = cat.fields.filter(F.col("field") == field).select("id", number_prefix(F.col("value")).alias("x"))
    return others.join(numbers, "id", "left").agg(F.count_distinct("id").alias("n"), F.sum("x").alias("total"), F.round(F.avg("x"), 6).alias("mean"))


def climb(up: DataFrame, most: int) -> DataFrame:
    """(id, ancestor, depth): the first ancestor of each node that is a hit, at most ``most`` steps above.

    ``up(id, parent_id, hit)``: hit says whether the parent is one.  Pointers double: a round joins each node that is still open with
    the node that it points at and takes over its pointer or its find, so the rounds are the logarithm of the
    depth.  Ways that end without a hit, at an unknown node or in a cycle, give no row.
    """
    hit = F.coalesce("hit", F.lit(False))
    columns = ("id", "at", "ancestor", "depth")
    last = materialize(up.filter("parent_id IS NOT NULL").select("id", F.when(~hit, F.col("parent_id")).alias("at"), F.when(hit, F.col("parent_id")).alias("ancestor"), F.lit(1).alias("depth")))
    settled, reach = [], 1  # what is settled stays in the files of its round; only open nodes are written again
    while True:
        settled.append(last.filter("ancestor IS NOT NULL"))
        done, still = reduce(DataFrame.unionByName, settled), last.filter("at IS NOT NULL")
        if reach >= most or still.isEmpty():
            return done.filter(F.col("depth") <= most).select("id", "ancestor", "depth")
        far = done.unionByName(still).toDF(*[f"_{c}" for c in columns])
        went = still.join(far, F.col("at") == F.col("_id")).select("id", F.col("_at").alias("at"), F.col("_ancestor").alias("ancestor"), (F.col("depth") + F.col("_depth")).alias("depth"))
        last, reach = materialize(went), 2 * reach


def _above(cat: Catalog, hits: DataFrame) -> DataFrame:
    """What ``climb`` needs for all nodes below others, of ``hits(parent_id)``."""
    return cat.nodes.filter("parent_id IS NOT NULL").select("id", "parent_id").join(hits.withColumn("hit", F.lit(True)), "parent_id", "left").select("id", "parent_id", "hit")


def nearest_ancestor(cat: Catalog, start: DataFrame, tags: Sequence[str], most: int = 20) -> DataFrame:
    """(id, ancestor, depth) of the nearest node up the parents with one of the tags; the node itself counts."""
    hits = cat.tags.filter(F.col("tag").isin(list(tags))).select("id").distinct()
    ids = start.select("id").distinct()
    own = ids.join(hits, "id", "left_semi").select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    above = climb(_above(cat, hits.select(F.col("id").alias("parent_id"))), most).join(ids.join(hits, "id", "left_anti"), "id", "left_semi")
    return own.unionByName(above)


def in_trash(cat: Catalog, start: DataFrame, most: int = 50, mark: str = "TRASH") -> DataFrame:
    """(id) of the nodes with an ancestor, or an own id, whose id contains the trash's mark."""
    up = cat.nodes.filter("parent_id IS NOT NULL").select("id", "parent_id", F.col("parent_id").contains(mark).alias("hit"))
    ids = start.select("id").distinct()
    return ids.filter(F.col("id").contains(mark)).unionByName(climb(up, most).select("id").join(ids.filter(~F.col("id").contains(mark)), "id", "left_semi"))


def owner_in_trash(docs: DataFrame, most: int = 20, mark: str = "TRASH", start: DataFrame | None = None) -> DataFrame:
    """(id) of ``docs(id, owner)`` with an owner, an owner's owner and so on whose id contains the mark, at most ``most`` owners above.

    start: ``(id)`` of the few that are asked for; then only their own owners are followed, step by step.
    """
    up = docs.select("id", F.col("owner").alias("parent_id"), F.col("owner").contains(mark).alias("hit"))
    if start is None:
        return climb(up, most).select("id")
    owners = up.filter("parent_id IS NOT NULL").select(F.col("id").alias("at"), "parent_id", "hit")
    open_, found = start.select("id", F.col("id").alias("at")), []
    for _ in range(most):
        step = materialize(owners.join(open_, "at").select("id", F.col("parent_id").alias("at"), "hit").distinct())
        found.append(step.filter("hit").select("id"))
        open_ = step.filter("NOT hit").select("id", "at")
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).distinct()


def below_trash(docs: DataFrame, most: int = 50, ending: str = "_TRASH") -> DataFrame:
    """(id) of ``docs(id, parent_id, owner)`` of which the node, or one of its parents, has an owner whose id ends with ``ending``."""
    owned = docs.filter(F.col("owner").endswith(ending)).select("id").distinct()
    up = docs.select("id", "parent_id").join(owned.select(F.col("id").alias("parent_id"), F.lit(True).alias("hit")), "parent_id", "left")
    return owned.unionByName(climb(up.join(owned, "id", "left_anti"), most).select("id"))


def nearest_named(cat: Catalog, start: DataFrame, most: int = 20) -> DataFrame:
    """(id, ancestor, depth) of the nearest node above with a name that is not blank; the node itself does not count."""
    named = cat.nodes.filter(F.trim(F.coalesce("name", F.lit(""))) != "").select(F.col("id").alias("parent_id"))
    return climb(_above(cat, named), most).join(start.select("id").distinct(), "id", "left_semi")


def name_paths(cat: Catalog, start: DataFrame, most: int = 50) -> DataFrame:
    """(id, path): the names from the root down to each node, joined by `` > ``; nodes in a cycle, or deeper than ``most``, have none.

    Pointers double as in ``climb``; a node's pointer comes with the names from below it down to the node.
    """
    state = cat.nodes.select("id", F.col("parent_id").alias("at"), F.coalesce("name", F.lit("(unnamed)")).alias("path"), F.lit(1).alias("n"))
    ids, reach = start.select("id").distinct(), 1
    while True:
        state = materialize(state)
        if reach > most or state.filter("at IS NOT NULL").isEmpty():
            return state.filter(F.col("at").isNull() & (F.col("n") <= most + 1)).join(ids, "id", "left_semi").select("id", "path")
        far = state.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("path").alias("_path"), F.col("n").alias("_n"))
        went = state.filter("at IS NOT NULL").join(far, "at").select("id", F.col("_at").alias("at"), F.concat("_path", F.lit(" > "), "path").alias("path"), (F.col("n") + F.col("_n")).alias("n"))
        state, reach = state.filter("at IS NULL").unionByName(went), 2 * reach


def connected_values(cat: Catalog, pairs: DataFrame, field: str, name: str) -> DataFrame:
    """(id, name): per node the attribute's values of the nodes connected with it, in order."""
    values = cat.fields.filter(F.col("field") == field).select(F.col("id").alias("other"), "value")
    return pairs.join(values, "other").groupBy("id").agg(F.array_sort(F.collect_list("value")).alias(name))


def resolve_inline(rows: DataFrame, names: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, text) with inline references replaced: nodes by their ``names(id, name)``, unknown ones by nothing, dates by their text; then plain text."""
    mark = "\x01"
    cut = rows.select(ident, inline_dates(F.col(text)).alias("_t"))
    cut = cut.withColumn("_ids", F.regexp_extract_all("_t", F.lit(NODE_SPAN), F.lit(1))).withColumn("_parts", F.split(F.regexp_replace("_t", NODE_SPAN, mark), mark, -1))
    each = cut.select(ident, "_parts", F.posexplode_outer("_ids").alias("_i", "_ref"))
    known = each.join(names.select(F.col("id").alias("_ref"), "name"), "_ref", "left")
    found = known.groupBy(ident).agg(F.first("_parts").alias("_parts"), F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("_i", F.lit(-1)).alias("i"), F.coalesce("name", F.lit("")).alias("n")))), lambda x: x["n"]).alias("_names"))
    joined = F.array_join(F.transform("_parts", lambda p, i: F.concat(p, F.coalesce(F.when(i < F.size("_parts") - 1, F.get("_names", i)), F.lit("")))), "")
    return found.select(ident, F.trim(strip_html(joined)).alias(text))
