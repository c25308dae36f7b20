"""The tag hierarchy, declared attributes and audits of both."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.text import normalize_name, value_type
from ..storage import materialize, spread

MOST_LEVELS = 10


def ancestors(cat: Catalog, most: int = MOST_LEVELS) -> DataFrame:
    """(tag, ancestor, depth): the least number of steps, over multiple inheritance; cycles end at the cap."""
    edges = materialize(cat.tag_parents.select("child", "parent").distinct())
    found = edges.select(F.col("child").alias("tag"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    level, up = found, edges.toDF("_child", "_parent")
    for depth in range(2, most + 1):
        level = level.join(up, F.col("ancestor") == F.col("_child")).select("tag", F.col("_parent").alias("ancestor"), F.lit(depth).alias("depth")).distinct()
        level = materialize(level.join(found, ["tag", "ancestor"], "left_anti").filter("tag <> ancestor"))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found.groupBy("tag", "ancestor").agg(F.min("depth").alias("depth"))


def descendants(cat: Catalog, most: int = MOST_LEVELS) -> DataFrame:
    return ancestors(cat, most).select(F.col("ancestor").alias("tag"), F.col("tag").alias("descendant"), "depth")


def deepest(cat: Catalog) -> DataFrame:
    return ancestors(cat, 20).agg(F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_depth"))


def all_fields(cat: Catalog, system: DataFrame | None = None) -> DataFrame:
    """(tag, field, origin, depth, field_order, kind): own attributes, then inherited, the nearest declaration of each name, then system attributes.

    system: ``(tag, field, kind)`` of the system attributes that tags define, which are inherited too; depth and order 999.
    """
    own = cat.tag_fields.select("tag", "field", F.col("tag").alias("origin"), F.lit(0).alias("depth"), "field_order", "kind")
    up = ancestors(cat).select("tag", F.col("ancestor").alias("origin"), "depth")
    inherited = up.join(cat.tag_fields.withColumnRenamed("tag", "origin"), "origin").select("tag", "field", "origin", "depth", "field_order", "kind")
    every = own.unionByName(inherited)
    if system is not None:
        last = lambda df: df.select("tag", "field", "origin", F.lit(999).alias("depth"), F.lit(999).alias("field_order"), "kind")
        defined = system.select("tag", F.col("tag").alias("origin"), "field", "kind")
        every = every.unionByName(last(defined)).unionByName(last(up.join(defined.drop("tag"), "origin")))
    rank = F.row_number().over(Window.partitionBy("tag", "field").orderBy("depth", "field_order", "origin"))
    return every.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def uses(cat: Catalog) -> DataFrame:
    """(tag, uses): distinct nodes of each tag in use."""
    return cat.tags.groupBy("tag").agg(F.count_distinct("id").alias("uses"))


def written(cat: Catalog) -> Catalog:
    """The catalog with its hierarchy and declared attributes as tables, so that whoever finds them in nodes does it once."""
    return replace(cat, tag_parents=materialize(cat.tag_parents), tag_fields=materialize(cat.tag_fields))


def tag_graph(cat: Catalog, used: DataFrame | None = None) -> DataFrame:
    """Per tag: declared attributes, uses, parents and children.  used: ``uses`` of a catalog that is ``written``, else both are made here."""
    if used is None:
        cat, used = written(cat), uses(cat)
    known = cat.tag_parents.select("child").union(cat.tag_parents.select("parent")).union(cat.tag_fields.select("tag")).distinct()
    known = used.select("tag", "uses").union(known.select("child", F.lit(0).cast("long")))
    every = known.groupBy("tag").agg(F.max(F.when(F.col("tag").isNotNull(), F.col("uses")).otherwise(0)).alias("uses"))
    counts = (
        (cat.tag_fields.groupBy("tag").agg(F.count("*").alias("fields")), "fields"),
        (cat.tag_parents.groupBy(F.col("child").alias("tag")).agg(F.count("*").alias("parents")), "parents"),
        (cat.tag_parents.groupBy(F.col("parent").alias("tag")).agg(F.count("*").alias("children")), "children"),
    )
    for table, _ in counts:
        every = every.join(table, "tag", "left")
    return every.fillna(0, [n for _, n in counts]).select("tag", "fields", "uses", "parents", "children")


def value_vote(cat: Catalog, sample: int = 10) -> DataFrame:
    """(field, kind, votes): the type that most of an attribute's first values show (by id and order), ties by name; values without one do not vote."""
    rank = F.row_number().over(Window.partitionBy("field").orderBy("id", "value_order"))
    kind = value_type(F.col("value"), F.col("value_id").isNotNull())
    votes = cat.fields.withColumn("_r", rank).filter(F.col("_r") <= sample).groupBy("field", kind.alias("kind")).agg(F.count("*").alias("votes")).filter("kind IS NOT NULL")
    best = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("votes"), "kind"))
    return votes.withColumn("_b", best).filter("_b = 1").drop("_b")


def orphan_tags(cat: Catalog, graph: DataFrame | None = None) -> DataFrame:
    """Declared tags that no node has.  graph: the catalog's ``tag_graph``, where it is at hand."""
    return (tag_graph(cat) if graph is None else graph).filter("uses = 0").select("tag")


def rarely_used(cat: Catalog, least: int = 3, graph: DataFrame | None = None) -> DataFrame:
    return (tag_graph(cat) if graph is None else graph).filter(F.col("uses").between(1, least - 1)).select("tag", "uses")


def related(cat: Catalog) -> DataFrame:
    """Pairs of tags of which one descends from the other, both ways."""
    up = ancestors(cat).select(F.col("tag").alias("a"), F.col("ancestor").alias("b"))
    return up.unionByName(up.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _pairs(cat: Catalog) -> DataFrame:
    """Unrelated tags a < b that declare the same attribute name."""
    named = cat.tag_fields.withColumn("key", normalize_name(F.col("field")))
    a = named.select("key", F.col("tag").alias("a"), F.col("kind").alias("kind_a"))
    b = named.select("key", F.col("tag").alias("b"), F.col("kind").alias("kind_b"))
    return a.join(b, "key").filter("a < b").join(related(cat), ["a", "b"], "left_anti")


def duplicate_fields(cat: Catalog, pairs: DataFrame | None = None) -> DataFrame:
    return (_pairs(cat) if pairs is None else pairs).select("a", "b", "key").distinct()


def type_mismatches(cat: Catalog) -> DataFrame:
    """Attributes that tags declare with different types."""
    kinds = cat.tag_fields.groupBy(normalize_name(F.col("field")).alias("key")).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count_distinct("kind").alias("n"))
    return kinds.filter("n > 1").select("key", "kinds")


#: Attributes that one number has a bit for.
BITS = 63


def fill_rates(cat: Catalog, used: DataFrame | None = None) -> DataFrame:
    """(tag, field, filled, instances, rate): share of a tag's nodes with a non-empty value, in percent.

    The declared attributes of a node are gathered as bits before they meet its tags, so that nodes are joined and not values.
    used: ``uses`` of a catalog that is ``written``, else both are made here.
    """
    if used is None:
        cat, used = written(cat), uses(cat)
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("field")) - 1  # a schema's worth of rows
    places = cat.tag_fields.select("field").distinct().select("field", at.alias("_at")).selectExpr("field", f"_at div {BITS} AS word", f"shiftleft(1L, _at % {BITS}) AS bit")
    values = cat.fields.filter("value <> ''").join(F.broadcast(places), "field").select("id", "word", "bit")
    held = spread(values, "id").groupBy("id", "word").agg(F.bit_or("bit").alias("bits"))
    tags = cat.tags.select("id", "tag").join(F.broadcast(cat.tag_fields.select("tag").distinct()), "tag", "left_semi")
    sets = held.join(spread(tags.select("id", "tag"), "id").distinct(), "id").groupBy("tag", "word", "bits").agg(F.count("*").alias("n"))
    filled = sets.join(F.broadcast(places), "word").filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).groupBy("tag", "field").agg(F.sum("n").alias("filled"))
    instances = used.select("tag", F.col("uses").alias("instances"))
    out = cat.tag_fields.select("tag", "field").join(instances, "tag").join(filled, ["tag", "field"], "left").fillna(0, ["filled"])
    return out.select("tag", "field", "filled", "instances", F.round(100 * F.col("filled") / F.col("instances"), 6).alias("rate"))


def unused_fields(cat: Catalog, rates: DataFrame | None = None) -> DataFrame:
    return (fill_rates(cat) if rates is None else rates).filter("filled = 0").select("tag", "field")


def low_fill(cat: Catalog, least: float = 10.0, rates: DataFrame | None = None) -> DataFrame:
    return (fill_rates(cat) if rates is None else rates).filter((F.col("filled") > 0) & (F.col("rate") < least)).select("tag", "field", "rate")


def missing_inheritance(cat: Catalog, shared: int = 3, pairs: DataFrame | None = None) -> DataFrame:
    """Unrelated tags that share several attributes: candidates for a common parent."""
    return (_pairs(cat) if pairs is None else pairs).groupBy("a", "b").agg(F.count_distinct("key").alias("shared")).filter(F.col("shared") >= shared)


def audit(cat: Catalog) -> DataFrame:
    """(detector, subject, detail) of all seven detectors.  What several of them need is written once: uses, the graph of tags, pairs and rates."""
    cat = written(cat)
    used = materialize(uses(cat))
    graph, pairs, rates = (materialize(x) for x in (tag_graph(cat, used), _pairs(cat), fill_rates(cat, used)))
    row = lambda name, df, subject, detail: df.select(F.lit(name).alias("detector"), subject.alias("subject"), detail.cast("string").alias("detail"))
    c, dot = F.col, lambda a, b: F.concat(a, F.lit("."), b)
    parts = [
        row("orphan", orphan_tags(cat, graph), c("tag"), F.lit("")), row("low_usage", rarely_used(cat, graph=graph), c("tag"), c("uses")),
        row("duplicate_field", duplicate_fields(cat, pairs), dot(c("a"), c("b")), c("key")), row("type_mismatch", type_mismatches(cat), c("key"), c("kinds")),
        row("unused_field", unused_fields(cat, rates), dot(c("tag"), c("field")), F.lit("")), row("low_fill", low_fill(cat, rates=rates), dot(c("tag"), c("field")), F.lit("")),
        row("missing_inheritance", missing_inheritance(cat, pairs=pairs), dot(c("a"), c("b")), c("shared")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def paths_up(cat: Catalog, most: int = MOST_LEVELS) -> DataFrame:
    """(tag, path): each way from a tag to a root of the hierarchy, as ``tag > parent > ... > root``."""
    edges = materialize(cat.tag_parents.select("child", "parent").distinct())
    roots = edges.select(F.col("parent").alias("at")).join(edges.select(F.col("child").alias("at")), "at", "left_anti").distinct()
    level = edges.select(F.col("child").alias("tag"), F.col("parent").alias("at"), F.array("child", "parent").alias("path"))
    found = None
    for _ in range(most):
        level = materialize(level)
        done = level.join(roots, "at", "left_semi").select("tag", F.array_join("path", " > ").alias("path"))
        found = done if found is None else found.unionByName(done)
        on = level.join(edges, F.col("at") == F.col("child")).filter(~F.array_contains("path", F.col("parent")))
        level = on.select("tag", F.col("parent").alias("at"), F.array_append("path", F.col("parent")).alias("path"))
        if level.isEmpty():
            break
    return found


def family(cat: Catalog, tag: str) -> DataFrame:
    """(tag): the tag, all that inherit from it, and the direct parents of these."""
    down = descendants(cat).filter(F.col("tag") == tag).select(F.col("descendant").alias("tag"))
    down = down.unionByName(down.sparkSession.createDataFrame([(tag,)], "tag string"))
    up = cat.tag_parents.join(down.select(F.col("tag").alias("child")), "child", "left_semi").select(F.col("parent").alias("tag"))
    return down.unionByName(up).distinct()


def below(cat: Catalog, tag: str) -> DataFrame:
    """(tag, depth, fields): the tag and what inherits from it, with their own attributes in order."""
    down = descendants(cat).filter(F.col("tag") == tag).select(F.col("descendant").alias("tag"), "depth")
    down = down.unionByName(down.sparkSession.createDataFrame([(tag, 0)], "tag string, depth int"))
    own = cat.tag_fields.groupBy("tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field_order", "field"))), lambda x: x["field"]), ",").alias("fields"))
    return down.join(own, "tag", "left").select("tag", "depth", F.coalesce("fields", F.lit("")).alias("fields"))


def topological(cat: Catalog, most: int = MOST_LEVELS) -> DataFrame:
    """(position, tag, level): parents before children; level is the longest way to a root, ties by name, cycles last."""
    edges = materialize(cat.tag_parents.select("child", "parent").distinct())
    every = materialize(tag_graph(cat).select("tag"))
    level = every.join(edges.select(F.col("child").alias("tag")), "tag", "left_anti").select("tag", F.lit(0).alias("level"))
    found = level
    for d in range(1, most + 1):
        level = materialize(level.select(F.col("tag").alias("parent")).join(edges, "parent").select(F.col("child").alias("tag"), F.lit(d).alias("level")).distinct())
        if level.isEmpty():
            break
        found = found.unionByName(level)
    placed = every.join(found.groupBy("tag").agg(F.max("level").alias("level")), "tag", "left").fillna(most + 1, ["level"])
    order = Window.partitionBy(F.lit(0)).orderBy("level", "tag")  # tags are a schema's worth of rows
    return placed.select((F.row_number().over(order) - 1).alias("position"), "tag", "level")


def merged_fields(cat: Catalog, tags: list[str]) -> DataFrame:
    """(field, tag, kind): the attributes of several tags, of each name the first by the tags' order."""
    place = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(place, "field_order"))
    return cat.tag_fields.filter(F.col("tag").isin(tags)).withColumn("_r", rank).filter("_r = 1").select("field", "tag", "kind")


def lookup(cat: Catalog, names: DataFrame) -> DataFrame:
    """(name, tag): of the tags with a ``names(tag, name)`` the one with most parents, then most attributes, then by name."""
    sized = names.join(tag_graph(cat), "tag")
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("parents"), F.desc("fields"), "tag"))
    return sized.withColumn("_r", rank).filter("_r = 1").select("name", "tag")


def search_tags(cat: Catalog, text: str) -> DataFrame:
    """Tags whose name, or normalised name, contains the text."""
    every, key = tag_graph(cat).select("tag"), normalize_name(F.lit(text))
    return every.filter(F.lower("tag").contains(text.lower()) | ((key != "") & normalize_name(F.col("tag")).contains(key)))


def check_fields(cat: Catalog, pairs: DataFrame) -> DataFrame:
    """``pairs(tag, field)`` with ``valid`` and the tag that declares the attribute."""
    return pairs.join(all_fields(cat).select("tag", "field", "origin"), ["tag", "field"], "left").select("tag", "field", F.col("origin").isNotNull().alias("valid"), "origin")


def resolve_values(cat: Catalog, asked: DataFrame) -> DataFrame:
    """(query, id, rule) of ``asked(query, field, target)``, the first that hits of:

    1 a node of the target tag by name, 2 by normalised name, 3 an option (a value in use) of the attribute by text,
    4 by normalised text, 5 any node by name, 6 by normalised name; ties by id.  Options have their text as id.
    """
    key = lambda c: normalize_name(F.col(c))
    a = asked.withColumn("key", key("query"))
    nodes = cat.nodes.filter("name IS NOT NULL").select("id", F.col("tag").alias("_tag"), F.col("name").alias("_name"), key("name").alias("key"))
    hits = a.join(nodes, "key").withColumn("same", F.col("query") == F.col("_name"))
    rule = F.when(F.col("_tag") == F.col("target"), F.when(F.col("same"), 1).otherwise(2)).otherwise(F.when(F.col("same"), 5).otherwise(6))
    options = cat.fields.join(asked.select("field").distinct(), "field", "left_semi").select(F.col("field").alias("_field"), F.col("value").alias("id")).distinct().withColumn("key", key("id"))
    option = a.join(options, (a.key == options.key) & (a.field == options._field)).select("query", "id", F.when(F.col("query") == F.col("id"), 3).otherwise(4).alias("rule"))
    every = hits.filter("key <> ''").select("query", "id", rule.alias("rule")).unionByName(option)
    return every.groupBy("query").agg(F.min(F.struct("rule", "id")).alias("x")).select("query", "x.id", "x.rule")


#: Severity of each detector's findings.
SEVERITY = {"orphan": "info", "low_usage": "info", "duplicate_field": "warning", "type_mismatch": "error", "unused_field": "info", "low_fill": "warning", "missing_inheritance": "warning"}


def severities(findings: DataFrame) -> DataFrame:
    """One row: findings by severity."""
    level = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])[F.col("detector")]
    return findings.agg(F.count("*").alias("findings"), *[F.count_if(level == s).alias(s) for s in ("error", "warning", "info")])
