"""The graph model as DataFrames, and the star-schema tables seen through it.

A ``Catalog`` holds nodes, their tags, multi-valued attributes (entity, attribute, value
rows), typed links, the tag hierarchy and the attributes that tags declare.  Every view
of ``star_catalog`` carries its tag as a literal, each attribute its name and each link its
kind and the tags at its ends, so a filter on them prunes the other branches of the union
before anything is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from dataclasses import field as dataclass_field
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNDATED_MS = 1704067200000


@dataclass
class Catalog:
    """nodes(id, name, parent_id, created, updated, tag), tags(id, tag), fields(id, field, value, value_order, value_id),
    links(source, target, kind), tag_parents(child, parent), tag_fields(tag, field, field_order, kind).

    Ids of nodes are unique.  primary: tags that exactly the nodes with this value of ``nodes.tag``
    have; finding them is a filter that prunes partitions, not a join.  ends: whether links and fields also
    have ``source_tag`` and ``target_tag``, the primary tags at their ends, and tags ``source_tag``.  targets: attribute to
    the primary tag of the nodes that it refers to, where that is known.  tag_of: the primary tag that an id tells, if ids do.
    """

    nodes: DataFrame
    tags: DataFrame
    fields: DataFrame
    links: DataFrame
    tag_parents: DataFrame
    tag_fields: DataFrame
    primary: frozenset[str] = frozenset()
    ends: bool = False
    targets: dict[str, str] = dataclass_field(default_factory=dict)
    tag_of: Callable[[Column], Column] | None = None
    #: (id, text, tag) of all nodes of the tags whose names are only the beginnings of texts.
    long_texts: DataFrame | None = None
    #: Attributes of tags with their kinds, as tables have read them.
    columns: dict[str, list[tuple[str, str]]] = dataclass_field(default_factory=dict)

    def tagged(self, tag: str) -> DataFrame:
        """Nodes with a tag."""
        if tag in self.primary:
            return self.nodes.filter(F.col("tag") == tag)
        return self.nodes.join(self.tags.filter(F.col("tag") == tag).select("id"), "id", "left_semi")

    @property
    def texts(self) -> DataFrame:
        """(id, name, tag) of all nodes with their whole texts as names."""
        if self.long_texts is None:
            return self.nodes.select("id", "name", "tag")
        whole = self.long_texts.select("id", F.col("text").alias("name"), "tag")
        held = [r.tag for r in whole.select("tag").distinct().collect()]  # a few names
        return self.nodes.filter(~F.col("tag").isin(held)).select("id", "name", "tag").unionByName(whole)

    def kinds_of(self, ids: DataFrame) -> list[str] | None:
        """The primary tags of ``ids(id)``, where ids tell them: a few names, for which ``ids`` is read once."""
        if not self.ends or self.tag_of is None:
            return None
        return sorted(r.t for r in ids.select(self.tag_of(F.col("id")).alias("t")).distinct().collect() if r.t is not None)

    def of(self, table: DataFrame, tag: str | list[str] | None, column: str = "source_tag") -> DataFrame:
        """Rows of ``fields``, ``links``, ``tags`` or ``nodes`` that begin at nodes with a primary tag: other branches are not read.  None: all."""
        tags = [tag] if isinstance(tag, str) else tag
        if tags is None or not self.ends or not set(tags) <= self.primary:
            return table
        return table.filter(F.col(column).isin(tags))


def both_ways(df: DataFrame, a: str, b: str, *rest: str) -> DataFrame:
    """Each row and its mirror image, from one scan."""
    row = lambda x, y: F.struct(F.col(x).alias(a), F.col(y).alias(b), *rest)
    return df.select(F.inline(F.array(row(a, b), row(b, a))))


def union(branches: list[DataFrame]) -> DataFrame:
    """Union by position, paired like a tree: planning stays short however many branches there are."""
    while len(branches) > 1:
        branches = [a.union(b[0]) if b else a for a, *b in (branches[i : i + 2] for i in range(0, len(branches), 2))]
    return branches[0]


def millis(c: str | Column) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def _ident(tag: str, *keys: str) -> Column:
    return F.concat(F.lit(f"{tag}:"), *[x for i, k in enumerate(keys) for x in ([F.lit(":")] if i else []) + [F.col(k).cast("string")]])


#: Upper tags and declared attributes of the star-schema view (fixed values); tags of each status and type of event, and events' attributes by the keys of their properties, come from the tables.
TAG_PARENTS = [("order", "record"), ("event", "record"), ("customer", "party"), ("supplier", "party")]
TAG_FIELDS = [("record", "Created", 0, "date"), ("order", "Status", 0, "options"), ("order", "Priority", 1, "options"), ("order", "TotalPrice", 2, "number"), ("order", "OrderDate", 3, "date"), ("order", "Part", 4, "instance"), ("party", "Balance", 0, "number"), ("customer", "Segment", 0, "options"), ("customer", "Balance", 1, "number"), ("customer", "Nation", 2, "instance"), ("supplier", "Balance", 0, "number"), ("supplier", "Nation", 1, "instance"), ("supplier", "Segment", 2, "text"), ("part", "Brand", 0, "text"), ("part", "Type", 1, "text"), ("part", "Size", 2, "number"), ("event", "User", 0, "number"), ("event", "Value", 1, "number")]
TARGETS = {"Part": "part", "Nation": "nation"}
PRIMARY = frozenset("region nation customer supplier part order event document conv line".split())


def star_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    t = cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    none, undated = F.lit(None).cast("string"), F.lit(UNDATED_MS)

    def view(df: DataFrame, tag: str, ident: Column, name: Column, parent: Column = none, created: Column = undated, updated: Column | None = None) -> DataFrame:
        return df.select(ident.alias("id"), name.alias("name"), parent.alias("parent_id"), created.alias("created"), (F.lit(None).cast("long") if updated is None else updated).alias("updated"), F.lit(tag).alias("tag"))

    orders, events, lines, talk = t("orders"), t("events"), t("lineitem"), t("conversations")
    parts = [
        view(t("region"), "region", _ident("region", "r_regionkey"), F.col("r_name")),
        view(t("nation"), "nation", _ident("nation", "n_nationkey"), F.col("n_name"), _ident("region", "n_regionkey")),
        view(t("customer"), "customer", _ident("customer", "c_custkey"), F.col("c_name"), _ident("nation", "c_nationkey")),
        view(t("supplier"), "supplier", _ident("supplier", "s_suppkey"), F.col("s_name"), _ident("nation", "s_nationkey")),
        view(t("part"), "part", _ident("part", "p_partkey"), F.col("p_name")),
        view(orders, "order", _ident("order", "o_orderkey"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), _ident("customer", "o_custkey"), millis("o_orderdate")),
        view(events, "event", _ident("event", "event_id"), F.col("event_type"), none, millis("ts"), millis("ts")),
        view(t("documents"), "document", _ident("document", "doc_id"), F.substring("text", 1, 80)),
        view(talk.select("conv_id").distinct(), "conv", _ident("conv", "conv_id"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))),
        view(talk, "line", _ident("line", "conv_id", "turn"), F.col("text"), _ident("conv", "conv_id")),
    ]
    nodes = union(parts)
    tags = nodes.select("id", "tag", F.col("tag").alias("source_tag"))
    tags = tags.unionByName(orders.select(_ident("order", "o_orderkey").alias("id"), F.concat(F.lit("order_"), "o_orderstatus").alias("tag"), F.lit("order").alias("source_tag")))
    tags = tags.unionByName(events.select(_ident("event", "event_id").alias("id"), F.concat(F.lit("event_"), "event_type").alias("tag"), F.lit("event").alias("source_tag")))

    def attributes(df: DataFrame, tag: str, ident: Column, values: dict[str, Column]) -> list[DataFrame]:
        """One branch per attribute."""

        def one(name: str, value: Column) -> DataFrame:
            target = TARGETS.get(name)
            ref = (F.lit(None) if target is None else value).cast("string")
            return df.select(ident.alias("id"), F.lit(name).alias("field"), value.cast("string").alias("value"), F.lit(0).alias("value_order"), ref.alias("value_id"), F.lit(tag).alias("source_tag"), F.lit(target).cast("string").alias("target_tag")).filter("value IS NOT NULL")

        return [one(name, value) for name, value in values.items()]

    whole = lambda c: F.floor(c).cast("long")
    order_of = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    part_id = _ident("part", "l_partkey")
    bought = lines.select(_ident("order", "l_orderkey").alias("id"), F.lit("Part").alias("field"), part_id.alias("value"), (F.row_number().over(order_of) - 1).alias("value_order"), part_id.alias("value_id"), F.lit("order").alias("source_tag"), F.lit("part").alias("target_tag"))
    branches = [
        *attributes(orders, "order", _ident("order", "o_orderkey"), {"Status": F.col("o_orderstatus"), "Priority": F.col("o_orderpriority"), "TotalPrice": whole("o_totalprice"), "OrderDate": F.date_format("o_orderdate", "yyyy-MM-dd")}),
        bought,
        *attributes(t("customer"), "customer", _ident("customer", "c_custkey"), {"Segment": F.col("c_mktsegment"), "Balance": whole("c_acctbal"), "Nation": _ident("nation", "c_nationkey")}),
        *attributes(t("supplier"), "supplier", _ident("supplier", "s_suppkey"), {"Balance": whole("s_acctbal"), "Nation": _ident("nation", "s_nationkey")}),
        *attributes(t("part"), "part", _ident("part", "p_partkey"), {"Brand": F.col("p_brand"), "Type": F.col("p_type"), "Size": F.col("p_size")}),
        *attributes(events, "event", _ident("event", "event_id"), {"User": F.col("user_id"), "Value": whole("value"), "K": F.get_json_object("props", "$.k")}),
    ]
    fields = union(branches)

    def link(df: DataFrame, a: Column, b: Column, kind: str, ends: tuple[str, str]) -> DataFrame:
        return df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("kind"), F.lit(ends[0]).alias("source_tag"), F.lit(ends[1]).alias("target_tag"))

    kin = [
        (t("nation"), _ident("region", "n_regionkey"), _ident("nation", "n_nationkey"), ("region", "nation")),
        (t("customer"), _ident("nation", "c_nationkey"), _ident("customer", "c_custkey"), ("nation", "customer")),
        (t("supplier"), _ident("nation", "s_nationkey"), _ident("supplier", "s_suppkey"), ("nation", "supplier")),
        (orders, _ident("customer", "o_custkey"), _ident("order", "o_orderkey"), ("customer", "order")),
        (talk, _ident("conv", "conv_id"), _ident("line", "conv_id", "turn"), ("conv", "line")),
    ]
    family = [x for df, up, down, ends in kin for x in (link(df, up, down, "child", ends), link(df, down, up, "parent", ends[::-1]))]
    family = [x.filter("source IS NOT NULL AND target IS NOT NULL") for x in family]
    inline = link(lines, _ident("order", "l_orderkey"), part_id, "inline_ref", ("order", "part")).distinct()
    links = union([*family, inline])
    below = lambda df, column, tag: df.select(F.concat(F.lit(f"{tag}_"), column).alias("child"), F.lit(tag).alias("parent")).distinct()
    tag_parents = union([spark.createDataFrame(TAG_PARENTS, "child string, parent string"), below(orders, "o_orderstatus", "order"), below(events, "event_type", "event")])
    keys = events.select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("k")).distinct()
    tag_fields = spark.createDataFrame(TAG_FIELDS, "tag string, field string, field_order int, kind string").union(keys.select(F.lit("event"), F.upper("k"), F.lit(2), F.lit("number")))
    return Catalog(nodes, tags, fields, links, tag_parents, tag_fields, PRIMARY, True, TARGETS, lambda c: F.substring_index(c, ":", 1), t("documents").select(_ident("document", "doc_id").alias("id"), "text", F.lit("document").alias("tag")))


def _star_sql() -> str:
    """The same views as common table expressions, for the oracle."""
    rows = lambda values: ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in values)
    ms = lambda c: f"(epoch_us({c}) // 1000)"
    f = lambda i, table, pairs: " UNION ALL ".join(f"SELECT {i}, '{k}', ({v})::varchar, 0, {ref} FROM {table} WHERE ({v}) IS NOT NULL" for k, v, ref in pairs)
    return f"""WITH RECURSIVE nodes AS (
SELECT 'region:' || r_regionkey AS id, r_name AS name, NULL::varchar AS parent_id, {UNDATED_MS}::bigint AS created, NULL::bigint AS updated, 'region' AS tag FROM region
UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'region:' || n_regionkey, {UNDATED_MS}, NULL, 'nation' FROM nation
UNION ALL SELECT 'customer:' || c_custkey, c_name, 'nation:' || c_nationkey, {UNDATED_MS}, NULL, 'customer' FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'nation:' || s_nationkey, {UNDATED_MS}, NULL, 'supplier' FROM supplier
UNION ALL SELECT 'part:' || p_partkey, p_name, NULL, {UNDATED_MS}, NULL, 'part' FROM part
UNION ALL SELECT 'order:' || o_orderkey, 'Order ' || o_orderkey, 'customer:' || o_custkey, {ms('o_orderdate')}, NULL, 'order' FROM orders
UNION ALL SELECT 'event:' || event_id, event_type, NULL, {ms('ts')}, {ms('ts')}, 'event' FROM events
UNION ALL SELECT 'document:' || doc_id, substr(text, 1, 80), NULL, {UNDATED_MS}, NULL, 'document' FROM documents
UNION ALL SELECT DISTINCT 'conv:' || conv_id, 'Conversation ' || conv_id, NULL, {UNDATED_MS}::bigint, NULL::bigint, 'conv' FROM conversations
UNION ALL SELECT 'line:' || conv_id || ':' || turn, text, 'conv:' || conv_id, {UNDATED_MS}, NULL, 'line' FROM conversations),
tags AS (SELECT id, tag FROM nodes UNION ALL SELECT 'order:' || o_orderkey, 'order_' || o_orderstatus FROM orders UNION ALL SELECT 'event:' || event_id, 'event_' || event_type FROM events),
fields(id, field, value, value_order, value_id) AS (
{f("'order:' || o_orderkey", 'orders', [('Status', 'o_orderstatus', 'NULL'), ('Priority', 'o_orderpriority', 'NULL'), ('TotalPrice', 'floor(o_totalprice)::bigint', 'NULL'), ('OrderDate', "strftime(o_orderdate, '%Y-%m-%d')", 'NULL')])}
UNION ALL SELECT 'order:' || l_orderkey, 'Part', 'part:' || l_partkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::int, 'part:' || l_partkey FROM lineitem
UNION ALL {f("'customer:' || c_custkey", 'customer', [('Segment', 'c_mktsegment', 'NULL'), ('Balance', 'floor(c_acctbal)::bigint', 'NULL'), ('Nation', "'nation:' || c_nationkey", "'nation:' || c_nationkey")])}
UNION ALL {f("'supplier:' || s_suppkey", 'supplier', [('Balance', 'floor(s_acctbal)::bigint', 'NULL'), ('Nation', "'nation:' || s_nationkey", "'nation:' || s_nationkey")])}
UNION ALL {f("'part:' || p_partkey", 'part', [('Brand', 'p_brand', 'NULL'), ('Type', 'p_type', 'NULL'), ('Size', 'p_size', 'NULL')])}
UNION ALL {f("'event:' || event_id", 'events', [('User', 'user_id', 'NULL'), ('Value', 'floor(value)::bigint', 'NULL'), ('K', "props::json ->> '$.k'", 'NULL')])}),
links AS (SELECT parent_id AS source, id AS target, 'child' AS kind FROM nodes WHERE parent_id IS NOT NULL UNION ALL SELECT id, parent_id, 'parent' FROM nodes WHERE parent_id IS NOT NULL
UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'inline_ref' FROM lineitem),
tag_parents(child, parent) AS (VALUES {rows(TAG_PARENTS)} UNION ALL SELECT DISTINCT 'order_' || o_orderstatus, 'order' FROM orders UNION ALL SELECT DISTINCT 'event_' || event_type, 'event' FROM events),
tag_fields(tag, field, field_order, kind) AS (VALUES {rows(TAG_FIELDS)} UNION ALL SELECT DISTINCT 'event', upper(k), 2, 'number' FROM (SELECT unnest(json_keys(props)) AS k FROM events))"""


STAR_SQL = _star_sql()
