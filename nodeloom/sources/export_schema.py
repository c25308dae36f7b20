"""What the tags and attributes of an export declare: names, attributes in order, defaults, parents, options and types.

A tag is a node of kind ``tagDef``, or one whose metanode has a tuple with ``SYS_T01``; tags in the trash, by their
chain of owners, are left out.  Its own tuples declare attributes: a named node or a known system mark, then
the default.  The type of an attribute is the first of: the type that its definition states, the type that its name
suggests unless that is text, the type that most of its first values show, text.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.text import infer_type_by_name, normalize_name
from ..operators.graph import owner_in_trash
from ..operators.schema import value_vote
from ..storage import materialize
from .export_json import TAG_DEFINITION, TAG_MARK, build, flatten

#: System attributes that tags may define: mark, name and type; marks of stated types (fixed values).
SYSTEM = {"SYS_A90": ("Date", "date"), "SYS_A61": ("Due Date", "date"), "SYS_A142": ("Attendees", "reference")}
STATED = {"SYS_D01": "checkbox", "SYS_D03": "date", "SYS_D05": "reference", "SYS_D06": "text", "SYS_D08": "number", "SYS_D10": "url", "SYS_D11": "email", "SYS_D12": "options", "SYS_D13": "reference"}
TYPE_CHOICE = ("SYS_A02", "typeChoice")


@dataclass
class Declared:
    """tags(tag_id, tag, key, description, color), parents(child_id, parent_id), fields(tag_id, tag, field, label_id, field_order, default_value),
    options(label_id, option), stated(label_id, kind), sources(field_id, tag_id)."""

    tags: DataFrame
    parents: DataFrame
    fields: DataFrame
    options: DataFrame
    stated: DataFrame
    sources: DataFrame


def _map(pairs: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[key]


def declared(docs: DataFrame) -> Declared:
    """What ``docs(id, props, children, modifiedTs)`` declare."""
    flat = flatten(docs)
    named = lambda a, b: flat.filter("name <> ''").select(F.col("id").alias(a), F.col("name").alias(b))
    down = flat.select(F.col("id").alias("above"), F.posexplode("children").alias("place", "below"))
    tuples = flat.filter("kind = 'tuple'").select(F.col("id").alias("below"), F.col("children").alias("parts"), F.col("name").alias("tuple_name"))
    # Tags: by kind, or by the tuple of their metanode.
    marked = flat.filter("kind = 'tuple'").filter(F.array_contains("children", TAG_MARK) & F.array_contains("children", TAG_DEFINITION)).select(F.col("owner").alias("meta"), "children")
    of_meta = marked.join(flat.select(F.col("id").alias("meta"), F.col("owner").alias("tag_id")), "meta").filter("tag_id IS NOT NULL").select("tag_id", "children")
    ids = flat.filter("kind = 'tagDef'").select(F.col("id").alias("tag_id")).unionByName(of_meta.select("tag_id")).distinct()
    ids = materialize(ids)
    trash = owner_in_trash(flat.select("id", "owner"), start=ids.select(F.col("tag_id").alias("id"))).select(F.col("id").alias("tag_id"))
    live = materialize(ids.join(trash, "tag_id", "left_anti"))
    # What is declared is a schema's worth of rows, which many steps read: each table is found once and written.
    tags = materialize(flat.withColumnRenamed("id", "tag_id").join(live, "tag_id", "left_semi").select("tag_id", F.col("name").alias("tag"), normalize_name(F.col("name")).alias("key"), "description", "color"))
    parents = of_meta.join(live, "tag_id", "left_semi").select(F.col("tag_id").alias("child_id"), F.explode("children").alias("parent_id")).filter("child_id <> parent_id").join(live.select(F.col("tag_id").alias("parent_id")), "parent_id", "left_semi").select("child_id", "parent_id").distinct()
    # Attributes: the tuples among a tag's children.
    own = down.join(live.select(F.col("tag_id").alias("above")), "above", "left_semi").join(tuples, "below").select(F.col("above").alias("tag_id"), "place", F.get("parts", F.lit(0)).alias("label_id"), F.get("parts", F.lit(1)).alias("default_id"))
    own = materialize(own)
    known = own.join(named("label_id", "label"), "label_id", "left").join(flat.select(F.col("id").alias("label_id"), F.lit(True).alias("is_node")), "label_id", "left")
    mark = F.when(F.col("is_node").isNull(), _map({k: v for k, (v, _) in SYSTEM.items()}, F.col("label_id")))
    known = known.withColumn("field", F.coalesce("label", mark)).filter("field IS NOT NULL").join(named("default_id", "default_value"), "default_id", "left")
    first = Window.partitionBy("tag_id", "field").orderBy(F.desc("place"))  # a name that is declared twice counts with its last tuple
    order = F.row_number().over(Window.partitionBy("tag_id").orderBy("place")) - 1
    fields = known.withColumn("field_order", order).withColumn("_r", F.row_number().over(first)).filter("_r = 1").join(tags.select("tag_id", "tag"), "tag_id")
    fields = materialize(fields.select("tag_id", "tag", "field", "label_id", "field_order", "default_value"))
    # Options: the children of an attribute's tuple "Values", and their children.
    values = down.join(tuples.filter("tuple_name = 'Values'"), "below").select(F.col("above").alias("label_id"), F.explode("parts").alias("below")).filter("NOT startswith(below, 'SYS_')")
    deeper = values.join(down.select(F.col("above").alias("below"), F.col("below").alias("lower")), "below").filter("NOT startswith(lower, 'SYS_')").select("label_id", F.col("lower").alias("below"))
    options = values.unionByName(deeper).join(named("below", "option"), "below").select("label_id", "option").distinct()
    # Types that definitions state, and tags that define system attributes.
    choice = flat.filter((F.col("source") == TYPE_CHOICE[0]) & (F.col("name") == TYPE_CHOICE[1])).select(F.col("id").alias("below"), F.get(F.filter("children", lambda c: c.startswith("SYS_D")), F.lit(0)).alias("code"))
    stated = down.join(choice, "below").groupBy(F.col("above").alias("label_id")).agg(F.min(_map(STATED, F.col("code"))).alias("kind")).filter("kind IS NOT NULL")
    sources = own.filter(F.col("label_id").isin(list(SYSTEM))).select(F.col("label_id").alias("field_id"), "tag_id").distinct()
    return Declared(tags, materialize(parents), fields, materialize(options), materialize(stated), sources)


def field_types(d: Declared, cat: Catalog) -> DataFrame:
    """(tag, field, kind, evidence): all evidence is gathered and the strongest kept, in one aggregation.

    Every value of an export is a node; it votes as a reference if it is tagged.
    """
    tagged = cat.tags.select(F.col("id").alias("value_id"), F.lit(True).alias("tagged")).distinct()
    values = cat.fields.join(tagged, "value_id", "left").withColumn("value_id", F.when(F.col("tagged"), F.col("value_id")))
    votes = value_vote(replace(cat, fields=values.select(*cat.fields.columns)))
    keys = d.fields.select("tag", "field", "label_id")
    by_name = infer_type_by_name(F.col("field"))
    row = lambda df, rank, kind, evidence: df.select("tag", "field", F.struct(F.lit(rank).alias("rank"), kind.alias("kind"), F.lit(evidence).alias("evidence")).alias("x"))
    system = keys.filter(F.col("label_id").isin(list(SYSTEM)))
    evidence = [
        row(keys.join(d.stated, "label_id"), 0, F.col("kind"), "stated"),
        row(system, 1, _map({k: v for k, (_, v) in SYSTEM.items()}, F.col("label_id")), "system"),
        row(keys.filter(by_name != "text"), 2, by_name, "name"),
        row(keys.join(votes.select("field", "kind"), "field"), 3, F.col("kind"), "values"),
        row(keys, 4, F.lit("text"), "none"),
    ]
    out = evidence[0]
    for e in evidence[1:]:
        out = out.unionByName(e)
    return out.groupBy("tag", "field").agg(F.min("x").alias("x")).select("tag", "field", "x.kind", "x.evidence")


def with_schema(docs: DataFrame) -> tuple[Catalog, Declared]:
    """The catalog of an export whose tag hierarchy and attributes are the declared ones, and the declarations.

    Attributes that nodes of a live tag have without a declaration stay, behind the declared ones.
    """
    cat, d = build(docs, keep=True), declared(docs)
    named = d.tags.select("tag_id", "tag")
    cat.tag_parents = materialize(d.parents.join(named.toDF("child_id", "child"), "child_id").join(named.toDF("parent_id", "parent"), "parent_id").select("child", "parent").distinct())
    own = d.fields.join(field_types(d, cat), ["tag", "field"]).select("tag", "field", "field_order", "kind")
    used = cat.tag_fields.join(d.tags.select("tag").distinct(), "tag", "left_semi").join(own, ["tag", "field"], "left_anti").withColumn("field_order", F.col("field_order") + 1000)
    cat.tag_fields = materialize(own.unionByName(used.select(*own.columns)))
    return cat, d


def system_fields(d: Declared) -> DataFrame:
    """(tag, field, kind) of the system attributes that tags define, as ``all_fields`` takes them."""
    name = _map({k: v for k, (v, _) in SYSTEM.items()}, F.col("field_id"))
    kind = _map({k: v for k, (_, v) in SYSTEM.items()}, F.col("field_id"))
    return d.sources.join(d.tags.select("tag_id", "tag"), "tag_id").select("tag", name.alias("field"), kind.alias("kind"))
