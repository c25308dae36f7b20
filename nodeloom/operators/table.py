"""Tables of a tag: one column per declared attribute, references resolved to names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from .schema import all_fields


def columns_of(cat: Catalog, tag: str) -> list[tuple[str, str]]:
    """Attributes of a tag and its ancestors with their kinds; a few rows of schema, read to the driver once per catalog."""
    if tag not in cat.columns:
        rows = all_fields(cat).filter(F.col("tag") == tag).orderBy("depth", "field_order", "field").collect()
        cat.columns[tag] = [(r.field, r.kind) for r in rows]
    return cat.columns[tag]


def resolve_references(cat: Catalog, values: DataFrame, tags: Sequence[str] | None = None) -> DataFrame:
    """Replaces ``value`` by the referenced node's name where ``kind`` is a reference; unknown ids become ``[deleted:id]``.

    tags: the primary tags that references go to, where known; other nodes' names are not read.
    """
    nodes = cat.nodes if tags is None else cat.nodes.filter(F.col("tag").isin(tags))
    names = nodes.select(F.col("id").alias("_ref"), F.col("name").alias("_name"))
    is_ref = (F.col("kind") == "instance") & F.col("value").rlike("^[A-Za-z0-9_:-]{5,}$")
    joined = values.withColumn("_key", F.when(is_ref, F.col("value"))).join(names, F.col("_key") == F.col("_ref"), "left")
    shown = F.when(is_ref, F.coalesce("_name", F.concat(F.lit("[deleted:"), "value", F.lit("]")))).otherwise(F.col("value"))
    return joined.withColumn("value", shown).drop("_key", "_ref", "_name")


def export_table(cat: Catalog, tag: str, rows: DataFrame, only: Sequence[str] | None = None, resolve: bool = True) -> DataFrame:
    """id, name and a column per attribute; several values are joined by ``, `` in their order."""
    columns = [(f, k) for f, k in columns_of(cat, tag) if only is None or f.lower() in {o.lower() for o in only}]
    names = [f for f, _ in columns]
    kinds = F.create_map(*[F.lit(x) for f, k in columns for x in (f, k)])
    values = cat.of(cat.fields, tag).filter(F.col("field").isin(names)).join(rows.select("id").distinct(), "id").withColumn("kind", kinds[F.col("field")])
    if resolve:
        refs = [f for f, k in columns if k == "instance"]
        known = all(f in cat.targets for f in refs)
        values = resolve_references(cat, values, sorted({cat.targets[f] for f in refs}) if known else None) if refs else values
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value_order", "value"))), lambda x: x["value"]), ", ")
    wide = values.groupBy("id").pivot("field", names).agg(ordered)
    return rows.select("id", "name").join(wide, "id", "left").select("id", "name", *[F.when(F.col(f"`{n}`") != "", F.col(f"`{n}`")).alias(n) for n in names])


def where_value(table: DataFrame, field: str, value: str) -> DataFrame:
    """Rows with a cell, or one of its values, that equals the text without case."""
    return table.filter(F.exists(F.split(F.lower(F.col(f"`{field}`")), ", "), lambda x: x == value.lower()))


def sort_page(table: DataFrame, by: str = "name", descending: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """Sorted by a column's text in binary order, ties by id."""
    key = F.col(f"`{by}`")
    return table.orderBy(key.desc() if descending else key.asc(), "id").offset(offset).limit(limit)


def markdown(table: DataFrame, most: int = 5) -> DataFrame:
    """One Markdown line per row; long lists are cut with their count, empty cells show a dash."""

    def cell(name: str):
        parts = F.split(F.col(f"`{name}`").cast("string"), ", ")
        cut = F.when(F.size(parts) > most, F.concat(F.array_join(F.slice(parts, 1, most), ", "), F.lit("...+"), (F.size(parts) - most).cast("string"), F.lit(" more"))).otherwise(F.array_join(parts, ", "))
        return F.coalesce(F.when(cut != "", cut), F.lit("-"))

    return table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in table.columns]), F.lit(" |")).alias("line"))


def padded(table: DataFrame) -> DataFrame:
    """(part, line): a header (part 0) and a line per row (part 1), columns padded to their widest cell; two passes, one row of widths."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-"))
    widths = table.agg(*[F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(text(c))), F.lit(0))).alias(f"_w{i}") for i, c in enumerate(table.columns)])
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *[F.expr(f"rpad(_c{i}, _w{i}, ' ')") for i in range(len(cells))]), F.lit(" |")).alias("line")
    rows = table.select(*[text(c).alias(f"_c{i}") for i, c in enumerate(table.columns)]).join(F.broadcast(widths)).select(F.lit(1).alias("part"), line(table.columns))
    head = widths.select(*[F.lit(c).alias(f"_c{i}") for i, c in enumerate(table.columns)], "*").select(F.lit(0).alias("part"), line(table.columns))
    return head.unionByName(rows)
