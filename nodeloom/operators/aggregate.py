"""Grouped aggregation over found nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.dates import bucket
from ..functions.text import number_prefix
from ..storage import spread

PERIODS = ("hour", "day", "week", "week_iso", "month", "quarter", "year")


def group_key(cat: Catalog, rows: DataFrame, by: str, name: str) -> DataFrame:
    """Adds the key: a period of ``created``, or the attribute's values (one row each; none: ``(none)``)."""
    if by in PERIODS:
        return rows.withColumn(name, bucket(F.col("created"), by))
    # Dealt over all tasks of a shuffle: joined into as few as there are cores, the sorts and the distinct pairs of one task grew with the table.
    values = spread(cat.fields.filter(F.col("field") == by).select("id", F.col("value").alias(name)), "id")
    return rows.join(values, "id", "left").withColumn(name, F.coalesce(name, F.lit("(none)")))


def count_by(cat: Catalog, rows: DataFrame, by: Sequence[str], percent: bool = False, top: int | None = None) -> DataFrame:
    """(g0[, g1], n[, percent]): distinct nodes per group; percentages are of all found nodes."""
    names = [f"g{i}" for i in range(len(by))]
    keyed = rows.select("id", "created")
    for b, n in zip(by, names, strict=True):
        keyed = group_key(cat, keyed, b, n)
    out = keyed.groupBy(*names).agg(F.count_distinct("id").alias("n"))
    if percent:
        total = rows.agg(F.count_distinct("id").alias("total"))  # one row
        out = out.join(F.broadcast(total)).select(*names, "n", F.floor(F.col("n") * 100 / F.col("total") + 0.5).cast("long").alias("percent"))
    return out.orderBy(F.desc("n"), *names).limit(top) if top else out


def measures(cat: Catalog, rows: DataFrame, by: str, field: str) -> DataFrame:
    """(g0, n, total, mean, least, most) of an attribute's numbers."""
    numbers = cat.fields.filter(F.col("field") == field).select("id", number_prefix(F.col("value")).alias("x"))
    keyed = group_key(cat, rows.select("id", "created"), by, "g0").join(numbers, "id")
    return keyed.groupBy("g0").agg(F.count("x").alias("n"), F.sum("x").alias("total"), F.round(F.avg("x"), 6).alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"))


def tag_counts(cat: Catalog) -> DataFrame:
    return cat.tags.groupBy("tag").agg(F.count_distinct("id").alias("n"))


def field_counts(cat: Catalog) -> DataFrame:
    return cat.fields.groupBy("field").agg(F.count("*").alias("n"))


def statistics(cat: Catalog) -> DataFrame:
    """One row: nodes, distinct tags, attribute rows and distinct attributes."""
    one = cat.nodes.agg(F.count("*").alias("nodes"))
    two = cat.tags.agg(F.count_distinct("tag").alias("tags"))
    three = cat.fields.agg(F.count("*").alias("field_rows"), F.count_distinct("field").alias("fields"))
    return one.join(F.broadcast(two)).join(F.broadcast(three))  # one row each


def timeline(cat: Catalog, rows: DataFrame, period: str, start: int, end: int) -> DataFrame:
    """(bucket, n) of named nodes created from start to end (milliseconds)."""
    kept = rows.filter(F.col("created").between(start, end) & (F.trim(F.coalesce("name", F.lit(""))) != ""))
    return kept.groupBy(bucket(F.col("created"), period).alias("bucket")).agg(F.count("*").alias("n"))


def newest_per_bucket(rows: DataFrame, period: str, n: int) -> DataFrame:
    """The newest n rows of each bucket."""
    keyed = rows.select("id", "name", "created", bucket(F.col("created"), period).alias("bucket"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("created"), "id"))
    return keyed.withColumn("rank", rank).filter(F.col("rank") <= n)
