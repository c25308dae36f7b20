"""A catalog as Parquet tables, partitioned by what queries filter on."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..catalog import Catalog

PARTITIONS = {"nodes": "tag", "tags": "tag", "fields": "field", "links": "kind", "tag_parents": None, "tag_fields": None}


def save_catalog(cat: Catalog, path: str) -> None:
    """Writes all tables; a filter on tag, attribute or kind then reads only its partition."""
    for name, column in PARTITIONS.items():
        table = getattr(cat, name)
        if column:
            table.write.mode("overwrite").partitionBy(column).parquet(f"{path}/{name}")
        else:
            table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_catalog(spark: SparkSession, path: str, primary: frozenset[str] = frozenset()) -> Catalog:
    return Catalog(*[spark.read.parquet(f"{path}/{name}") for name in PARTITIONS], primary)
