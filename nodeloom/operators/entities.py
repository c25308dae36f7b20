"""Which nodes are entities: an explicit override decides, else flags, a stash owner or a tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import climb


def is_entity(override: Column, flags: Column, owner: Column, tagged: Column) -> Column:
    """override: true or false decides; without one odd flags, an owner named ``..._STASH`` or a tag make an entity."""
    auto = (F.coalesce(flags, F.lit(0)) % 2 == 1) | F.coalesce(owner.endswith("_STASH"), F.lit(False)) | F.coalesce(tagged, F.lit(False))
    return F.coalesce(override, auto)


def nearest_entity(nodes: DataFrame, start: DataFrame, most: int = 50) -> DataFrame:
    """(id, ancestor, depth): nearest entity up the parents of ``nodes(id, parent_id, entity)``, not the node itself."""
    hits = nodes.filter("entity").select(F.col("id").alias("parent_id"), F.lit(True).alias("hit"))
    up = nodes.select("id", "parent_id").join(hits, "parent_id", "left")
    return climb(up, most).join(start.select("id").distinct(), "id", "left_semi")


def entity_counts(nodes: DataFrame) -> DataFrame:
    """One row over ``nodes(id, override, flags, owner, tagged)``: live nodes, overridden, automatic, tagged and all entities, in one pass."""
    live = ~F.coalesce(F.col("owner").contains("TRASH"), F.lit(False))
    auto = F.col("override").isNull() & (F.coalesce(F.col("flags"), F.lit(0)) % 2 == 1)
    return nodes.filter(live).agg(
        F.count("*").alias("live"), F.count_if(F.coalesce("override", F.lit(False))).alias("overridden"), F.count_if(auto).alias("automatic"),
        F.count_if(F.coalesce("tagged", F.lit(False))).alias("tagged"), F.count_if(is_entity(F.col("override"), F.col("flags"), F.col("owner"), F.col("tagged"))).alias("entities"),
    )
