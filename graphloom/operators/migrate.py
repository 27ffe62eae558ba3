"""Migration of entity ids to slug(name)-type."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import slug
from .store import merged_mentions
from .traverse import checkpointed

PASSES = 10


def proposals(entities: DataFrame, only_names: bool = True) -> DataFrame:
    """(old, new) of entities whose id differs from slug(name)-type; only those that are slug(name), unless told otherwise."""
    new = F.concat(slug(F.col("name")), F.lit("-"), F.col("type"))
    own = entities.where(F.col("id") != new)
    return (own.where(F.col("id") == slug(F.col("name"))) if only_names else own).select(F.col("id").alias("old"), new.alias("new"))


def remapped(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relations with mapped ends; those that become equal are one."""
    s, d = mapping.select(F.col("old").alias("s"), F.col("new").alias("ns")), mapping.select(F.col("old").alias("d"), F.col("new").alias("nd"))
    moved = relations.join(s, F.col("src") == F.col("s"), "left").join(d, F.col("dst") == F.col("d"), "left")
    rest = [c for c in relations.columns if c not in ("src", "dst", "type")]
    out = moved.select(F.coalesce("ns", "src").alias("src"), F.coalesce("nd", "dst").alias("dst"), "type", *rest)
    if not rest:
        return out.distinct().select(*relations.columns)
    return out.groupBy("src", "dst", "type").agg(*(F.min(c).alias(c) for c in rest)).select(*relations.columns)


def migrate(entities: DataFrame, relations: DataFrame, mentions: DataFrame, only_names: bool = True, passes: int = PASSES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """(entities, relations, mentions, permanent collisions (old, new), number migrated).

    In a pass, of several entities that want one id the least old id gets it,
    and one whose target exists waits; passes end when none moves.
    """
    moved, collisions = 0, None
    for _ in range(passes):
        wanted = proposals(entities, only_names)
        free = wanted.join(entities.select(F.col("id").alias("new")), "new", "left_anti")
        mapping = checkpointed(free.groupBy("new").agg(F.min("old").alias("old")).select("old", "new"))
        n = mapping.count()
        collisions = wanted.join(mapping, ["old", "new"], "left_anti")
        if not n:
            break
        moved += n
        entities = checkpointed(entities.join(mapping, F.col("id") == F.col("old"), "left").withColumn("id", F.coalesce("new", "id")).drop("old", "new"))
        relations = checkpointed(remapped(relations, mapping))
        renamed = mentions.join(mapping, F.col("entity_id") == F.col("old"), "left").withColumn("entity_id", F.coalesce("new", "entity_id")).drop("old", "new")
        mentions = checkpointed(merged_mentions(renamed.limit(0), renamed))
    entities = entities.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).withColumn("canonical_name", F.coalesce("canonical_name", "name"))
    return entities, relations, mentions, collisions, moved
