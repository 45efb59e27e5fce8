"""The entity index: which entity is in which row, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = ["record_type", "batch_id", "row_number"]


def unpivot(rows: DataFrame, kinds: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each non-empty entity: kinds maps an entity type to its column; ``keep`` names columns that stay."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("entity_type"), F.col(c).alias("entity_value")) for k, c in kinds.items()])).alias("e")
    return rows.select(*keep, *ROW, "seen_at", pairs).select(*keep, *ROW, "seen_at", "e.*").where("entity_value <> ''")


def entity_activity(entities: DataFrame, like: str = "", limit: int = 100) -> DataFrame:
    """Rows, families and span of each entity, the busiest first."""
    own = entities.where(F.col("entity_value").ilike(f"%{like}%")) if like else entities
    return (
        own.groupBy("entity_type", "entity_value")
        .agg(F.count("*").alias("total"), F.count_distinct("record_type").alias("families"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.array_sort(F.collect_set("record_type")).alias("record_types"))
        .orderBy(F.desc("total"), "entity_type", "entity_value").limit(limit)
    )


def first_seen_last_seen(entities: DataFrame, limit: int = 100) -> DataFrame:
    return (
        entities.groupBy("entity_type", "entity_value").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count("*").alias("total"))
        .orderBy(F.col("last_seen").desc_nulls_last(), "entity_type", "entity_value").limit(limit)
    )


def relationship_network(entities: DataFrame, target: str, limit: int = 20) -> DataFrame:
    """Entities in the same rows as those that match the target, by number of shared rows.

    The matching side is a semi join on distinct rows, so a row counts once however often it matches.
    """
    hit = F.col("entity_value").ilike(target)
    hits = entities.where(hit).select(*ROW).distinct()
    return (
        entities.where(~hit).join(hits, ROW, "left_semi").groupBy("entity_type", "entity_value")
        .agg(F.count("*").alias("shared_rows"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.array_sort(F.collect_set("record_type")).alias("record_types"), F.array_sort(F.collect_set("batch_id")).alias("batches"))
        .orderBy(F.desc("shared_rows"), "entity_type", "entity_value").limit(limit)
    )
