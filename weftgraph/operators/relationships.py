"""Lookup of relationships and the figures of their entities. as_of is always given, never the current time."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.codec import encode_relationship

NEWEST = (F.desc, "created_at"), (F.asc, "related_id"), (F.asc, "rel_type"), (F.asc, "source")


def newest_first() -> list[Column]:
    """The order of an entity's relationships; ties by related id, type and source."""
    return [f(c) for f, c in NEWEST]


def is_active(as_of: int) -> Column:
    return (F.col("expires_at") == 0) | (F.col("expires_at") > as_of)


def of_entity(rels: DataFrame, entity: str) -> DataFrame:
    return rels.where(F.col("entity_id") == entity).orderBy(*newest_first())


def related_pairs(rels: DataFrame, entity: str) -> DataFrame:
    """(related_id, rel_type) of an entity."""
    return rels.where(F.col("entity_id") == entity).select("related_id", "rel_type")


def active(rels: DataFrame, as_of: int) -> DataFrame:
    return rels.where(is_active(as_of))


def by_type(rels: DataFrame, rel_type: str) -> DataFrame:
    """Of one type, expired ones included."""
    return rels.where(F.col("rel_type") == rel_type)


def without_expired(rels: DataFrame, now: int) -> DataFrame:
    return rels.where(~((F.col("expires_at") > 0) & (F.col("expires_at") <= now)))


def store(rels: DataFrame, new: DataFrame) -> DataFrame:
    """Appends; nothing is deduplicated."""
    return rels.unionByName(new)


def needs_compaction(rels: DataFrame, now: int) -> DataFrame:
    """(entity_id, n, expired, needs): more than 1000 relationships, or more expired than half of them."""
    expired = F.count_if((F.col("expires_at") > 0) & (F.col("expires_at") <= now))
    return rels.groupBy("entity_id").agg(F.count("*").alias("n"), expired.alias("expired")).withColumn("needs", F.expr("n > 1000 or expired > n div 2"))


def row_sizes(rels: DataFrame) -> DataFrame:
    """(entity_id, size_bytes) of an entity's encoded relationships."""
    return rels.groupBy("entity_id").agg((F.octet_length("entity_id") + 8 + F.sum(F.octet_length(encode_relationship()) + 1)).cast("long").alias("size_bytes"))


def wide_rows(rels: DataFrame) -> DataFrame:
    """(entity_id, n, encoded): each entity's relationships as encoded lines, newest first."""
    line = F.struct((-F.col("created_at")).alias("age"), "related_id", "rel_type", "source", encode_relationship().alias("line"))
    return rels.groupBy("entity_id").agg(F.array_sort(F.collect_list(line)).alias("lines")).select("entity_id", F.size("lines").alias("n"), F.array_join(F.col("lines.line"), ";").alias("encoded"))


def stats(rels: DataFrame, as_of: int) -> DataFrame:
    """One row of real figures: total, active, entities, inferred, average confidence."""
    return rels.agg(
        F.count("*").alias("total"), F.count_if(is_active(as_of)).alias("active"), F.count_distinct("entity_id").alias("entities"),
        F.count_if(F.col("inference_type") != "EXPLICIT").alias("inferred"), F.round(F.avg("confidence"), 6).alias("avg_confidence"),
    )


def upsert_nodes(nodes: DataFrame, seq: str = "seq") -> DataFrame:
    """The last write of each node_id."""
    rest = [c for c in nodes.columns if c != "node_id"]
    return nodes.groupBy("node_id").agg(F.max_by(F.struct(*rest), seq).alias("n")).select("node_id", "n.*")
