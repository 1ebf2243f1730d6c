"""Compaction of relationship sets: expiry, dedup, merge and frequency filter; policies that say which entities need it."""

from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.config import CompactionConfig
from weftgraph.functions.codec import encode_relationship
from weftgraph.operators.relationships import without_expired


def dedup(rels: DataFrame) -> DataFrame:
    """The newest relationship of each entity, related entity and type; of equally new ones that of the least source.

    An aggregate, so that repeated relationships go where they are read, before the shuffle.
    """
    keys = ("entity_id", "related_id", "rel_type")
    rest = F.struct(*(c for c in rels.columns if c not in keys))
    newest = F.min_by(rest, F.struct(F.col("created_at").isNull(), -F.col("created_at"), F.col("source")))
    return rels.groupBy(*keys).agg(newest.alias("r")).select(*keys, "r.*").select(*rels.columns)


def merge(rels: DataFrame) -> DataFrame:
    """One relationship for each entity and related entity, folded from the newest on.

    Confidence and creation are the largest, frequencies add up, attributes of later ones win, the rest is the first's.
    Sources are told as "merged:" once for each merge, then all of them by comma: a row holds the sources of all that it
    was merged from, so its size grows with them; after dedup(), that is one for each type.
    """
    kept = ("rel_type", "inference_type", "expires_at", "source", "confidence", "created_at", "frequency")
    entries = F.map_entries("attributes").alias("attributes")
    each = F.collect_list(F.struct((-F.col("created_at")).alias("age"), "rel_type", "source", entries, F.struct(*kept).alias("r")))
    g = rels.groupBy("entity_id", "related_id").agg(F.array_sort(each).alias("all"), F.max("confidence").alias("confidence"), F.max("created_at").alias("created_at"), F.sum("frequency").alias("frequency"))
    sources, first, n = F.array_join(F.transform("all", lambda x: x["source"]), ","), F.col("all")[0]["r"], F.size("all")
    # The last entry of a key wins: sorted by key and place, the one before another key.
    flat = F.flatten(F.transform("all", lambda x: F.coalesce(x["attributes"], F.array().cast("array<struct<key:string,value:string>>"))))
    g = g.withColumn("flat", F.array_sort(F.transform(flat, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value")))))
    last = F.filter("flat", lambda e, i: (i == F.size("flat") - 1) | (F.get("flat", i + 1)["key"] != e["key"]))
    attributes = F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))
    return g.select(
        "entity_id", "related_id", first["rel_type"].alias("rel_type"), first["inference_type"].alias("inference_type"), "confidence", "created_at",
        first["expires_at"].alias("expires_at"), "frequency", F.concat(F.repeat(F.lit("merged:"), n - 1), sources).alias("source"), attributes.alias("attributes"),
    )


def frequency_filter(rels: DataFrame, access: DataFrame | None = None, config: CompactionConfig = CompactionConfig()) -> DataFrame:
    """Relationships whose related entity is accessed often enough; access has (related_id, access_frequency)."""
    if access is None:
        return rels.where(F.lit(config.default_frequency) >= config.min_frequency)
    found = rels.join(access, "related_id", "left").where(F.coalesce("access_frequency", F.lit(config.default_frequency)) >= config.min_frequency)
    return found.select(*rels.columns)


def compact(rels: DataFrame, now: int, access: DataFrame | None = None, config: CompactionConfig = CompactionConfig()) -> DataFrame:
    return frequency_filter(merge(dedup(without_expired(rels, now))), access, config)


def entity_figures(rels: DataFrame, now: int, access: DataFrame | None = None, config: CompactionConfig = CompactionConfig()) -> DataFrame:
    """(entity_id, n, expired, size_bytes, last_ms, min_access) of each entity."""
    access_of = rels.withColumn("access_frequency", F.lit(config.default_frequency)) if access is None else rels.join(access, "related_id", "left")
    return access_of.groupBy("entity_id").agg(
        F.count("*").alias("n"), F.count_if((F.col("expires_at") > 0) & (F.col("expires_at") <= now)).alias("expired"),
        (F.octet_length("entity_id") + 8 + F.sum(F.octet_length(encode_relationship()) + 1)).cast("long").alias("size_bytes"),
        F.max("created_at").alias("last_ms"), F.min(F.coalesce("access_frequency", F.lit(config.default_frequency))).alias("min_access"),
    )


class CompactionPolicy(Protocol):
    """What a policy says of entity_figures(), and how it compacts."""

    def should(self, config: CompactionConfig) -> Column: ...
    def priority(self, config: CompactionConfig) -> Column: ...
    def compact(self, rels: DataFrame, now: int, access: DataFrame | None, config: CompactionConfig) -> DataFrame: ...


class SizePolicy:
    def should(self, config):
        return (F.col("size_bytes") > config.max_bytes) | (F.col("n") > config.max_relationships)

    def priority(self, config):
        return F.greatest(F.col("size_bytes") / config.max_bytes, F.col("n") / config.max_relationships)

    def compact(self, rels, now, access, config):
        return dedup(without_expired(rels, now))


class TimePolicy:
    def should(self, config):
        return F.col("expired") > 0

    def priority(self, config):
        return F.when(F.col("n") > 0, F.col("expired") / F.col("n")).otherwise(0.0)

    def compact(self, rels, now, access, config):
        return without_expired(rels, now)


class FrequencyPolicy:
    def should(self, config):
        return F.col("min_access") < config.min_frequency

    def priority(self, config):
        return 1 - F.least(F.lit(1.0), F.col("min_access"))

    def compact(self, rels, now, access, config):
        return frequency_filter(rels, access, config)


class HybridPolicy:
    """Any policy's need, the highest priority, one compaction after the other."""

    def __init__(self, *policies: CompactionPolicy):
        self.policies = policies or (SizePolicy(), TimePolicy(), FrequencyPolicy())

    def should(self, config):
        return reduce(lambda a, b: a | b, (p.should(config) for p in self.policies))

    def priority(self, config):
        return F.greatest(*(p.priority(config) for p in self.policies)) if len(self.policies) > 1 else self.policies[0].priority(config)

    def compact(self, rels, now, access, config):
        return reduce(lambda r, p: p.compact(r, now, access, config), self.policies, rels)


def should_compact(figures: DataFrame, strategy: str, now: int, config: CompactionConfig = CompactionConfig()) -> DataFrame:
    """figures with `should`, by strategy "size", "time" (idle too long), "frequency" or "hybrid" (a priority high enough)."""
    rule = {
        "size": SizePolicy().should(config), "time": now - F.col("last_ms") > config.idle_ms, "frequency": FrequencyPolicy().should(config),
        "hybrid": HybridPolicy().priority(config) >= config.min_priority,
    }[strategy]
    return figures.withColumn("should", rule)


def schedule(figures: DataFrame, policy: CompactionPolicy, factor: float = 1.0, least: float = 0.0, config: CompactionConfig = CompactionConfig()) -> DataFrame:
    """The batch of entities with the highest priorities: factor 2.0 for one asked for, 1.5 for several, least 0.5 for bulk."""
    ranked = figures.withColumn("priority", F.round(policy.priority(config) * factor, 6)).where(F.col("priority") >= least)
    return ranked.orderBy(F.desc("priority"), "entity_id").limit(config.batch)


def run_stats(runs: DataFrame) -> DataFrame:
    """Totals and means of a run log (removed, bytes_saved, ms)."""
    return runs.agg(F.count("*").alias("runs"), F.sum("removed").alias("removed"), F.sum("bytes_saved").alias("bytes_saved"), F.avg("ms").alias("avg_ms"))
