"""Health and statistics as DataFrames over measured figures."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.config import PressureLimits
from weftgraph.functions.routing import shard_of


def under_pressure(limits: PressureLimits = PressureLimits()) -> Column:
    """Of metrics (queue_depth, backlog, memory_usage): whether any is above its limit."""
    return (F.col("queue_depth") > limits.max_queue) | (F.col("backlog") > limits.max_backlog) | (F.col("memory_usage") > limits.max_memory)


def health(metrics: DataFrame, limits: PressureLimits = PressureLimits()) -> DataFrame:
    return metrics.select("*", F.when(under_pressure(limits), "DEGRADED").otherwise("HEALTHY").alias("status"))


def partition_stats(df: DataFrame) -> DataFrame:
    """(shard, rows) by Spark partition."""
    return df.groupBy(F.spark_partition_id().alias("shard")).agg(F.count("*").alias("rows"))


def shard_stats(log: DataFrame, shards: int | None = None) -> DataFrame:
    """(shard, keys, operations, puts, deletes, bytes, last_seq) of an operation log (seq, op, key, value).

    As many shards as the session has cores, 128 at most, where no number is given. A shard without keys has no row.
    Operations are summed by key first, so each key is placed once.
    """
    shards = shards or min(128, log.sparkSession.sparkContext.defaultParallelism)
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    by_key = log.groupBy("key").agg(
        F.count("*").alias("operations"), F.count_if(F.col("op") == "PUT").alias("puts"), F.count_if(F.col("op") == "DELETE").alias("deletes"),
        F.sum(size).alias("bytes"), F.max("seq").alias("last_seq"),
    )
    sums = (F.sum(c).alias(c) for c in ("operations", "puts", "deletes", "bytes"))
    return by_key.groupBy(shard_of("key", shards).alias("shard")).agg(F.count("*").alias("keys"), *sums, F.max("last_seq").alias("last_seq"))


def global_stats(stats: DataFrame) -> DataFrame:
    """Totals of shard_stats(), and how many times the mean the busiest shard's operations are. Without shards, totals are null."""
    sums = (F.sum(c).alias(c) for c in ("keys", "operations", "puts", "deletes", "bytes"))
    return stats.agg(F.count("*").alias("shards"), *sums, F.max("last_seq").alias("last_seq"), (F.max("operations") / F.avg("operations")).alias("imbalance"))


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, hits / (hits + misses)).otherwise(0.0)
