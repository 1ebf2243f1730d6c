"""Helpers of several operators: tables in the shared folder, Arrow columns as numpy, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.lineage import written


def materialize(df: DataFrame, name: str, compression: str = "snappy", **options) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts the lineage and outlives lost executors."""
    return written(df, name, compression, **options)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty; offsets[0] is 0."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def release() -> None:
    """Gives memory back to the system that Arrow and the C library hold unused: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose column holds about `most` bytes each; a longer value stands alone."""
    release()
    ends = utf8(batch.column(batch.schema.get_field_index(column)))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def range_cuts(df: DataFrame, column: str, buckets: int) -> list[int]:
    """At most buckets - 1 values that cut the column's values into ranges of about equal counts."""
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    return sorted({int(x) for x in df.select(F.col(column).cast("double").alias("k")).approxQuantile("k", shares, 0.2 / buckets)})


def range_bucket(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at most the key, by binary search."""
    depth = max(1, len(cuts).bit_length())
    padded = F.array(*[F.lit(c).cast("long") for c in cuts + [(1 << 63) - 1] * ((1 << depth) - 1 - len(cuts))])
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(depth))])
    return F.aggregate(steps, F.lit(0), lambda acc, s: F.when(F.element_at(padded, acc + s) <= key, acc + s).otherwise(acc))


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(id, root) for edges (a, b): root is the least id of the component.

    In each round, every vertex takes the least id of itself and its neighbours as its name, and edges are drawn
    between the new names; edges within one name go. The graph shrinks until no edge is left. Each round is written
    to the shared folder.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{name}-edges")
    roots = None
    while True:
        ends = edges.select(F.col("b").alias("id"), F.col("a").alias("near")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("near")))
        names = materialize(ends.groupBy("id").agg(F.min("near").alias("name")), f"{name}-names")
        if roots is None:
            roots = names.withColumnRenamed("name", "root")
        else:
            step = names.withColumnRenamed("id", "root")
            roots = materialize(roots.join(step, "root", "left").select("id", F.coalesce("name", "root").alias("root")), f"{name}-roots")
        drawn = edges.join(names.select(F.col("id").alias("a"), F.col("name").alias("x")), "a").join(names.select(F.col("id").alias("b"), F.col("name").alias("y")), "b")
        edges = materialize(drawn.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-edges")
        if edges.isEmpty():
            return roots
