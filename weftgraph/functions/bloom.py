"""Bloom filters as sketches of id columns: built by Spark's own aggregate, sized by the usual formula, merged and stored."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bloom_size(items: int, rate: float) -> tuple[int, int]:
    """(bits, hash functions) for so many items at a rate of false positives."""
    bits = max(64, math.ceil(-items * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(items, 1) * math.log(2)))


class BloomSketch:
    """Says of a value whether the column may hold it; never denies one that it holds."""

    def __init__(self, jvm_filter):
        self._filter = jvm_filter

    @classmethod
    def of(cls, df: DataFrame, column: str, items: int, rate: float = 0.01) -> "BloomSketch":
        return cls(df._jdf.stat().bloomFilter(column, items, rate))

    def might_contain(self, value) -> bool:
        return self._filter.mightContain(value)

    def merged(self, other: "BloomSketch") -> "BloomSketch":
        return BloomSketch(self._filter.mergeInPlace(other._filter))

    def to_bytes(self, spark) -> bytes:
        out = spark._jvm.java.io.ByteArrayOutputStream()
        self._filter.writeTo(out)
        return bytes(out.toByteArray())

    @classmethod
    def from_bytes(cls, spark, data: bytes) -> "BloomSketch":
        source = spark._jvm.java.io.ByteArrayInputStream(bytearray(data))
        return cls(spark._jvm.org.apache.spark.util.sketch.BloomFilter.readFrom(source))


def _bits(value: Column, bits: int, hashes: int) -> Column:
    return F.array(*(F.pmod(F.xxhash64(F.lit(i), value), F.lit(bits)) for i in range(hashes)))


def partitioned_filter(df: DataFrame, column: str, parts: int, items: int, rate: float = 0.01) -> DataFrame:
    """(part, bit): a Bloom filter for each of `parts` parts of the column's values, as the set of its bits in a table.

    items: how many different values a part is expected to hold. No part is gathered in one place, so filters of any
    number of values can be built, stored and merged by union and distinct. Null is no value.
    """
    bits, hashes = bloom_size(items, rate)
    value = F.col(column)
    rows = df.where(value.isNotNull()).select(F.pmod(F.hash(value), F.lit(parts)).alias("part"), F.explode(_bits(value, bits, hashes)).alias("bit"))
    return rows.distinct()


def might_contain(filters: DataFrame, probes: DataFrame, column: str, parts: int, items: int, rate: float = 0.01) -> DataFrame:
    """The different probes with `maybe`: false only if no value of partitioned_filter() with the same figures equals it."""
    bits, hashes = bloom_size(items, rate)
    value = F.col(column)
    asked = probes.select(column).distinct().select(column, F.pmod(F.hash(value), F.lit(parts)).alias("part"), F.explode(F.array_distinct(_bits(value, bits, hashes))).alias("bit"))
    met = asked.join(filters.select("part", "bit", F.lit(1).alias("set")), ["part", "bit"], "left")
    return met.groupBy(column).agg((F.count("set") == F.count("*")).alias("maybe"))
