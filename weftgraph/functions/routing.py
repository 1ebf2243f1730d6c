"""Hashes that place keys on shards. Spark's own partitioning doesn't need them; they serve parity of placement."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the two hash functions.
FNV_OFFSET, FNV_PRIME, DJB2_START = 14695981039346656037, 1099511628211, 5381


def _fold(keys: list[bytes], start: int, step) -> np.ndarray:
    """Folds the bytes of all keys at once, place by place."""
    size = np.array([len(k) for k in keys], np.int64)
    out = np.full(len(keys), start, np.uint64)
    data = np.zeros((len(keys), max(int(size.max(initial=0)), 1)), np.uint8)
    for i, k in enumerate(keys):
        data[i, : len(k)] = np.frombuffer(k, np.uint8)
    for place in range(int(size.max(initial=0))):
        alive = size > place
        out[alive] = step(out[alive], data[alive, place].astype(np.int8).astype(np.int64).view(np.uint64))
    return out


def fnv1a(keys: list[bytes]) -> np.ndarray:
    """64-bit FNV-1a with wrapping; bytes above 127 count as signed, so they extend their sign."""
    return _fold(keys, FNV_OFFSET, lambda h, b: (h ^ b) * np.uint64(FNV_PRIME))


def djb2(keys: list[bytes]) -> np.ndarray:
    return _fold(keys, DJB2_START, lambda h, b: h * np.uint64(33) + b)


def shard_of(key: str | Column, shards: int) -> Column:
    """FNV-1a of the key modulo the number of shards."""

    @F.pandas_udf("int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in parts:
            yield pd.Series((fnv1a([(k or "").encode() for k in keys]) % np.uint64(shards)).astype(np.int32))

    return run(key)


def ring_shard_of(key: str | Column, shards: int, replicas: int = 150) -> Column:
    """The owner of the first point at or behind the key's hash on a ring of `replicas` points for each shard."""

    @F.pandas_udf("int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = [f"shard_{s}_node_{r}".encode() for s in range(shards) for r in range(replicas)]
        points, owners = djb2(names), np.repeat(np.arange(shards), replicas)
        order = np.argsort(points, kind="stable")
        points, owners = points[order], owners[order]
        for keys in parts:
            at = np.searchsorted(points, djb2([(k or "").encode() for k in keys]))
            yield pd.Series(owners[at % len(owners)].astype(np.int32))

    return run(key)
