"""Order MinHash near-dedup: sketches of several minimum k-mers in text order, candidates verified by banded alignment."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.fingerprints import bodies_of, coefficients, text_shingles, with_classes
from weftgraph.llm.linking import Likeness, linked_classes
from weftgraph.llm.shared import materialize, slices, utf8
from weftgraph.llm.textvec import mix, occurrence_labelled

#: Words of a k-mer, k-mers of a sketch, sketches of a text, and least similarity.
WORDS, TAKEN, SKETCHES, LEAST = 5, 5, 40, 0.8
_STEP = np.uint64(0xD6E8FEB86659FD93)


def sketches(labelled: np.ndarray, taken: int = TAKEN, count: int = SKETCHES) -> np.ndarray:
    """One text's sketches: for each permutation, its `taken` least k-mers, put back into text order and hashed.

    Texts of as many k-mers or fewer have sketches of all of them.
    """
    a, b = coefficients(count, 23)
    n, out = len(labelled), np.zeros(count, np.uint64)
    for at in range(0, count, rows := max(1, min(count, (1 << 17) // max(n, 1)))):
        values = labelled[None, :] * a[at : at + rows, None] + b[at : at + rows, None]
        least = np.sort(np.argpartition(values, taken - 1, axis=1)[:, :taken], axis=1) if n > taken else np.broadcast_to(np.arange(n), (len(values), n))
        h = np.arange(at, at + len(values), dtype=np.uint64)
        for k in range(least.shape[1]):
            h = mix(h * _STEP + labelled[least[:, k]])
        out[at : at + rows] = h
    return out


def short_sketches(labelled: np.ndarray, taken: int = TAKEN) -> np.ndarray:
    """What sketches() makes first of a text without one of its k-mers, for each k-mer; only for texts of at most `taken` + 1.

    So a short text and the same with one k-mer more always share a sketch: all of the one, one left out of the other.
    """
    n = len(labelled)
    return np.concatenate([sketches(np.delete(labelled, i), taken, 1) for i in range(n)]) if 1 < n <= taken + 1 else np.zeros(0, np.uint64)


def sketch_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, size, sketches) for each row; text_id is half of the text's SHA-256, size its bytes.

    Texts without a word have no sketches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column(1))
                values, at = text_shingles(data, offsets, WORDS)
                labelled = occurrence_labelled(values, at)
                made = [np.concatenate([sketches(labelled[i:j]), short_sketches(labelled[i:j])]).view(np.int64) if j > i else [] for i, j in zip(at[:-1], at[1:], strict=True)]
                raw = data.tobytes()
                ids = [hashlib.sha256(raw[i:j]).digest()[:16] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(np.diff(offsets)), pa.array(made, pa.list_(pa.int64()))], names=["doc_id", "text_id", "size", "sketches"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_id binary, size long, sketches array<long>")


def alignment(x: np.ndarray, y: np.ndarray, least: float = LEAST) -> float:
    """The similarity m / (|x| + |y| - m), where m k-mers match in the best alignment; 0.0 if it is under `least`.

    x and y are occurrence-labelled, so a k-mer has one place in each; matches are kept in a band around the diagonal
    as wide as the insertions and deletions that the least similarity allows. Longest increasing runs of places give m.
    """
    n = len(x) + len(y)
    need = least * n / (1 + least)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= n - 2 * need
    i, j = i[near], j[near]
    if len(i) < need - 1e-9:
        return 0.0
    places = j[np.argsort(i)]
    if (np.diff(places) > 0).all():
        m = len(places)
    else:
        ends: list[int] = []
        for p in places.tolist():
            at = bisect_left(ends, p)
            ends[at : at + 1] = [p]
        m = len(ends)
    return m / (n - m) if m >= need - 1e-9 else 0.0


def _prepared(column: pa.Array) -> list[np.ndarray]:
    values, at = text_shingles(*utf8(column), WORDS)
    labelled = occurrence_labelled(values, at)
    return [labelled[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, text_id, class_id, class_size, root) for each row of docs.

    Texts that share a sketch are compared by the alignment of their five-word k-mers; a similarity of `least` or more
    links them; classes are the connected components of equal or linked texts (see linked_classes()). class_id is the
    least doc_id of the class (nulls apart), class_size its rows, root its least text_id. Copies of a text are sketched
    and compared once. Null counts as empty; texts without a word are alike only to equal ones. Repeated rows stay.
    Other columns are not read.
    """
    base = materialize(sketch_texts(docs), "order-sketches")
    texts = base.groupBy("text_id").agg(F.first("size").alias("size"), F.first("sketches").alias("buckets")).withColumnRenamed("text_id", "id")
    return with_classes(base, linked_classes(texts, bodies_of(docs), Likeness(_prepared, alignment, least), "order"), "order")
