"""MinHash document fingerprints: universal hash permutations over word shingles, bands joined, Jaccard verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.linking import Likeness, linked_classes
from weftgraph.llm.shared import materialize, partitions, range_bucket, range_cuts, slices, utf8
from weftgraph.llm.textvec import mix, shingles, word_hashes, words

#: Words of a shingle, places and bands of a fingerprint, least similarity of linked texts.
WORDS, PERMUTATIONS, BANDS, LEAST = 5, 128, 32, 0.8
_LEAST, _STEP = -(1 << 63), np.uint64(0xD6E8FEB86659FD93)


def coefficients(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """n multiply-add hash functions of 64-bit values: odd factors and addends."""
    rng = np.random.Generator(np.random.PCG64(seed))
    a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
    return a * np.uint64(2) + np.uint64(1), b * np.uint64(2) + np.uint64(1)


def text_shingles(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, by_text = words(data, offsets)
    return shingles(word_hashes(data, starts, ends), by_text, k)


def signatures(values: np.ndarray, offsets: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """(texts, permutations) array of 16 mixed bits of each permutation's minimum; a text without shingles has 0xFFFF."""
    filled = np.flatnonzero(np.diff(offsets))
    out = np.full((len(offsets) - 1, permutations), 0xFFFF, np.uint16)
    if len(filled):
        hashed, at = np.empty_like(values), offsets[filled]
        for k, (a, b) in enumerate(zip(*coefficients(permutations), strict=True)):
            np.multiply(values, a, out=hashed)
            np.add(hashed, b, out=hashed)
            # Minima of many values have few leading bits; mixed, equal 16 bits mean equal minima.
            out[filled, k] = mix(np.minimum.reduceat(hashed, at)) >> np.uint64(48)
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The share of equal places of fingerprints, row by row: estimates the Jaccard similarity of the shingle sets."""
    return (x == y).mean(axis=-1)


def said(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def _of_texts(texts: list[str], permutations: int) -> np.ndarray:
    encoded = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int64)
    return signatures(*text_shingles(np.frombuffer(b"".join(encoded), np.uint8), offsets), permutations)


def edited_text(text: str, following: str) -> str:
    """The text with its last third of code points replaced by the first as many, or all, of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _by_neighbour(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, borrowed, doc_id, text), in partitions of one bucket each, in the order of descending doc_id.

    Buckets are ranges of doc_id. Each also borrows the first row of the next lower one (the lowest borrows the
    highest row), so each row's follower is in its partition. What goes through the driver is a cut and a head a bucket.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))
    docs = docs.select("doc_id", "text", key.alias("k"))
    bucket = range_bucket(F.col("k"), range_cuts(docs, "k", buckets))
    docs = docs.withColumn("bucket", bucket)
    heads = sorted((r[0], r[1]) for r in docs.groupBy("bucket").agg(F.max("k")).collect())
    above = [b for b, _ in heads[1:]] + [b for b, _ in heads[:1]]
    lent = spark.createDataFrame([(head, to) for (_, head), to in zip(heads, above, strict=True)] or [(0, 0)], "k long, lent_to int")
    docs = docs.join(F.broadcast(lent), "k", "left")
    homes = F.array(F.struct(F.col("bucket"), F.lit(False).alias("borrowed")), F.struct(F.col("lent_to").alias("bucket"), F.lit(True).alias("borrowed")))
    rows = docs.select("doc_id", "text", "k", F.explode(F.filter(homes, lambda x: x["bucket"].isNotNull())).alias("home")).select("home.*", "doc_id", "text", "k")
    rows = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "borrowed", F.desc("k"), F.asc_nulls_first("text"))
    return rows.select("bucket", "borrowed", "doc_id", "text")


def edit_fingerprints(docs: DataFrame, permutations: int = PERMUTATIONS) -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next lower doc_id, after the lowest the highest. Null ids come last; rows of equal
    id follow each other by text, null first. A null text counts as empty. Texts without a word have the fingerprint
    of all ones, so they are alike (1.0) to each other and to little else. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        # The last row so far, whose follower is still to come; rows borrowed after the first one only repeat its id.
        last = done = None
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                bucket, borrowed, ids, texts = (c.to_pylist() for c in part.columns)
                texts = [t or "" for t in texts]
                signs = _of_texts(texts, permutations)
                pairs = []
                for i, (b, lent) in enumerate(zip(bucket, borrowed, strict=True)):
                    if b == done:
                        continue
                    here = (ids[i], texts[i], signs[i])
                    if last is not None:
                        pairs.append((last, here))
                    last, done = (None, b) if lent else (here, done)
                if not pairs:
                    continue
                edits = [edited_text(x[1], y[1]) for x, y in pairs]
                own, new, after = (np.stack([x[2] for x, _ in pairs]), _of_texts(edits, permutations), np.stack([y[2] for _, y in pairs]))
                columns = [[x[0] for x, _ in pairs], [len(x[1]) for x, _ in pairs], [hashlib.sha256(e.encode()).hexdigest() for e in edits], [said(s) for s in own], [said(s) for s in new], likeness(own, new), likeness(own, after)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema["doc_id"].dataType
    kinds = [to_arrow_type(id_type), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = f"doc_id {id_type.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _by_neighbour(docs, partitions(docs.sparkSession)).mapInArrow(run, schema)


def fingerprint_texts(docs: DataFrame, permutations: int = PERMUTATIONS, bands: int = BANDS) -> DataFrame:
    """(doc_id, text_id, size, buckets) for each row: text_id is half of the text's SHA-256, size its bytes, buckets a hash of
    each band of its signature; a text without a word has none."""
    width = permutations // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column(1))
                values, at = text_shingles(data, offsets)
                signs = signatures(values, at, permutations)[:, : bands * width].astype(np.uint64).reshape(-1, bands, width)
                hashed = np.broadcast_to(salt, signs.shape[:2])
                for k in range(width):
                    hashed = mix(hashed * _STEP + signs[:, :, k])
                made = [x if n else [] for x, n in zip(hashed.view(np.int64), np.diff(at), strict=True)]
                raw = data.tobytes()
                ids = [hashlib.sha256(raw[i:j]).digest()[:16] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(np.diff(offsets)), pa.array(made, pa.list_(pa.int64()))], names=["doc_id", "text_id", "size", "buckets"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_id binary, size long, buckets array<long>")


def _sets(column: pa.Array) -> list[np.ndarray]:
    values, at = text_shingles(*utf8(column))
    return [np.unique(values[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]


def jaccard(x: np.ndarray, y: np.ndarray, least: float = LEAST) -> float:
    """The Jaccard similarity of two sets, sorted arrays; 0.0 if it is under `least`."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    whole = len(x) + len(y) - shared
    return shared / whole if whole and shared >= least * whole - 1e-9 else 0.0


def bodies_of(docs: DataFrame) -> DataFrame:
    """(id, text) of each different text; copies go where they are read already, so a large group of them doesn't meet in one task."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("id"), text.alias("text")).groupBy("id").agg(F.first("text").alias("text"))


def with_classes(base: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """(doc_id, text_id, class_id, class_size, root) of the rows of base (doc_id, text_id) by the classes (id, root) of their texts."""
    rows = base.select("doc_id", "text_id").join(classes.withColumnRenamed("id", "text_id"), "text_id", "left").withColumn("root", F.coalesce("root", "text_id"))
    # Written, the join reads it by an exchange of its own, so AQE can split the rows of a large class.
    heads = materialize(rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), f"{name}-heads")
    return rows.join(heads, "root").select("doc_id", "text_id", "class_id", "class_size", "root")


def near_classes(docs: DataFrame, least: float = LEAST, bands: int = BANDS, permutations: int = PERMUTATIONS) -> DataFrame:
    """(doc_id, text_id, class_id, class_size, root) for each row of docs: classes of texts alike by their fingerprints.

    Texts that share a band of their fingerprints are candidates; those whose sets of five-word shingles have a Jaccard
    similarity of `least` or more are linked; classes are the connected components of equal or linked texts (see
    linked_classes()). A pair of similarity 0.8 shares none of 32 bands of 4 with a chance of about 5e-8. class_id is
    the least doc_id of the class (nulls apart), class_size its rows, root its least text_id. Copies of a text count
    once when texts are compared; null counts as empty; texts without a word are alike only to equal ones. Repeated
    rows stay; an empty table gives no row; other columns are not read.
    """
    base = materialize(fingerprint_texts(docs, permutations, bands), "fingerprints")
    texts = base.groupBy("text_id").agg(F.first("size").alias("size"), F.first("buckets").alias("buckets")).withColumnRenamed("text_id", "id")
    return with_classes(base, linked_classes(texts, bodies_of(docs), Likeness(_sets, jaccard, least), "fingerprints"), "fingerprints")
