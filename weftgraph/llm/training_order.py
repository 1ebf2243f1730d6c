"""Training-order materialisation: a keyed permutation gives every sequence its slot; slots are fixed-stride records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.bpe import library
from weftgraph.llm.shared import materialize, partitions, slices
from weftgraph.llm.textvec import mix

#: Token ids of UTF-8 bytes are the bytes; then the end of a document, and what fills up its last sequence.
END, PAD = 256, 257
#: Rows of a range of the numbering, which a task puts in order, and the most ranges; larger ranges spill.
RANGE_ROWS, RANGES = 4096, 1 << 16


def permuted(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A bijection of 0 to n-1, chosen by the key: a Feistel network over an even number of bits, walked until below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % (1 << 64)))
    out, open_ = index.astype(np.uint64), np.arange(len(index))
    while len(open_):
        x = out[open_]
        left, right = x >> shift, x & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        out[open_] = x = (left << shift) | right
        open_ = open_[x >= np.uint64(n)]
    return out.astype(np.int64)


def training_order(docs: DataFrame, key: int = 42, length: int = 1024, shard_rows: int = 8192, ids: str | None = None, width: int = 2, end: int = END, pad: int = PAD, records: bool = True) -> DataFrame:
    """One row for each sequence of `length` tokens: slot, shard, byte_offset, doc_id, seq_no, n_tokens, record.

    Each row of docs is its text's UTF-8 bytes, or the token ids in its array column `ids` (those of encode_documents(),
    say), and `end` (null: `end` alone), cut into sequences, the last filled with `pad`. Sequences are numbered in the
    order of a hash of doc_id; the keyed permutation of the numbers gives the slots 0 to N-1, each once. record: the ids
    as little-endian values of `width` bytes; an id that doesn't fit fails the job. n_tokens: without `pad`. A record
    stands at byte_offset of its shard of shard_rows records, each followed by one byte. Rows come in partitions of
    consecutive whole shards, sorted by slot. Rows of equal id and text are interchangeable; an empty table gives no
    row; other columns are not read. Without `records`, rows come in any order and the texts or ids aren't moved.
    """
    spark, unit, kind = docs.sparkSession, 1 if ids is None else width, np.dtype(f"<u{width}")
    if max(end, pad) >> 8 * width:
        raise ValueError(f"end {end} and pad {pad} don't fit in {width} bytes")
    data = F.coalesce("text", F.lit("")) if ids is None else F.coalesce(F.col(ids), F.array().cast(docs.schema[ids].dataType))
    size = F.octet_length("text") if ids is None else F.size("text")
    ranges = max(1, min(RANGES, -(-docs.count() // RANGE_ROWS)))
    rows = docs.select("doc_id", data.alias("text"), F.xxhash64(F.lit(3), "doc_id").alias("h")).withColumn("b", F.pmod("h", F.lit(ranges)))
    rows = rows.withColumn("size", size.cast("long")).withColumn("n_seq", F.floor((F.col("size") + length) / length).cast("long")).withColumn("tie", F.xxhash64("text"))
    sums = materialize(rows.groupBy("b").agg(F.sum("n_seq").alias("n")), "training-order")
    n = sums.agg(F.sum("n")).first()[0] or 0
    base = sums.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("b").orderBy("h", "doc_id", "n_seq", "tie").rowsBetween(Window.unboundedPreceding, -1)
    id_type, parts = docs.schema["doc_id"].dataType.simpleString(), partitions(spark)
    shards = max(1, -(-n // shard_rows))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                flat = some.column(0).flatten()
                wide = flat.to_numpy(zero_copy_only=False)
                if flat.null_count or len(wide) and (wide.min() < 0 or int(wide.max()) >> 8 * width):
                    raise ValueError(f"token ids from {wide.min()} to {wide.max()} don't fit in {width} bytes")
                raw, ends = wide.astype(kind).tobytes(), np.cumsum([0, *np.asarray(some.column(0).value_lengths())]) * width
                yield pa.RecordBatch.from_arrays([pa.array([raw[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), *some.columns[1:]], names=some.schema.names)

    if records and ids is not None:
        rows = rows.select("text", "doc_id", "size", "h", "b", "n_seq", "tie").mapInArrow(pack, f"text binary, doc_id {id_type}, size long, h long, b long, n_seq long, tie long")
    if not records:
        rows = rows.drop("text")
    rows = rows.withColumn("within", F.coalesce(F.sum("n_seq").over(inside), F.lit(0))).join(F.broadcast(base), "b")
    rows = rows.select("doc_id", "text" if records else "size", (F.col("base") + F.col("within")).alias("first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                sizes = np.asarray(some.column(1))
                counts = sizes // length + 1
                row = np.repeat(np.arange(len(sizes)), counts)
                seq = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                slots = permuted(np.asarray(some.column(2))[row] + seq, n, key)
                held = np.minimum(length, sizes[row] - seq * length + 1)
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(slots // shard_rows), pa.array(slots % shard_rows * (width * length + 1)), some.column(0).take(pa.array(row)), pa.array(seq), pa.array(held)], names=["slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens"])

    known = f"slot long, shard long, byte_offset long, doc_id {id_type}, seq_no long, n_tokens long"
    if not records:
        return rows.mapInArrow(place, known)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                texts = [t.encode() if ids is None else t for t in some.column(1).to_pylist()]
                counts = np.array([len(t) // (unit * length) + 1 for t in texts], np.int64)
                row = np.repeat(np.arange(len(texts)), counts)
                seq = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                slots = permuted(np.asarray(some.column(2))[row] + seq, n, key)
                pieces = [texts[r][s * unit * length : (s + 1) * unit * length] for r, s in zip(row.tolist(), seq.tolist(), strict=True)]
                part = (slots // shard_rows) * parts // shards
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(slots), some.column(0).take(pa.array(row)), pa.array(seq), pa.array(seq == counts[row] - 1), pa.array(pieces, pa.binary())], names=["part", "slot", "doc_id", "seq_no", "last", "piece"])

    def record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                slots = np.asarray(rows.column(1))
                filled, sizes = np.full((len(slots), length), pad, kind), np.zeros(len(slots), np.int64)
                for i, (piece, last) in enumerate(zip(rows.column(5).to_pylist(), rows.column(4).to_pylist(), strict=True)):
                    own = np.frombuffer(piece, np.uint8 if ids is None else kind)
                    filled[i, : len(own)] = own
                    sizes[i] = len(own) + last
                    if last:
                        filled[i, len(own)] = end
                records = pa.array([x.tobytes() for x in filled], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(1), pa.array(slots // shard_rows), pa.array(slots % shard_rows * (width * length + 1)), rows.column(2), rows.column(3), pa.array(sizes), records], names=["slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens", "record"])

    pieces = rows.mapInArrow(cut, f"part int, slot long, doc_id {id_type}, seq_no long, last boolean, piece binary")
    ordered = pieces.repartitionById(parts, F.col("part")).sortWithinPartitions("slot")
    return ordered.mapInArrow(record, f"{known}, record binary")


def pack_sequences(docs: DataFrame, path: str, pattern: str, end: int, pad: int, length: int = 1024, width: int = 2) -> DataFrame:
    """(part, number, doc_id, begin, n_tokens, record): all texts' token ids end to end, cut into sequences of `length` ids.

    A text's ids are followed by `end`; null and empty texts are `end` alone. The rows of a partition `part` are one
    stream, so only its last sequence is filled up with `pad`; number: the sequence's place in its stream. doc_id, begin:
    the document whose ids the sequence begins with, and how many of them are in sequences before. record: the ids as
    little-endian values of `width` bytes; n_tokens: without `pad`. An empty table gives no row; other columns are not
    read. Written as a table, the sequences are numbered once and for all; a task that runs again numbers them alike.
    """
    names = ["part", "number", "doc_id", "begin", "n_tokens", "record"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, kind = library(path, pattern), np.dtype(f"<u{width}")
        if max(end, pad, *coder._mergeable_ranks.values()) >> 8 * width:
            raise ValueError(f"ids up to {max(end, pad, *coder._mergeable_ranks.values())} don't fit in {width} bytes")
        part, done = TaskContext.get().partitionId(), 0
        # What is left over of the stream: ids, the documents that begin in it or before, and where in it.
        left, owners, starts = np.zeros(0, kind), None, np.zeros(0, np.int64)

        def cut(stream: np.ndarray, n: int, held: np.ndarray) -> pa.RecordBatch:
            places = np.arange(n) * length
            which = np.searchsorted(starts, places, "right") - 1
            raw, step = stream[: n * length].tobytes(), length * width
            columns = [pa.array(np.full(n, part)), pa.array(done + np.arange(n)), owners.take(pa.array(which)), pa.array(places - starts[which]), pa.array(held)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([raw[i * step : (i + 1) * step] for i in range(n)], pa.binary())], names=names)

        for batch in batches:
            for some in slices(batch, "text"):
                ids = [coder.encode_to_numpy(t, disallowed_special=()).astype(kind) if t else left[:0] for t in some.column(1).to_pylist()]
                new = len(left) + np.cumsum([0, *(len(x) + 1 for x in ids)])[:-1]
                stream = np.concatenate([left, *(y for x in ids for y in (x, np.array([end], kind)))])
                starts = np.concatenate([starts, new])
                owners = some.column(0) if owners is None else pa.concat_arrays([owners, some.column(0)])
                if n := len(stream) // length:
                    yield cut(stream, n, np.full(n, length))
                    done += n
                left = stream[n * length :]
                keep = max(0, int(np.searchsorted(starts, n * length, "right")) - 1)
                owners, starts = owners.slice(keep), starts[keep:] - n * length
        if len(left):
            yield cut(np.concatenate([left, np.full(length - len(left), pad, kind)]), 1, np.array([len(left)]))

    return docs.select("doc_id", "text").mapInArrow(run, f"part long, number long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, begin long, n_tokens long, record binary")


def slot_sequences(sequences: DataFrame, key: int = 42, length: int = 1024, shard_rows: int = 8192, width: int = 2, records: bool = True) -> DataFrame:
    """The rows of a written table of pack_sequences() with their slot, shard and byte_offset, as training_order() gives them.

    With `records`, rows of (slot, shard, byte_offset, record) in partitions of consecutive whole shards, sorted by slot:
    the records are shuffled once. Without, all but the records, in any order, and nothing is moved.
    """
    parts = partitions(sequences.sparkSession)
    sums = materialize(sequences.groupBy("part").agg(F.count("*").alias("n")), "sequence-parts")
    n = sums.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-n // shard_rows))
    # One row for each partition that the texts were read in.
    base = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = ["record"] if records else ["doc_id", "begin", "n_tokens"]
    rows = sequences.join(base, "part").select((F.col("base") + F.col("number")).alias("slot"), *own)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            rest = [pa.array(list(map(pack, batch.column(1).to_pylist())), pa.binary())] if records else batch.columns[1:]
            yield pa.RecordBatch.from_arrays([pa.array(permuted(np.asarray(batch.column(0)), n, key)), *rest], names=batch.schema.names)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(list(map(plain, some.column(1).to_pylist())), pa.binary())], names=some.schema.names)

    rows = rows.mapInArrow(place, rows.schema)
    if records:
        # Ids pack to two thirds by their frequencies, which Spark's own compression of a shuffle leaves aside.
        part = (F.expr(f"slot div {shard_rows}") * parts / shards).cast("int")
        rows = rows.repartitionById(parts, part).sortWithinPartitions("slot").mapInArrow(unpack, rows.schema)
    return rows.withColumns({"shard": F.expr(f"slot div {shard_rows}"), "byte_offset": F.col("slot") % shard_rows * (width * length + 1)})


def write_shards(ordered: DataFrame, path: str) -> None:
    """Writes the records of training_order()'s or slot_sequences()'s rows as binary files, one for each shard, in path/shard=K.

    A file holds the shard's records in the order of their slots, each followed by a byte 0x0A, and nothing else: slot
    s begins at its byte_offset. Spark's text writer writes the bytes as they are, to any store, and commits whole tasks
    only, so a lost task writes its own shards again.
    """
    rows = ordered.select("shard", "slot", F.col("record").cast("string").alias("value")).sortWithinPartitions("shard", "slot").select("shard", "value")
    rows.write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", 0).partitionBy("shard").text(path)


def read_from(spark: SparkSession, path: str, slot: int, length: int = 1024, shard_rows: int = 8192, width: int = 2, ordered: bool = True) -> DataFrame:
    """(slot, record) from a slot on, in order, from the files of write_shards(): earlier shards are not opened.

    Not `ordered`, only the records of a shard come in order, without a shuffle. A task holds a few shards of shard_rows * (width * length + 1) bytes. Shards of an empty table give no row.
    """
    stride = width * length + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                if data.size % stride:
                    raise ValueError(f"shard {shard} isn't made of records of {stride} bytes")
                begin = max(0, slot - shard * shard_rows)
                for at in range(begin, data.size // stride, 1024):
                    places = range(at, min(at + 1024, data.size // stride))
                    records = [data[k * stride : (k + 1) * stride - 1].to_pybytes() for k in places]
                    yield pa.RecordBatch.from_arrays([pa.array([shard * shard_rows + k for k in places], pa.int64()), pa.array(records, pa.binary())], names=["slot", "record"])

    files = spark.read.format("binaryFile").load(path)
    if "shard" not in files.columns:
        return spark.createDataFrame([], "slot long, record binary")
    files = files.where(F.col("shard") >= slot // shard_rows)
    records = files.select(F.col("shard").cast("long").alias("shard"), "content").mapInArrow(cut, "slot long, record binary")
    return records.orderBy("slot") if ordered else records
