"""Exact removal of repeated byte strings by hash-compared suffix sorting.

Strings of LENGTH bytes that are equal select, by winnowing, the same anchor (their leftmost least gram) at the same
place. So repeats only have to be found among the strings of one anchor. Strings with the same anchor that follow each
other in a text form a segment. Equal segments are only counted. Different segments of one anchor are compared by
sorting their suffixes behind the anchor, and the reversed prefixes before it: prefix polynomial hashes and binary
search give the common extension of two suffixes in logarithmically many steps, mergesort puts all anchors' suffixes in
order at once, and neighbours are then verified byte by byte. The extensions shared with neighbours tell, for each
offset, the classes of equal prefixes and of equal suffixes; two strings are equal if both their classes are.

An anchor with too many different segments for one task is cut into ranges of suffixes: strings whose anchor lies within
some range of places share what is before and behind in all of that range, so they fall into groups by these bytes. The
range is halved until the groups are small; each is sorted as any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import materialize
from weftgraph.llm.textvec import _BYTE, mix, powers

LENGTH, GRAM = 400, 64
#: Text bytes worked on at once, segment bytes sorted at once, different segments of a group that one task sorts, rows of a batch.
PIECE, SORTED, HOT, ROWS = 1 << 20, 1 << 21, 4096, 1 << 14
_u = np.uint64


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte values times powers of the base: S[i+n] - S[i] is the hash of n bytes times power i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:])
    return out


def segments(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor place, first start, last start) of each segment of one text.

    A string starting at i covers i to i+length-1; its anchor is the leftmost least gram inside.
    """
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    sums, grams, width = prefix_hashes(data), len(data) - gram + 1, length - gram + 1
    hashed = mix((sums[gram:] - sums[:-gram]) * powers(grams, -1))
    packed = (hashed & _u(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    # Minima of all windows from running minima of blocks, forwards and backwards.
    padded = np.full(-(-grams // width) * width, ~_u(0))
    padded[:grams] = packed
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(backward[:n], forward[width - 1 : width - 1 + n]) & _u(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    anchor = least[first]
    return hashed[anchor].view(np.int64), anchor, first, np.concatenate([first[1:], [n]]) - 1


def common(sums: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How far the bytes from p and from q agree, up to `most`, by binary search over hashes of equal length."""
    pow_ = powers(len(sums))
    low, high = np.zeros(len(p), np.int64), most.copy()
    sp, sq, fp, fq = sums[p], sums[q], pow_[p], pow_[q]
    while (open_ := low < high).any():
        middle = (low + high + 1) >> 1
        same = (sums[p + middle] - sp) * fq == (sums[q + middle] - sq) * fp
        low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
    return low


def _less(data, sums, at, size, x, y) -> np.ndarray:
    """Whether suffix x comes before y; an end comes before any byte, equal ones in the order of their numbers."""
    most = np.minimum(size[x], size[y])
    n = common(sums, at[x], at[y], most)
    ended = n == most
    i, j = np.minimum(at[x] + n, len(data) - 1), np.minimum(at[y] + n, len(data) - 1)
    return np.where(ended, np.where(size[x] == size[y], x < y, size[x] < size[y]), data[i] < data[j])


def sort_suffixes(data: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffix numbers sorted within their group, and each one's common bytes with the one before it.

    Suffix k is data[at[k] : at[k]+size[k]]; numbers ascend by group. All groups' runs are merged at once: a suffix
    moves as many places as there are lesser ones in the run beside its own, found by binary search. The neighbours'
    common bytes and order are verified on the bytes; if hashes collided, the suffixes are sorted by the bytes.
    """
    n = len(at)
    begin = np.searchsorted(group, group)
    end = np.searchsorted(group, group, "right")
    place, order, sums, width = np.arange(n), np.arange(n), prefix_hashes(data), 1
    while n and (end - begin).max() > width:
        run = (place - begin) // width
        other = np.where(run % 2 == 0, begin + (run + 1) * width, begin + (run - 1) * width)
        low = np.minimum(other, end)
        start, high = low.copy(), np.minimum(other + width, end)
        while (open_ := low < high).any():
            k = np.flatnonzero(open_)
            middle = (low[k] + high[k]) >> 1
            before = _less(data, sums, at, size, order[middle], order[k])
            low[k], high[k] = np.where(before, middle + 1, low[k]), np.where(before, high[k], middle)
        to = np.where(run % 2 == 0, place, place - width) + (low - start)
        merged = np.empty(n, np.int64)
        merged[to] = order
        order, width = merged, width * 2
    if n == 0:
        return order, np.zeros(0, np.int64)
    x, y = order[:-1], order[1:]
    near = group[x] == group[y]
    found = np.where(near, common(sums, at[x], at[y], np.minimum(size[x], size[y])), 0)
    if not _verified(data, at, size, x[near], y[near], found[near]):
        raw = data.tobytes()
        order = np.array(sorted(range(n), key=lambda k: (group[k], raw[at[k] : at[k] + size[k]], k)))
        x, y = order[:-1], order[1:]
        near, found = group[x] == group[y], np.zeros(n - 1, np.int64)
        for k in np.flatnonzero(near):
            most = min(size[x[k]], size[y[k]])
            differ = np.flatnonzero(data[at[x[k]] : at[x[k]] + most] != data[at[y[k]] : at[y[k]] + most])
            found[k] = differ[0] if len(differ) else most
    return order, np.concatenate([[0], found])


def _verified(data, at, size, x, y, found) -> bool:
    """Whether each pair's first `found` bytes are equal, and the next shows x to come before y."""
    for k in range(0, len(x), 2048):
        a, b, n = at[x[k : k + 2048]], at[y[k : k + 2048]], found[k : k + 2048]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(data[np.repeat(a, n) + step], data[np.repeat(b, n) + step]):
            return False
    most = np.minimum(size[x], size[y])
    i, j = np.minimum(at[x] + found, len(data) - 1), np.minimum(at[y] + found, len(data) - 1)
    return bool(np.where(found == most, size[x] <= size[y], data[i] < data[j]).all())


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts) or b"\0", np.uint8), np.cumsum(size) - size, size


def repeated_offsets(group: np.ndarray, strings: list[bytes], before: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each segment, the ranges (first, last) of starts in it whose strings another segment of its group has, too.

    before[k]: the bytes of segment k before its anchor. Segments of a group are different and sorted together.
    """
    data, at, size = _joined([s[b:] for s, b in zip(strings, before.tolist(), strict=True)])
    right, right_common = sort_suffixes(data, at, size, group)
    data, at, left_size = _joined([s[:b][::-1] for s, b in zip(strings, before.tolist(), strict=True)])
    left, left_common = sort_suffixes(data, at, left_size, group)
    last = before - (np.array([len(s) for s in strings]) - length)  # the least bytes before the anchor that a string has
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    for g, h in zip(begin.tolist(), [*begin[1:].tolist(), len(group)], strict=True):
        m = h - g
        if m < 2:
            continue
        lo, hi = last[g:h], before[g:h]
        # Between these numbers of bytes before the anchor, no class changes.
        cuts = np.unique(np.concatenate([lo, hi + 1, left_common[g + 1 : h] + 1, length - right_common[g + 1 : h]]))
        cuts = cuts[(cuts >= lo.min()) & (cuts <= hi.max())]
        if not len(cuts):
            continue
        if m == 2:
            a, b = max(lo.max(), length - right_common[g + 1]), min(hi.min(), left_common[g + 1])
            if a <= b:
                out[g], out[g + 1] = [(int(hi[0] - b), int(hi[0] - a))], [(int(hi[1] - b), int(hi[1] - a))]
            continue
        upto, parts = np.concatenate([cuts[1:], [hi.max() + 1]]) - 1, []
        for k in range(0, len(cuts), step := max(1, (1 << 18) // m)):
            j = cuts[k : k + step, None]
            classes = np.empty((2, len(j), m), np.int32)
            classes[0][:, left[g:h] - g] = np.cumsum(left_common[g:h] < j, axis=1)
            classes[1][:, right[g:h] - g] = np.cumsum(right_common[g:h] < length - j, axis=1)
            key = classes[0].astype(np.int64) * (m + 1) + classes[1]
            key[(j < lo) | (j > hi)] = -1
            order = np.argsort(key, axis=1, kind="stable")
            key = np.take_along_axis(key, order, 1)
            same = np.zeros(key.shape, bool)
            equal = (key[:, 1:] == key[:, :-1]) & (key[:, 1:] >= 0)
            same[:, 1:] |= equal
            same[:, :-1] |= equal
            r, c = np.nonzero(same)
            s = order[r, c]
            parts.append((s, hi[s] - np.minimum(upto[k + r], hi[s]), hi[s] - cuts[k + r]))
        s, first, final = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.lexsort((first, s))
        s, first, final = s[by], first[by], final[by]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (first[1:] > final[:-1] + 1)
        for x, y, z in zip(s[new].tolist(), first[new].tolist(), final[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]]) if len(s) else []].tolist(), strict=True):
            out[g + x].append((y, z))
    return out


def _batched(rows: Iterator[list[tuple]], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Record batches of about ROWS rows from lists of rows."""
    held: list[tuple] = []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
    for some in rows:
        held += some
        if len(held) >= ROWS:
            yield made()
            held = []
    if held:
        yield made()


def find_segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(text_id, anchor, segment, first, size, before) for each segment of each text; segment is its bytes' digest."""
    names = ["text_id", "anchor", "segment", "first", "size", "before"]
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]

    def rows(texts: Iterator[pa.Scalar]) -> Iterator[list[tuple]]:
        for text in texts:
            raw = (text.as_py() or "").encode()
            if len(raw) < length:
                continue
            text_id = hashlib.sha256(raw).digest()[:16]
            for start in range(0, len(raw) - length + 1, PIECE):
                data = raw[start : start + PIECE + length - 1]
                found = [x.tolist() for x in segments(np.frombuffer(data, np.uint8), length, gram)]
                yield [
                    (text_id, anchor, piece_digest(data[f : t + length], place - f), f + start, t - f + length, place - f)
                    for anchor, place, f, t in zip(*found, strict=True)
                ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(rows(t for batch in batches for t in batch.column(0)), kinds, names)

    return docs.select("text").mapInArrow(run, "text_id binary, anchor long, segment binary, first long, size int, before int")


def piece_digest(data: bytes, before: int) -> bytes:
    """Tells apart pieces of text that differ in their bytes or in the place of the anchor."""
    return hashlib.blake2b(data, digest_size=16, salt=before.to_bytes(8, "little")).digest()


def _cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with the bytes of each segment, from one document that holds it."""
    per_text = wanted.groupBy("text_id").agg(F.collect_list(F.struct("anchor", "segment", "first", "size", "before", "kinds")).alias("parts"))
    text = F.coalesce("text", F.lit(""))
    bodies = docs.select(F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("text_id"), text.alias("text"))
    # Copies go where they are read already, so a large group of them doesn't meet in one task.
    joined = bodies.groupBy("text_id").agg(F.first("text").alias("text")).join(per_text, "text_id").select("text", "parts")
    names, kinds = ["anchor", "segment", "before", "kinds", "bytes"], [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            for text, parts in zip(batch.column(0), batch.column(1), strict=True):
                raw, parts = text.as_py().encode(), parts.as_py()
                for at in range(0, len(parts), 4096):
                    yield [(p["anchor"], p["segment"], p["before"], p["kinds"], raw[p["first"] : p["first"] + p["size"]]) for p in parts[at : at + 4096]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(rows(batches), kinds, names)

    return joined.mapInArrow(run, "anchor long, segment binary, before int, kinds long, bytes binary")


_RANGES = "group long, piece binary, ranges array<struct<a:int,b:int>>"
_RANGE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _sorted_ranges(strings: DataFrame, length: int) -> DataFrame:
    """(group, piece, ranges): repeated starts of each piece, from sorting the different pieces (group, piece, before, bytes) of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def solved(rows: list[tuple]) -> pa.RecordBatch:
            groups = np.array([r[0] for r in rows])
            numbers = np.cumsum(np.concatenate([[0], groups[1:] != groups[:-1]]))
            found = repeated_offsets(numbers, [r[3] for r in rows], np.array([r[2] for r in rows], np.int64), length)
            some = [k for k, f in enumerate(found) if f]
            ranges = pa.array([[{"a": a, "b": b} for a, b in merged(found[k])] for k in some], _RANGE)
            return pa.RecordBatch.from_arrays([pa.array(groups[some], pa.int64()), pa.array([rows[k][1] for k in some], pa.binary()), ranges], names=["group", "piece", "ranges"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SORTED and row[0] != held[-1][0]:
                    yield solved(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield solved(held)

    return strings.select("group", "piece", "before", "bytes").repartition("group").sortWithinPartitions("group", "piece").mapInArrow(run, _RANGES)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _halved(pieces: DataFrame, length: int) -> DataFrame:
    """Each piece (anchor, segment, shift, lo, hi, before, bytes) cut in two by the range lo to hi of bytes before the anchor.

    A string whose anchor lies a to b bytes behind its start holds the a bytes before the anchor and the length - b from
    it on. These bytes make its group; what one piece adds to others of a group lies beyond them. shift: where the
    piece starts in its segment.
    """
    names = ["anchor", "segment", "shift", "lo", "hi", "before", "bytes", "group", "piece"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            for anchor, segment, shift, lo, hi, before, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                middle, made = (lo + hi) // 2, []
                for a, b in ((lo, middle), (middle + 1, hi)):
                    x, y = max(a, before - len(data) + length), min(b, before)
                    if x <= y:
                        shared = hashlib.blake2b(data[before - a : before + length - b], digest_size=8, salt=(anchor % (1 << 64)).to_bytes(8, "little"), person=a.to_bytes(4, "little") + b.to_bytes(4, "little"))
                        own = data[before - y : before - x + length]
                        made.append((anchor, segment, shift + before - y, a, b, y, own, int.from_bytes(shared.digest(), "little", signed=True), piece_digest(own, y)))
                yield made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(rows(batches), kinds, names)

    schema = "anchor long, segment binary, shift int, lo int, hi int, before int, bytes binary, group long, piece binary"
    return pieces.select("anchor", "segment", "shift", "lo", "hi", "before", "bytes").mapInArrow(run, schema)


def _hot_ranges(strings: DataFrame, length: int, gram: int) -> DataFrame | None:
    """(anchor, segment, ranges) for anchors of more than HOT different segments, or None if there are none."""
    pieces = materialize(strings.where(F.col("kinds") > HOT).select("anchor", "segment", F.lit(0).alias("shift"), F.lit(0).alias("lo"), F.lit(length - gram).alias("hi"), "before", "bytes"), "suffix-hot")
    out = None
    while not pieces.isEmpty():
        pieces = materialize(_halved(pieces, length), "suffix-pieces")
        different = pieces.groupBy("group", "piece").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("bytes").alias("bytes"))
        different = materialize(different, "suffix-kinds")
        kinds = materialize(different.groupBy("group").agg(F.count("*").alias("kinds")), "suffix-groups")
        of = different.join(kinds, "group")
        # A piece that several segments hold is repeated all over; different pieces of a group are sorted.
        whole = of.where("n > 1").select("group", "piece", F.array(F.struct(F.lit(0).alias("a"), (F.octet_length("bytes") - length).alias("b"))).alias("ranges"))
        found = materialize(_sorted_ranges(of.where(f"kinds between 2 and {HOT}"), length).unionByName(whole), "suffix-found")
        moved = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("shift")).alias("a"), (r["b"] + F.col("shift")).alias("b")))
        ranges = pieces.join(found, ["group", "piece"]).select("anchor", "segment", moved.alias("ranges"))
        out = ranges if out is None else out.unionByName(ranges)
        pieces = pieces.join(kinds.where(F.col("kinds") > HOT), "group", "left_semi")
    return None if out is None else out.groupBy("anchor", "segment").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and on request the kept bytes) for each row of docs.

    A byte of a text's UTF-8 goes if a string of `length` bytes covers it that starts at two or more places of the
    input: in the same text (overlapping counts) or in any row. Null counts as empty. Equal texts are all removed if
    they are `length` bytes or longer. Repeated rows are rows like others. Other columns are not read.
    """
    found = materialize(find_segments(docs, length, gram), "suffix-segments")
    different = found.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(F.struct("text_id", "first", "size", "before")).alias("at"))
    by_anchor = different.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("places")).where("places > 1")
    different = materialize(different.join(by_anchor, "anchor"), "suffix-different")
    wanted = different.where("kinds > 1").select("anchor", "segment", "kinds", "at.*")
    strings = materialize(_cut_out(docs, wanted), "suffix-strings")
    small = strings.where(F.col("kinds") <= HOT).select(F.col("anchor").alias("group"), F.col("segment").alias("piece"), "before", "bytes")
    ranges = _sorted_ranges(small, length).withColumnsRenamed({"group": "anchor", "piece": "segment"})
    if (hot := _hot_ranges(strings, length, gram)) is not None:
        ranges = ranges.unionByName(hot)
    whole = different.where("n > 1").select("anchor", "segment", F.array(F.struct(F.lit(0).alias("a"), (F.col("at.size") - length).alias("b"))).alias("ranges"))
    ranges = ranges.join(whole.select("anchor", "segment"), ["anchor", "segment"], "left_anti").unionByName(whole)
    spans = F.transform("ranges", lambda r: F.struct((F.col("first") + r["a"]).alias("a"), (F.col("first") + r["b"] + length).alias("b")))
    marks = found.join(ranges, ["anchor", "segment"]).select("text_id", "first", spans.alias("spans")).dropDuplicates(["text_id", "first"])
    marks = marks.groupBy("text_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    text = F.coalesce("text", F.lit(""))
    joined = docs.select("doc_id", text.alias("text"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("text_id")).join(marks, "text_id", "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode()
                runs: list[list[int]] = []
                for a, b in sorted((s["a"], s["b"]) for s in spans.as_py() or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                kept = b"".join(raw[a:b] for a, b in zip([0] + [r[1] for r in runs], [r[0] for r in runs] + [len(raw)], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * with_bytes
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return joined.mapInArrow(run, schema)
