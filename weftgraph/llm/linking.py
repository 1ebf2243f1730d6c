"""Classes of alike texts from the buckets they share, without comparing all texts of a group with each other.

First every text is compared with the first one of each of its buckets: work in proportion to the texts, however large
a group of copies is, and most classes are whole after it. Then only buckets that still hold texts of different classes
matter: in small ones, the pairs across classes are compared; large ones are compared in blocks, exactly. Those of too
much text for one task are first cut by the rarest hashes of their texts, of which alike texts always share one (a prefix
filter), so that no link is lost. Every link is verified on the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import connected_components, materialize, slices
from weftgraph.llm.textvec import mix

#: Texts compared with one first text by a task, texts of a small bucket, and text bytes compared in one block.
BATCH, SMALL, BLOCK = 256, 16, 6 << 20
#: Slots in which hashes are counted, to tell the frequent ones.
SLOTS = 1 << 16


class Likeness(NamedTuple):
    """prepare: arrays of distinct hashes of a column of texts; of: the similarity of two of them, which is at most
    shared / (both lengths - shared), or 0.0 if it is under the given least one."""

    prepare: Callable[[pa.Array], list[np.ndarray]]
    of: Callable[[np.ndarray, np.ndarray, float], float]
    least: float


def verified_pairs(pairs: DataFrame, bodies: DataFrame, like: Likeness, name: str) -> DataFrame:
    """Those of the pairs (a, b) that are alike. A text is sent once for each pair it is the b of, and once to each task
    that holds pairs it is the a of; a task holds at most BATCH texts of one a, and a slice of them at once."""
    often = materialize(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > BATCH), f"{name}-often")
    parts = F.coalesce(F.ceil(F.col("n") / BATCH).cast("int"), F.lit(1))
    dealt = materialize(pairs.join(often, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part")), f"{name}-dealt")
    text = bodies.select("id", "text")
    others = dealt.withColumnRenamed("b", "id").join(text, "id").select("a", "part", F.lit(1).alias("other"), "id", "text")
    leads = dealt.select("a", "part").distinct().withColumn("id", F.col("a")).join(text, "id").select("a", "part", F.lit(0).alias("other"), "id", "text")
    rows = others.unionByName(leads).repartition("a", "part").sortWithinPartitions("a", "part", "other", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for batch in batches:
            for piece in slices(batch, "text"):
                made, found = like.prepare(piece.column(4)), []
                for k, (other, key) in enumerate(zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True)):
                    if not other:
                        lead = key, made[k].copy()
                    elif like.of(lead[1], made[k], like.least) >= like.least:
                        found.append((lead[0], key))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["a", "b"])

    return rows.mapInArrow(compare, "a binary, b binary")


def links_across(blocks: np.ndarray, roots: list, items: list[np.ndarray], across: bool, like: Likeness) -> Iterator[tuple[int, int]]:
    """Links that connect all alike items; `across`: only between the two blocks. Items of one root are connected already.

    Shared hashes are counted through an inverted list; two items are compared only if their count suffices and other
    links don't connect them yet.
    """
    n, least = len(items), like.least
    sizes = np.array([len(x) for x in items])
    owner = np.repeat(np.arange(n), sizes)
    _, value, often = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    order = np.argsort(value, kind="stable")
    begin, holders, ends = np.concatenate([[0], np.cumsum(often)]), owner[order], np.concatenate([[0], np.cumsum(sizes)])
    first: dict = {}
    root = [first.setdefault(r, i) for i, r in enumerate(roots)]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for d in range(1, n):
        own = value[ends[d] : ends[d + 1]]
        own = own[often[own] > 1]
        counts = often[own]
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin[own], counts)
        shared = np.bincount(holders[at], minlength=n)[:d]
        could = np.flatnonzero(shared * (1 + least) >= least * (sizes[:d] + sizes[d]) - 1e-9)
        for o in could[np.argsort(-shared[could], kind="stable")].tolist():
            if across and blocks[o] == blocks[d] or find(o) == find(d):
                continue
            if like.of(items[o], items[d], least) >= least:
                root[find(d)] = find(o)
                yield o, d


def verified_groups(groups: DataFrame, bodies: DataFrame, like: Likeness) -> DataFrame:
    """Links (a, b) that connect all alike texts of each group of (group, id, root, size), block by block of its bytes.

    A text is sent once for each block of its group, so no task holds more than two blocks and no link is lost.
    """
    whole = groups.groupBy("group").agg(F.greatest(F.ceil(F.sum("size") / BLOCK), F.lit(1)).cast("int").alias("n"))
    placed = groups.join(whole, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    placed = placed.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "root").join(bodies.select("id", "text"), "id")
    # Sorted, a task meets one pair of blocks after the other.
    placed = placed.select("group", "i", "j", "block", "id", "root", "text").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def links() -> pa.RecordBatch:
            made = list(links_across(np.array([h[0] for h in held]), [h[2] for h in held], [h[3] for h in held], now[1] != now[2], like)) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([held[k][1] for k, _ in made], pa.binary()), pa.array([held[k][1] for _, k in made], pa.binary())], names=["a", "b"])

        for batch in batches:
            for piece in slices(batch, "text"):
                made = like.prepare(piece.column(6))
                columns = [piece.column(c).to_pylist() for c in range(6)]
                for k, key in enumerate(zip(*columns[:3], strict=True)):
                    if key != now:
                        if held:
                            yield links()
                        now, held = key, []
                    held.append((columns[3][k], columns[4][k], columns[5][k], made[k].copy()))
        if held:
            yield links()

    return placed.mapInArrow(compare, "a binary, b binary")


def rarest_hashes(texts: DataFrame, like: Likeness) -> DataFrame:
    """(id, size, bucket) of texts (id, size, text): two alike texts share a bucket, whatever else they hold.

    Alike texts share at least `least` of the hashes of each, so in any order of all hashes they share one of the first
    (1 - least) of each and one more. The order is by how often a hash's slot is met, so frequent hashes hardly count.
    """

    def slots(hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes) % np.uint64(SLOTS)).astype(np.int64)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                met += np.bincount(slots(np.concatenate(like.prepare(piece.column(0)))), minlength=SLOTS)
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(met[at])], names=["slot", "n"])

    counts = texts.select("text").mapInArrow(tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(SLOTS, np.int64)
    often[counts.column(0).to_numpy()] = counts.column(1).to_numpy()

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                made = []
                for x in like.prepare(piece.column(2)):
                    most = len(x) - int(np.ceil(like.least * len(x) - 1e-9)) + 1
                    made.append(x[np.lexsort((x, often[slots(x)]))[:most]].view(np.int64))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(made, pa.list_(pa.int64()))], names=["id", "size", "buckets"])

    return texts.select("id", "size", "text").mapInArrow(rarest, "id binary, size long, buckets array<long>").select("id", "size", F.explode("buckets").alias("bucket"))


def _with_links(roots: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
    """roots (id, root) of the classes with the links (a, b) drawn, too; ids without a link may be missing."""
    if roots is None:
        return connected_components(links, name)
    known = lambda end, to: roots.select(F.col("id").alias(end), F.col("root").alias(to))
    drawn = links.join(known("a", "x"), "a", "left").join(known("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    steps = connected_components(drawn, name)
    ids = roots.unionByName(steps.select("id", F.col("id").alias("root")).join(roots, "id", "left_anti"))
    steps = steps.select(F.col("id").alias("root"), F.col("root").alias("to"))
    return materialize(ids.join(steps, "root", "left").select("id", F.coalesce("to", "root").alias("root")), f"{name}-roots")


def linked_classes(texts: DataFrame, bodies: DataFrame, like: Likeness, name: str) -> DataFrame:
    """(id, root) of the texts that are alike to another one: classes are the components of verified links, root their least id.

    texts (id, size, buckets): different texts with their bytes and the buckets that alike texts are to share; bodies
    (id, text): their texts, equal ones once. Two texts of a bucket are compared unless a class holds both already, or
    unless they can't be alike as the bucket is of more than BLOCK bytes and they share none of their rarest hashes.
    """
    members = texts.select("id", "size", F.explode(F.array_distinct("buckets")).alias("bucket"))
    firsts = members.groupBy("bucket").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    firsts = materialize(firsts, f"{name}-buckets")
    shared = materialize(members.join(firsts, "bucket"), f"{name}-shared")
    wanted = shared.select("id").distinct()
    bodies = materialize(bodies.join(wanted, "id", "left_semi"), f"{name}-bodies")

    pairs = shared.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    links = materialize(verified_pairs(materialize(pairs, f"{name}-firsts"), bodies, like, f"{name}-firsts"), f"{name}-links")
    roots = _with_links(None, links, f"{name}-classes")

    def mixed(rows: DataFrame, at: str) -> DataFrame:
        """rows with the root of each text, of buckets that hold several classes."""
        of = rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        several = of.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
        return materialize(of.join(materialize(several, f"{name}-{at}-several"), "bucket"), f"{name}-{at}")

    def draw(links: DataFrame, at: str) -> None:
        nonlocal roots
        if not links.isEmpty():
            roots = _with_links(roots, links, f"{name}-{at}-classes")

    def across(rows: DataFrame) -> DataFrame:
        """Links between the classes of a bucket."""
        left, right = (rows.select("bucket", F.col("id").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab")
        pairs = left.join(right, "bucket").where("a < b and a_root <> b_root").select("a", "b").distinct()
        return materialize(verified_pairs(materialize(pairs, f"{name}-pairs"), bodies, like, f"{name}-pairs"), f"{name}-links")

    def in_blocks(groups: DataFrame) -> DataFrame:
        groups = groups.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        return materialize(verified_groups(materialize(groups, f"{name}-groups"), bodies, like), f"{name}-links")

    small = mixed(shared.where(F.col("n") <= SMALL), "small")
    if not small.isEmpty():
        # Both were compared with the first text of the bucket.
        draw(across(small.where("id <> first")), "small")

    large = mixed(shared.where(F.col("n") > SMALL), "large")
    rest = large.where(F.col("bytes") <= BLOCK).select("id", "size", "bucket", "first")
    if not rest.isEmpty():
        # Buckets of much the same texts are one group, so that these are compared once.
        found = connected_components(rest.select(F.col("id").alias("a"), F.col("first").alias("b")), f"{name}-groups")
        draw(in_blocks(found.withColumnRenamed("root", "group").join(rest.select("id", "size").distinct(), "id")), "large")

    wide = large.where(F.col("bytes") > BLOCK).select("id", "size").distinct()
    if not wide.isEmpty():
        wide = materialize(bodies.join(wide, "id"), f"{name}-wide")
        members = materialize(rarest_hashes(wide, like), f"{name}-rarest")
        firsts = members.groupBy("bucket").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
        met = mixed(members.join(materialize(firsts, f"{name}-rarest-buckets"), "bucket"), "rarest")
        draw(across(met.where(F.col("n") <= SMALL)), "rarest-small")
        met = met.where(F.col("n") > SMALL)
        if not met.isEmpty():
            draw(in_blocks(met.select(F.col("first").alias("group"), "id", "size").distinct()), "rarest-large")
    return roots
