"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Slot i of the schedule lies at frac(i * golden ratio) on the line of cumulative target shares, which names its source.
The k-th slot of a source takes the k-th word of its documents in shuffled order, starting over when all are taken.
A slot is one word in a corpus of any size, so each source's words follow its share, at any point of the schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.shared import materialize

GOLDEN = 0.6180339887498949
#: Slots whose points are found together, parts of the shuffled order, least number of cells of the line of shares.
SLOTS, BUCKETS, CELLS = 1 << 20, 4096, 1024
#: Rows that a range of a part is to hold at most, on average, were all rows of one source.
RANGE = 1 << 16
#: Tasks that make the schedule, at most: of more slots than these hold at SLOTS each, a task makes more, one after the other.
TASKS = 1 << 16


def word_count(text: str | Column) -> Column:
    """The number of runs of other than space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, s, source_size, target): each source's words and the words a mix of the same total takes from it.

    Sources in code point order, null last, weigh as `weights` repeats. A target stops at `most` times its source;
    the excess goes to the others by weight until none is above: with the sources by cap to weight, the first ones
    are at their caps, and one level of words per weight unit serves the rest. One row a source runs through one task.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("s", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("s") % len(weights) + 1).cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    before = Window.orderBy(F.col("cap") / F.col("w"), "s").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    by = by.withColumn("level", level).withColumn("level", F.max(F.when(F.col("cap") / F.col("w") > F.col("level"), F.col("level"))).over(every))
    return by.select("source", "s", "source_size", F.least("cap", F.coalesce(F.col("w") * F.col("level"), "cap")).alias("target"))


def shuffled_offsets(sized: DataFrame, n_rows: int, seed: int = 7) -> DataFrame:
    """The rows with `start`: the words of the same source (column s) before the row in shuffled order.

    The order is by 60 bits of an MD5 hash of doc_id: by the part it names (of BUCKETS), then by the hash. Parts are cut into
    as many ranges of hashes as `n_rows` rows ask for, which changes no order, and summed first, so that no task needs a whole source.
    """
    bits = max(0, -(-n_rows // (BUCKETS * RANGE)) - 1).bit_length()
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    rows = sized.withColumn("h", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")).withColumn("b", F.pmod("h", F.lit(BUCKETS))).withColumn("c", F.shiftright("h", 60 - bits))
    sums = rows.groupBy("s", "b", "c").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("s").orderBy("b", "c").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "b", "c", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # Of equal ids, rows follow each other by size and then by what is kept of them.
    ties = ["h", "doc_id", "size", *(["kept"] if "kept" in rows.columns else [])]
    inside = Window.partitionBy("s", "b", "c").orderBy(*ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(sums, ["s", "b", "c"]).withColumn("start", F.col("base") + F.col("within")).drop("h", "b", "c", "base", "within")


def schedule(targets: DataFrame, total: int) -> DataFrame:
    """(slot, s): the source of each of `total` slots.

    A slot's point is the sum of those of its range of SLOTS slots and of its place therein, as i * GOLDEN alone loses
    the digits that tell small sources apart when i is large.
    """
    spark = targets.sparkSession
    n_cells = max(CELLS, targets.count())  # so a cell has about one source, however many there are
    order = Window.orderBy("s")
    upto = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0))
    below = F.coalesce(F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = F.sum("target").over(Window.partitionBy(F.lit(0)))
    line = targets.where("target > 0").select("s", (below / whole).alias("lo"), F.when(upto == whole, F.lit(2.0)).otherwise(upto / whole).alias("hi"))
    cells = F.sequence(F.floor(F.col("lo") * n_cells), F.least(F.floor(F.col("hi") * n_cells), F.lit(n_cells - 1)))
    line = line.select("s", "lo", "hi", F.explode(cells).alias("cell"))
    part = lambda x: x - F.floor(x)
    point = part(F.expr(f"id div {SLOTS}") * F.lit(SLOTS * GOLDEN % 1)) + part(F.expr(f"id % {SLOTS}") * F.lit(GOLDEN))
    slots = spark.range(0, total, 1, min(TASKS, max(1, -(-total // SLOTS)))).select(F.col("id").alias("slot"), part(point).alias("u")).withColumn("cell", F.floor(F.col("u") * n_cells))
    return slots.join(line, "cell").where("u >= lo and u < hi").select("slot", "s")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` (small ones that can be put in order, such as ids) of every row, and size, source_size, target and taken: the words the mix takes, repeats counted.

    Documents without words take nothing. A source's slots end when all of its words were taken `most` times. Rows
    that are alike in doc_id, source, size and `keep` get interchangeable results; null ids are ordinary ids. Empty tables give no rows.
    """
    sized = materialize(docs.select(F.struct(*keep).alias("kept"), "doc_id", "source", word_count("text").alias("size")), "mixing-sizes")
    total, n_rows = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    targets = materialize(source_targets(sized, weights, most), "mixing-targets")
    known = targets.select(F.col("source").alias("name"), "s", "source_size", "target")
    sized = sized.join(known, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    placed = shuffled_offsets(sized.where("size > 0"), n_rows)
    counts = schedule(targets, total).groupBy("s").agg(F.count("*").alias("slots"))
    # Slots go round the source's words: each word is taken once a round, those before the end of the last round once more.
    placed = placed.join(counts, "s", "left").withColumn("slots", F.least(F.coalesce("slots", F.lit(0)), F.col("source_size") * most))
    again = F.greatest(F.least(F.col("size"), F.col("slots") % F.col("source_size") - F.col("start")), F.lit(0))
    out = ["kept.*", "size", "source_size", "target"]
    taken = placed.select(*out, (F.expr("slots div source_size") * F.col("size") + again).cast("long").alias("taken"))
    empty = sized.where("size = 0").select(*out, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(empty)
