"""Exact histogram of encoded document lengths; suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.bpe import library
from weftgraph.llm.shared import materialize, slices
from weftgraph.llm.warc_revisit import as_of


def token_lengths(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(n_tokens) of each document's whole text; a null or empty text has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library(path, pattern).encode_to_numpy
        for batch in batches:
            for part in slices(batch, "text"):
                sizes = [len(encode(t, disallowed_special=())) if t else 0 for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], names=["n_tokens"])

    return docs.select("text").mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame, block: int = 1024) -> DataFrame:
    """One row for each distinct length L of column n_tokens (null counts as 0), for the context limit L.

    n_docs: documents of length L; docs_upto, docs_over: of at most L, of more; tokens_upto: tokens of those of at
    most L; truncated_tokens: the sum of min(length, L) over all documents; quantile: docs_upto as a share of all.
    An empty table gives no row. Rows are counted where they are read; sums run within blocks of lengths and then
    over the blocks, so no task holds all lengths.
    """
    counts = lengths.select(F.coalesce("n_tokens", F.lit(0)).cast("long").alias("context_limit")).groupBy("context_limit").agg(F.count("*").alias("n_docs"))
    # Read twice below; written, the texts are encoded once.
    counts = materialize(counts, "token-lengths").withColumn("block", F.expr(f"context_limit div {block}"))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("context_limit")).alias("t"))
    order = Window.orderBy("block")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d_before"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t_before"),
        F.sum("d").over(every).alias("all_docs"),
    )
    inside = Window.partitionBy("block").orderBy("context_limit").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.select("*", F.sum("n_docs").over(inside).alias("d_in"), F.sum(F.col("n_docs") * F.col("context_limit")).over(inside).alias("t_in")).join(blocks, "block")
    upto = upto.withColumns({"docs_upto": F.col("d_before") + F.col("d_in"), "tokens_upto": F.col("t_before") + F.col("t_in")}).withColumn("docs_over", F.col("all_docs") - F.col("docs_upto"))
    return upto.select(
        "context_limit", "n_docs", "docs_upto", "docs_over", "tokens_upto",
        (F.col("tokens_upto") + F.col("context_limit") * F.col("docs_over")).alias("truncated_tokens"),
        (F.col("docs_upto") / F.col("all_docs")).alias("quantile"),
    )


def answer(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """For each different context_limit of limits, also such that no document has: context_limit, docs_upto, docs_over,
    tokens_upto, truncated_tokens. A null limit has no answer; of no documents, all figures are 0.

    The latest length up to each limit is found by an as-of join over blocks of lengths.
    """
    figures = F.struct("docs_upto", "docs_over", "tokens_upto")
    known = histogram.select(F.col("context_limit").cast("long").alias("at"), F.lit(0).alias("asked"), figures.alias("figures"))
    asked = limits.where(F.col("context_limit").isNotNull()).select(F.col("context_limit").cast("long").alias("at")).distinct().withColumn("asked", F.lit(1)).withColumn("figures", F.lit(None).cast(known.schema["figures"].dataType))
    met = as_of(known.unionByName(asked), [], "at", "asked", F.col("figures"), F.col("asked") == 0).where("asked = 1")
    everything = histogram.agg(F.coalesce(F.max(F.col("docs_upto") + F.col("docs_over")), F.lit(0)).alias("all_docs"))
    met = met.crossJoin(F.broadcast(everything))  # of one row
    over, tokens = F.coalesce("found.docs_over", "all_docs"), F.coalesce("found.tokens_upto", F.lit(0))
    return met.select(F.col("at").alias("context_limit"), F.coalesce("found.docs_upto", F.lit(0)).alias("docs_upto"), over.alias("docs_over"), tokens.alias("tokens_upto"), (tokens + over * F.col("at")).alias("truncated_tokens"))


def lengths_at(histogram: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """(share, length): the least length that at least so large a share of the documents doesn't exceed; null of no documents."""
    found = histogram.agg(*(F.min(F.when(F.col("quantile") >= share, F.col("context_limit"))).alias(f"q{k}") for k, share in enumerate(shares)))
    rows = F.array(*(F.struct(F.lit(share).cast("double").alias("share"), F.col(f"q{k}").alias("length")) for k, share in enumerate(shares)))
    return found.select(F.explode(rows).alias("r")).select("r.*")
