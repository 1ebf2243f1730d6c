"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, line_dedup, mixing, order_minhash, quality
from weftgraph.llm.shared import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Known encodings that a worker keeps: the stages before have filled an executor's memory, so fewer than op10 alone.
KEPT = 100_000


def _text_id() -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, without their failing lines. Null and empty texts are rejected."""
    judged = quality.judge_documents(docs, keep=COLUMNS, cleaned=True).where("kept")
    return judged.withColumn("text", F.col("cleaned")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines of later repeated runs; a document of which nothing is left goes."""
    deduped = line_dedup.dedup_lines(docs, keep=COLUMNS).where("n_deleted < n_lines or n_lines = 0")
    return deduped.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least doc_id, or of the least text hash where ids are equal or null."""
    classes = order_minhash.near_duplicates(docs)
    heads = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id")).alias("head")).select("head.doc_id", "head.text_id")
    rows = docs.select(*COLUMNS, _text_id().alias("own"))
    kept = rows.join(heads, F.col("own").eqNullSafe(heads["text_id"]) & rows["doc_id"].eqNullSafe(heads["doc_id"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "own"]).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number of times; none for documents it leaves out.

    Rows of equal id, text and source are treated alike.
    """
    rows = docs.select(*COLUMNS, _text_id().alias("text_id"))
    taken = mixing.mix_sources(rows, keep=("doc_id", "text_id", "source")).where("size > 0")
    taken = taken.groupBy("doc_id", "text_id", "source").agg(F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias("times")).where("times > 0")
    taken = taken.select(F.col("doc_id").alias("d"), F.col("text_id").alias("t"), F.col("source").alias("s"), "times")
    same = rows["doc_id"].eqNullSafe(F.col("d")) & (rows["text_id"] == F.col("t")) & rows["source"].eqNullSafe(F.col("s"))
    return rows.join(taken, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number and digest of the token ids, and the digest of the text decoded from them."""
    return bpe.code_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, kept=KEPT)


STAGES = [("quality rules", quality_rules), ("line dedup", lines_once), ("near-dedup", one_of_each), ("mixing", mixed), ("encoding", encoded)]

#: SQL can express neither the alignment of near-duplicates nor the tokens; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}")
    return docs
