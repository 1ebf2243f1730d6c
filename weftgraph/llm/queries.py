"""The queries opN_<name> of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, fingerprints, line_dedup, mixing, order_minhash, quality, suffix_dedup, token_histogram, training_order, warc_revisit
from weftgraph.llm.shared import materialize
from weftgraph.plans.lineage import fresh_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_fingerprints(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisit.resolve_revisits(warc_revisit.records_of_pages(_table(spark, sf_dir, "pages")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As its SQL says: runs of three lines, or one line of 50 words; the pipeline takes two lines of 50 words as well."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), two=False)


def op5_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_histogram.token_lengths(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return token_histogram.length_histogram(lengths)


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of all sequences of the vocabulary's token ids, and the digest of each record as read again from the written shards.

    The ids after the vocabulary's last one end a document and fill up a last sequence.
    """
    path, end = public_tokenizers.path(VOCABULARY), max(bpe.read_ranks(public_tokenizers.path(VOCABULARY)).values()) + 1
    packed = training_order.pack_sequences(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, end, end + 1)
    # Long pages and a thorough packing: copies and common phrases are told by what stands before.
    sequences = materialize(packed, "training-sequences", "zstd", **{"parquet.page.size": 8 << 20, "parquet.compression.codec.zstd.level": 9})
    shards = fresh_path(spark, "training-shards")
    training_order.write_shards(training_order.slot_sequences(sequences), shards)
    records = training_order.read_from(spark, shards, 0, ordered=False).select("slot", F.sha2("record", 256).alias("record_sha256"))
    return training_order.slot_sequences(sequences, records=False).join(records, "slot")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.code_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def token_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5's histogram says of context limits by powers of two, and of the shares of documents they hold."""
    lengths = token_histogram.token_lengths(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    histogram = materialize(token_histogram.length_histogram(lengths), "token-histogram")
    limits = spark.range(4, 21).select(F.expr("shiftleft(1L, int(id))").alias("context_limit"))
    rows = token_histogram.answer(histogram, limits).withColumns({"share": F.lit(None).cast("double"), "length": F.lit(None).cast("long")})
    shares = token_histogram.lengths_at(histogram, (0.1, 0.5, 0.9, 0.99, 1.0))
    return rows.unionByName(shares, allowMissingColumns=True)


def fingerprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band join of op1's fingerprints with verified Jaccard similarities, as a class of each document."""
    return fingerprints.near_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_suffix_dedup, op3_warc_revisit, op4_line_dedup, op5_token_histogram, op6_order_minhash, op7_quality, op8_mixing, op9_training_order, op10_bpe, fingerprint_classes, token_limits)}

#: The steps of canonical_url() in DuckDB's writing.
_CANONICAL = "lower(trim(url))"
for _pattern, _by in (
    ("^[a-z]+://", ""), ("#.*$", ""), ("^(www|m)[.]", ""), ("^([^/?]*):(80|443)([/?]|$)", "\\1\\3"),
    (f"([?&])({warc_revisit.TRACKING})=[^&]*", "\\1"), ("&+", "&"), ("[?]&", "?"), ("[?&]+$", ""), ("/index[.]html?$", "/"), ("/+$", ""),
):
    _CANONICAL = f"regexp_replace({_CANONICAL}, '{_pattern}', '{_by}', 'g')"

#: A word; the white space that str.strip() takes off; the rules of QualityRules() as SQL.
_WORD, _WHITE = "[^\\x20\\x09-\\x0D]+", "[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_RULES = quality.QualityRules()
_ENDS_SENTENCE = f"(^|[{quality.SENTENCE_ENDS}])[{re.escape(quality.CLOSING)}]*{_WHITE}*$".replace("'", "''")
_LINE_FAILS = f"""(len(regexp_extract_all(line, '[{quality.MENU_SIGNS}]')) >= greatest(2, '{_RULES.menu_share}'::DOUBLE * n)
  OR n <= {_RULES.boilerplate_words} AND regexp_matches(lower(line), '{"|".join(quality.BOILERPLATE)}')
  OR n >= 2 AND len(regexp_extract_all(line, '[#*$%&|<>]')) >= '{_RULES.symbol_share}'::DOUBLE * n
  OR n < {_RULES.short_line} AND NOT regexp_matches(line, '{_ENDS_SENTENCE}'))"""

ORACLE_SQL = {
    "op3_warc_revisit": f"""
WITH full_ AS (
  SELECT page_id * 2 AS rid, page_id * 10 AS t, {_CANONICAL} AS c, md5(coalesce(html, '')) AS tag, page_id * 10 - 1 AS lm,
         octet_length(encode(coalesce(html, ''))) AS n
  FROM pages),
again_ AS (
  SELECT page_id, page_id * 2 + 1 AS record_id, page_id * 10 + CASE WHEN page_id % 11 = 0 THEN -5 ELSE 5 END AS ts, {_CANONICAL} AS canonical,
         CASE WHEN page_id % 7 = 0 THEN '0' WHEN page_id % 3 <> 0 THEN md5(coalesce(html, '')) END AS etag,
         CASE WHEN page_id % 3 = 0 THEN page_id * 10 - 1 END AS lm
  FROM pages),
met AS (
  SELECT a.*, f.rid, f.tag, f.lm AS f_lm, f.n,
         row_number() OVER (PARTITION BY a.record_id ORDER BY f.t DESC, f.rid DESC) AS k
  FROM again_ a LEFT JOIN full_ f ON f.c = a.canonical AND (f.t < a.ts OR f.t = a.ts AND f.rid < a.record_id)),
judged AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'missing'
                 WHEN CASE WHEN etag IS NOT NULL THEN etag = tag WHEN lm IS NOT NULL THEN lm = f_lm ELSE true END THEN 'resolved'
                 ELSE 'changed' END AS outcome
  FROM met WHERE k = 1)
SELECT record_id, canonical, ts, outcome,
       CASE WHEN outcome = 'resolved' THEN rid END AS refers_to,
       CASE WHEN outcome = 'resolved' THEN 'age: ' || page_id || chr(10) || 'cache-control: max-age=600' || chr(10) || 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'server: origin' END AS header_line,
       CASE WHEN outcome = 'resolved' THEN tag END AS payload_md5
FROM judged""",
    "op4_line_dedup": f"""
WITH src AS (SELECT doc_id, text, sha256(coalesce(text, '')) AS h FROM documents),
parts AS (SELECT DISTINCT doc_id, h, string_split(coalesce(text, ''), chr(10)) AS p FROM src),
raw AS (SELECT doc_id, h, unnest(p) AS line, generate_subscripts(p, 1) AS i FROM parts),
num AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY i) AS k
  FROM (SELECT doc_id, h, i, regexp_replace(line, '^{_WHITE}+|{_WHITE}+$', '', 'g') AS s FROM raw) WHERE s <> ''),
runs AS (
  SELECT doc_id, h, k, {line_dedup.RUN} AS span, s || chr(10) || lead(s, 1) OVER o || chr(10) || lead(s, 2) OVER o AS run FROM num WINDOW o AS (PARTITION BY doc_id, h ORDER BY k)
  UNION ALL SELECT doc_id, h, k, 1, s FROM num WHERE len(regexp_extract_all(s, '{_WORD}')) >= {line_dedup.LONG}),
met AS (
  SELECT *, first_value(doc_id) OVER o AS first_doc, first_value(h) OVER o AS first_h, first_value(k) OVER o AS first_k
  FROM runs WHERE run IS NOT NULL WINDOW o AS (PARTITION BY span, run ORDER BY doc_id NULLS LAST, h, k)),
gone AS (
  SELECT DISTINCT doc_id, h, k + unnest(range(span)) AS k FROM met
  WHERE doc_id IS DISTINCT FROM first_doc OR h <> first_h OR k >= first_k + span),
kept AS (
  SELECT r.doc_id, r.h, count(n.k) AS n_lines, count(g.k) AS n_deleted, coalesce(string_agg(r.line, chr(10) ORDER BY r.i) FILTER (g.k IS NULL), '') AS text
  FROM raw r LEFT JOIN num n ON n.doc_id IS NOT DISTINCT FROM r.doc_id AND n.h = r.h AND n.i = r.i
  LEFT JOIN gone g ON g.doc_id IS NOT DISTINCT FROM r.doc_id AND g.h = r.h AND g.k = n.k GROUP BY r.doc_id, r.h)
SELECT s.doc_id, CASE WHEN s.text IS NOT NULL THEN kept.text END AS text, n_lines, n_deleted
FROM src s JOIN kept ON kept.doc_id IS NOT DISTINCT FROM s.doc_id AND kept.h = s.h""",
    "op7_quality": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_WORD}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
places AS (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w),
twice AS (SELECT r, unnest(list(i)) AS i FROM (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS eight FROM places) GROUP BY r, eight HAVING count(*) > 1),
again AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(8) t(j) GROUP BY r),
line AS (
  SELECT r, line, len(regexp_extract_all(line, '{_WORD}')) AS n, length(regexp_replace(line, '{_WHITE}', '', 'g')) AS chars
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
loss AS (SELECT r, coalesce(sum(chars) FILTER ({_LINE_FAILS}) / sum(chars), 0)::DOUBLE AS lost FROM line WHERE chars > 0 GROUP BY r),
base AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0.0)::DOUBLE AS lost
  FROM w LEFT JOIN again USING (r) LEFT JOIN loss USING (r)),
judged AS (SELECT *, n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= '{_RULES.max_lost}'::DOUBLE AS kept, lost
FROM judged""",
    "op8_mixing": f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', 7, doc_id)), 1, 15))::BIGINT AS h
  FROM documents),
whole AS (SELECT sum(size)::BIGINT AS total, greatest(1, (sum(size)::BIGINT + {mixing.SLOTS - 1}) // {mixing.SLOTS}) AS block FROM sized),
by_ AS (
  SELECT source, source_size, s, ([5, 2, 1])[s % 3 + 1]::DOUBLE AS w, 3 * source_size::DOUBLE AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM sized GROUP BY source)),
left_ AS (
  SELECT *, (total - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM by_, whole WINDOW o AS (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
target AS (SELECT source, s, source_size, least(cap, coalesce(w * max(level) FILTER (cap / w > level) OVER (), cap)) AS target FROM left_),
line AS (
  SELECT s, coalesce(lag(upto) OVER (ORDER BY s), 0) / total_ AS lo, CASE WHEN upto = total_ THEN 2 ELSE upto / total_ END AS hi
  FROM (SELECT s, target, sum(target) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS upto, sum(target) OVER () AS total_ FROM target WHERE target > 0)),
slot AS (SELECT i, i * 0.6180339887498949e0 - floor(i * 0.6180339887498949e0) AS u FROM whole, unnest(range((total + block - 1) // block)) t(i)),
ranked AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY i) - 1 AS rank FROM slot JOIN line ON u >= lo AND u < hi),
times AS (
  SELECT s, rank % n AS block_no, count(*) AS times
  FROM ranked JOIN (SELECT s, (source_size + block - 1) // block AS n FROM target, whole) USING (s) WHERE rank < 3 * n GROUP BY ALL),
placed AS (
  SELECT sized.doc_id, sized.size, t.source_size, t.target, t.s,
         (coalesce(sum(size) OVER (PARTITION BY t.s ORDER BY h % {mixing.BUCKETS}, h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
  FROM sized JOIN target t ON t.source IS NOT DISTINCT FROM sized.source),
piece AS (SELECT p.*, block, unnest(range(start // block, (start + size - 1) // block + 1)) AS block_no FROM placed p, whole WHERE size > 0)
SELECT doc_id, size, source_size, target, sum((least(start + size, (block_no + 1) * block) - greatest(start, block_no * block)) * coalesce(times, 0))::BIGINT AS taken
FROM piece LEFT JOIN times USING (s, block_no) GROUP BY doc_id, s, size, source_size, target, start
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM placed WHERE size = 0""",
}
