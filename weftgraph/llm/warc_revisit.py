"""Resolution of WARC revisit records of "304 Not Modified": an as-of join by canonical URL to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.shared import range_bucket, range_cuts

#: Query parameters that only track, and headers that a 304 response must not change.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid"
FROZEN = ("content-encoding", "content-length", "content-md5", "content-range", "content-type", "transfer-encoding")
#: Ranges of capture times that are summed up one by one.
BLOCKS = 1024


def canonical_url(url: str | Column) -> Column:
    """The URL without scheme, "www." or "m.", default port, fragment, tracking parameters and closing slash or index page.

    Host and path are put into lower case. Null stays null.
    """
    steps = (
        ("^[a-z]+://", ""), ("#.*$", ""), ("^(www|m)[.]", ""), ("^([^/?]*):(80|443)([/?]|$)", "$1$3"),
        (f"([?&])({TRACKING})=[^&]*", "$1"), ("&+", "&"), ("[?]&", "?"), ("[?&]+$", ""), ("/index[.]html?$", "/"), ("/+$", ""),
    )
    out = F.lower(F.trim(url))
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return out


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A capture history made of pages: (record_id, url, ts, status, etag, last_modified, headers, body) records.

    Each page is a full response at ts = 10 * page_id with the digest of its html as ETag. Each is asked for again
    later, 5 after, at its address as https with a fragment: that record has status 304 and no body. Where page_id is
    divisible by 3 it has only Last-Modified; where by 7, the ETag of something else; where by 11, it stands before
    the response. Record ids are 2 * page_id and one more.
    """
    tag, body = F.md5(F.coalesce("html", F.lit(""))), F.col("html")
    own = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("server"), F.lit("origin"))
    later = F.create_map(F.lit("cache-control"), F.lit("max-age=600"), F.lit("content-length"), F.lit("0"), F.lit("age"), F.col("page_id").cast("string"))
    full = pages.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit(200).alias("status"), tag.alias("etag"), (F.col("page_id") * 10 - 1).alias("last_modified"), own.alias("headers"), body.alias("body"))
    other = F.when(F.col("page_id") % 7 == 0, F.lit("0")).when(F.col("page_id") % 3 != 0, tag)
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "^http:", "https:"), F.lit("#again")).alias("url"),
        (F.col("page_id") * 10 + F.when(F.col("page_id") % 11 == 0, -5).otherwise(5)).alias("ts"), F.lit(304).alias("status"), other.alias("etag"),
        F.when(F.col("page_id") % 3 == 0, F.col("page_id") * 10 - 1).alias("last_modified"), later.alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    return full.unionByName(again)


def as_of(records: DataFrame, keys: list[str], ts: str, tie: str, value: Column, eligible: Column, blocks: int = BLOCKS) -> DataFrame:
    """The records with `found`: value of the latest earlier eligible record of the same keys, or null.

    Earlier is by (ts, tie); records of equal ts and tie don't see each other's values in a fixed order. Times are cut
    into blocks of about equal counts. Each key's block is summed up by its latest value, these are carried forward
    over the blocks, and only then are records put in order within a key's block: no task needs all of a key's records.
    """
    cut = records.withColumn("_block", range_bucket(F.col(ts).cast("long"), range_cuts(records, ts, blocks)))
    order = F.struct(ts, tie)
    sums = cut.where(eligible).groupBy(*keys, "_block").agg(F.max_by(value, order).alias("_latest"))
    # Blocks without an eligible record get what came before them, too.
    seen = cut.select(*keys, "_block").distinct().join(sums, [*keys, "_block"], "left")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.select(*keys, "_block", F.last("_latest", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(*keys, "_block").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumn("_within", F.last(F.when(eligible, value), ignorenulls=True).over(inside)).join(carried, [*keys, "_block"])
    return rows.withColumn("found", F.coalesce("_within", "_carried")).drop("_block", "_within", "_carried")


def resolve_revisits(records: DataFrame, with_body: bool = False) -> DataFrame:
    """One row for each record of status 304: record_id, canonical, ts, outcome, refers_to, header_line, payload_md5 (and body).

    The latest earlier record of status 200 of the same canonical URL is its candidate. Validators decide: if the
    revisit has an ETag, it must equal the response's (weak and strong alike); else, if it has a Last-Modified, that
    must be equal; with neither, it is taken on trust. outcome: "resolved", "changed" (validators differ) or "missing"
    (no earlier response, or no URL or ts). A resolved record has the response's headers, with those of the revisit
    instead that it may change (none of FROZEN), as "name: value" lines by name, and the response's payload digest.
    Repeated records are resolved each; other columns are not read. An empty table gives no row.
    """
    tag = F.regexp_replace("etag", '^W/|"', "")
    rows = records.select("record_id", canonical_url("url").alias("canonical"), "ts", "status", tag.alias("etag"), "last_modified", "headers", F.md5(F.coalesce("body", F.lit(""))).alias("digest"))
    value = F.struct("record_id", "etag", "last_modified", "headers", "digest")
    known = rows.where(F.col("canonical").isNotNull() & F.col("ts").isNotNull())
    found = as_of(known, ["canonical"], "ts", "record_id", value, F.col("status") == 200).where("status = 304")
    lost = rows.where((F.col("status") == 304) & (F.col("canonical").isNull() | F.col("ts").isNull())).withColumn("found", F.lit(None).cast(found.schema["found"].dataType))
    found = found.unionByName(lost)
    valid = F.when(F.col("etag").isNotNull(), F.coalesce(F.col("etag") == F.col("found.etag"), F.lit(False))).when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == F.col("found.last_modified"), F.lit(False))).otherwise(True)
    outcome = F.when(F.col("found").isNull(), "missing").when(valid, "resolved").otherwise("changed")
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    allowed = F.map_filter(F.coalesce("headers", empty), lambda k, v: ~k.isin(*FROZEN))
    stored = F.map_filter(F.coalesce("found.headers", empty), lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    lines = F.array_sort(F.transform(F.map_entries(F.map_concat(stored, allowed)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    good = F.col("outcome") == "resolved"
    out = found.withColumn("outcome", outcome).select("record_id", "canonical", "ts", "outcome", F.when(good, F.col("found.record_id")).alias("refers_to"), F.when(good, F.array_join(lines, "\n")).alias("header_line"), F.when(good, F.col("found.digest")).alias("payload_md5"))
    if not with_body:
        return out
    bodies = records.where("status = 200").select(F.col("record_id").alias("refers_to"), "body").dropDuplicates(["refers_to"])
    return out.join(bodies, "refers_to", "left")
