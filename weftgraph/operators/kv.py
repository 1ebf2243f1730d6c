"""Key-value views of an operation log (seq, op, key, value): the latest version of a key counts, a delete hides all earlier ones."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame) -> DataFrame:
    """(key, value, seq) of each live key. Deleting an absent key does nothing; a later put brings a key back."""
    last = log.groupBy("key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("last"))
    return last.where("last.op <> 'DELETE'").select("key", "last.value", "last.seq")


def versions(log: DataFrame) -> DataFrame:
    """All versions with their number `version`, from 1 for the newest of a key."""
    return log.withColumn("version", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq"))))


def get(log: DataFrame, key: str) -> DataFrame:
    """Filtered before the versions are compared, so only this key's rows are."""
    return latest(log.where(F.col("key") == key))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """A row for each key asked for; value is null for those without a live version."""
    wanted = keys.select("key").distinct()
    return wanted.join(latest(log.join(wanted, "key", "left_semi")), "key", "left")


def scan(log: DataFrame, start: str, end: str, limit: int | None = None) -> DataFrame:
    """Live keys from start to end, both included, in order."""
    found = latest(log.where(F.col("key").between(start, end))).orderBy("key")
    return found if limit is None else found.limit(limit)


def cached(log: DataFrame, capacity: int, width: int = 1 << 16) -> DataFrame:
    """(key, value, seq) of the live keys that a row cache of `capacity` bytes of keys and values holds after the log:
    the most recently used ones, up to the first that does not fit; the least recently used are evicted first.

    Bytes are summed by blocks of `width` sequence numbers first, so only the blocks that the cache reaches are put in
    order, each by itself; one row a block goes through one task.
    """
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    rows = latest(log).withColumn("block", F.expr(f"seq div {width}")).withColumn("bytes", size)
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("block").agg(F.sum("bytes").alias("n")).select("block", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("newer"))
    inside = Window.partitionBy("block").orderBy(F.desc("seq"), "key").rowsBetween(Window.unboundedPreceding, 0)
    reached = rows.join(sums.where(F.col("newer") <= capacity), "block")
    return reached.withColumn("upto", F.col("newer") + F.sum("bytes").over(inside)).where(F.col("upto") <= capacity).select("key", "value", "seq")


def put(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with the rows (seq, key, value) put."""
    return log.unionByName(rows.select("seq", F.lit("PUT").alias("op"), "key", "value"))


def delete(log: DataFrame, rows: DataFrame) -> DataFrame:
    return log.unionByName(rows.select("seq", F.lit("DELETE").alias("op"), "key", F.lit(None).cast("string").alias("value")))


def replay(snapshot: DataFrame, log: DataFrame, from_seq: int) -> DataFrame:
    """The live keys from a snapshot of (key, value, seq) before from_seq and the log's tail from it on."""
    return latest(snapshot.select("seq", F.lit("PUT").alias("op"), "key", "value").unionByName(log.where(F.col("seq") >= from_seq).select("seq", "op", "key", "value")))


def checksums(log: DataFrame) -> DataFrame:
    """(seq, key, crc) with the CRC-32 of each value."""
    return log.select("seq", "key", F.crc32("value").alias("crc"))


def compact_files(files: DataFrame, small: int = 32 << 20, target: int = 128 << 20) -> DataFrame:
    """A plan over (path, bytes): files under `small` get a group each of about `target` bytes; others stay.

    Files of a folder are grouped among themselves, in the order of size.
    """
    folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1).alias("folder")
    order = Window.partitionBy("folder").orderBy("bytes", "path").rowsBetween(Window.unboundedPreceding, 0)
    share = (F.sum("bytes").over(order) / target).cast("long")
    return files.where(F.col("bytes") < small).select("path", "bytes", folder).select("path", "bytes", share.alias("merge_group"))
