"""A durable key-value store in a folder that driver and executors share: a log of checked segments, sorted files, a manifest.

Writes append a segment to the log, all of its rows or none. A flush sorts what the log holds into a level-0 file, one
folder of Parquet by shard with Bloom filters on the key; compaction merges files. What counts is the newest manifest:
a small JSON file that lists the live segments and files. It is written aside and renamed, never replaced, so of two
writers one fails and may try again, and a lost job leaves only files that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.kv import latest
from weftgraph.schemas import KV_LOG


@dataclass(frozen=True)
class Piece:
    """A segment of the log (level -1) or a sorted file: its folder, rows, bytes, sequence numbers and least and greatest key."""

    name: str
    level: int
    rows: int
    bytes: int
    first_seq: int
    last_seq: int
    low: str
    high: str


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    last_seq: int = 0
    flushed_seq: int = 0
    pieces: tuple[Piece, ...] = ()
    totals: dict = field(default_factory=dict)

    @property
    def segments(self) -> list[Piece]:
        return [p for p in self.pieces if p.level < 0]

    @property
    def files(self) -> list[Piece]:
        return [p for p in self.pieces if p.level >= 0]


class WriteConflict(RuntimeError):
    """Another writer has committed since the store was opened; open it again and repeat the write."""


def row_crc() -> Column:
    """CRC-32 of a log row's sequence number, operation, key and value; a null value differs from an empty one."""
    return F.crc32(F.concat_ws("\x1f", "seq", "op", "key", F.coalesce(F.concat(F.lit("="), "value"), F.lit("-"))))


class KvStore:
    """put_batch, flush, compact and truncate return the store as it is afterwards; readers see the manifest they were opened at."""

    def __init__(self, spark: SparkSession, root: str, shards: int = 16, manifest: Manifest | None = None):
        self.spark, self.root, self.shards = spark, root.rstrip("/"), shards
        self.manifest = self._newest() if manifest is None else manifest

    # The manifest.

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _newest(self) -> Manifest:
        path, fs = self._fs(f"{self.root}/manifest")
        names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
        names = [n for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
        if not names:
            return Manifest()
        said = json.loads(self.spark.read.text(f"{self.root}/manifest/{names[-1]}", wholetext=True).first()[0])
        return Manifest(**said | {"pieces": tuple(Piece(**p) for p in said["pieces"])})

    def _commit(self, **changes) -> KvStore:
        new = replace(self.manifest, version=self.manifest.version + 1, **changes)
        aside, fs = self._fs(f"{self.root}/manifest/_{uuid.uuid4().hex}")
        to, _ = self._fs(f"{self.root}/manifest/{new.version:012}.json")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            # Without OVERWRITE a rename fails where the target exists.
            context.rename(fs.makeQualified(aside), fs.makeQualified(to), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise WriteConflict(f"version {new.version} of {self.root} is there already") from e
            raise
        return KvStore(self.spark, self.root, self.shards, new)

    def _total(self, **more: int) -> dict:
        return self.manifest.totals | {k: self.manifest.totals.get(k, 0) + n for k, n in more.items()}

    def _drop(self, pieces: list[Piece]) -> None:
        for p in pieces:
            path, fs = self._fs(self._path(p))
            fs.delete(path, True)

    def _path(self, p: Piece) -> str:
        return f"{self.root}/{'log' if p.level < 0 else 'files'}/{p.name}"

    def _described(self, name: str, level: int) -> Piece:
        probe = Piece(name, level, 0, 0, 0, 0, "", "")
        path, fs = self._fs(self._path(probe))
        r = self.spark.read.parquet(self._path(probe)).agg(F.count("*"), F.min("seq"), F.max("seq"), F.min("key"), F.max("key")).first()
        return Piece(name, level, r[0], fs.getContentSummary(path).getLength(), r[1] or 0, r[2] or 0, r[3] or "", r[4] or "")

    # Writing.

    def put_batch(self, rows: DataFrame) -> tuple[KvStore, DataFrame]:
        """Appends rows (key, value, and op where some are "DELETE", and seq where the order is the caller's) as one segment.

        Rows without a key, or with another op than PUT and DELETE, or a PUT without a value, are turned down. Returns
        the store and (accepted, rejected) as a row. Without seq, numbers ascend in the order of the frame's partitions.
        """
        op = F.upper(F.coalesce("op", F.lit("PUT"))) if "op" in rows.columns else F.lit("PUT")
        seq = F.col("seq").cast("long") if "seq" in rows.columns else F.lit(self.manifest.last_seq + 1) + F.monotonically_increasing_id()
        rows = rows.withColumns({"op": op, "seq": seq})
        good = F.coalesce(F.col("key").isNotNull() & F.col("seq").isNotNull() & ((F.col("op") == "DELETE") | (F.col("op") == "PUT") & F.col("value").isNotNull()), F.lit(False))
        name = uuid.uuid4().hex
        path = self._path(Piece(name, -1, 0, 0, 0, 0, "", ""))
        checked = rows.select("seq", "op", F.col("key").cast("string").alias("key"), F.when(F.col("op") == "PUT", F.col("value").cast("string")).alias("value"), good.alias("good"))
        # Read twice, the frame could number its rows differently, so the rejected ones are written, too, and left out when read.
        checked.withColumn("crc", row_crc()).write.parquet(path)
        written = self.spark.read.parquet(path)
        n, bad, first, last, low, high = written.agg(F.count_if("good"), F.count_if(~F.col("good")), *(f(F.when(F.col("good"), F.col(c))) for f, c in ((F.min, "seq"), (F.max, "seq"), (F.min, "key"), (F.max, "key")))).first()
        said = self.spark.createDataFrame([(n, bad)], "accepted long, rejected long")
        if n == 0:
            return self, said
        at, fs = self._fs(path)
        piece = Piece(name, -1, n, fs.getContentSummary(at).getLength(), first, last, low, high)
        totals = self._total(batches=1, rows_written=n, rows_rejected=bad, bytes_logged=piece.bytes)
        return self._commit(pieces=(*self.manifest.pieces, piece), last_seq=max(self.manifest.last_seq, last), totals=totals), said

    def is_full(self, rows: int = 1_000_000, bytes_: int = 64 << 20) -> bool:
        """Whether the log holds so much that it should be flushed."""
        return sum(p.rows for p in self.manifest.segments) >= rows or sum(p.bytes for p in self.manifest.segments) >= bytes_

    def _write_file(self, rows: DataFrame, level: int, keys: int) -> Piece:
        """The newest version of each key, by shard and sorted, with Bloom filters on the key."""
        newest = rows.groupBy("key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("v")).select("key", "v.*")
        name = uuid.uuid4().hex
        shard = F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")
        out = newest.withColumn("shard", shard).withColumn("crc", row_crc()).repartition("shard").sortWithinPartitions("shard", "key")
        out = out.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(max(1, -(-keys // self.shards))))
        out.partitionBy("shard").parquet(self._path(Piece(name, level, 0, 0, 0, 0, "", "")))
        return self._described(name, level)

    def flush(self) -> KvStore:
        """Turns the log into one level-0 file, and deletes its segments once that is committed. Corrupt rows fail the flush."""
        segments = self.manifest.segments
        if not segments:
            return self
        if bad := self.recover()[1]:
            raise ValueError(f"{bad} rows of the log fail their checksum")
        piece = self._write_file(self._log(), 0, sum(p.rows for p in segments))
        done = self._commit(pieces=(*self.manifest.files, piece), flushed_seq=max(p.last_seq for p in segments), totals=self._total(flushes=1, bytes_flushed=piece.bytes))
        self._drop(segments)
        return done

    def plan(self, strategy: str = "size_tiered", least: int = 4, growth: int = 4) -> list[Piece]:
        """The files to merge next, or none. "size_tiered": the first tier, by powers of `growth` of the bytes, with `least` files.
        "leveled": all of the lowest level with `least` files, and what overlaps them by key one level up. "adaptive": leveled
        where reads outweigh writes, as counted by record_reads(), else size-tiered."""
        files = self.manifest.files
        if strategy == "adaptive":
            strategy = "leveled" if self.manifest.totals.get("reads", 0) > self.manifest.totals.get("rows_written", 0) else "size_tiered"
        if strategy == "leveled":
            for level in sorted({p.level for p in files}):
                own = [p for p in files if p.level == level]
                if len(own) >= (least if level == 0 else least * growth**level):
                    low, high = min(p.low for p in own), max(p.high for p in own)
                    return own + [p for p in files if p.level == level + 1 and p.low <= high and p.high >= low]
            return []
        if strategy != "size_tiered":
            raise ValueError(f"no strategy {strategy!r}")
        tiers: dict[int, list[Piece]] = {}
        for p in files:
            tier, size = 0, max(p.bytes, 1)
            while size >= growth:
                tier, size = tier + 1, size // growth
            tiers.setdefault(tier, []).append(p)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= least), [])

    def compact(self, strategy: str = "size_tiered", least: int = 4, growth: int = 4) -> KvStore:
        """Merges the planned files into one of the next level. Deletes are dropped once no older piece can hold the key."""
        chosen = self.plan(strategy, least, growth)
        if len(chosen) < 2:
            return self
        rest = [p for p in self.manifest.files if p not in chosen]
        rows = self._read(chosen)
        if not any(p.first_seq <= max(c.last_seq for c in chosen) for p in [*rest, *self.manifest.segments]):
            keys = latest(rows).select("key")
            rows = rows.join(keys, "key", "left_semi")
        piece = self._write_file(rows, max(p.level for p in chosen) + 1, sum(p.rows for p in chosen))
        totals = self._total(compactions=1, files_merged=len(chosen), rows_dropped=sum(p.rows for p in chosen) - piece.rows, bytes_saved=max(0, sum(p.bytes for p in chosen) - piece.bytes))
        done = self._commit(pieces=(*rest, *self.manifest.segments, *([piece] if piece.rows else [])), totals=totals)
        self._drop(chosen)
        return done

    def truncate(self, seq: int) -> KvStore:
        """Drops segments that end at or before a sequence number that was flushed; others stay."""
        gone = [p for p in self.manifest.segments if p.last_seq <= min(seq, self.manifest.flushed_seq)]
        if not gone:
            return self
        done = self._commit(pieces=tuple(p for p in self.manifest.pieces if p not in gone))
        self._drop(gone)
        return done

    def rotate(self, most: int = 8) -> KvStore:
        """Joins the log's segments into one where there are more than `most`."""
        segments = self.manifest.segments
        if len(segments) <= most:
            return self
        name = uuid.uuid4().hex
        self._log().withColumns({"good": F.lit(True), "crc": row_crc()}).coalesce(max(1, self.shards)).write.parquet(self._path(Piece(name, -1, 0, 0, 0, 0, "", "")))
        done = self._commit(pieces=(*self.manifest.files, self._described(name, -1)), totals=self._total(rotations=1))
        self._drop(segments)
        return done

    def record_reads(self, reads: int) -> KvStore:
        return self._commit(totals=self._total(reads=reads))

    # Reading.

    def _log(self) -> DataFrame:
        paths = [self._path(p) for p in self.manifest.segments]
        if not paths:
            return self.spark.createDataFrame([], KV_LOG)
        return self.spark.read.parquet(*paths).where("good").select("seq", "op", "key", "value")

    def _read(self, files: list[Piece]) -> DataFrame:
        none = self.spark.createDataFrame([], f"{KV_LOG}, shard int")
        for p in files:
            none = none.unionByName(self.spark.read.parquet(self._path(p)).select("seq", "op", "key", "value", "shard"))
        return none

    def _versions(self, where: Column, low: str | None = None, high: str | None = None, shard: int | None = None) -> DataFrame:
        """What the log and the files that may hold the keys say of them; filters and shards reach the scans."""
        files = [p for p in self.manifest.files if (high is None or p.low <= high) and (low is None or p.high >= low)]
        found = self._read(files)
        if shard is not None:
            found = found.where(F.col("shard") == shard)
        return found.where(where).drop("shard").unionByName(self._log().where(where))

    def live(self) -> DataFrame:
        """(key, value, seq) of all live keys."""
        return latest(self._versions(F.lit(True)))

    def get(self, key: str) -> DataFrame:
        shard = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(key)), F.lit(self.shards)).cast("int")).first()[0]
        return latest(self._versions(F.col("key") == key, key, key, shard))

    def scan(self, start: str, end: str) -> DataFrame:
        """Live keys from start to end, both included, in order."""
        return latest(self._versions(F.col("key").between(start, end), start, end)).orderBy("key")

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """A row for each key asked for; value is null for those without a live version."""
        wanted = keys.select("key").distinct()
        return wanted.join(latest(self._versions(F.lit(True)).join(wanted, "key", "left_semi")), "key", "left")

    def recover(self, from_seq: int = 0) -> tuple[DataFrame, int]:
        """(rows of the log from a sequence number on whose checksum holds, number of others), as a replay after a crash needs them."""
        paths = [self._path(p) for p in self.manifest.segments]
        if not paths:
            return self._log(), 0
        rows = self.spark.read.parquet(*paths).where("good").where(F.col("seq") >= from_seq)
        holds = F.col("crc") == row_crc()
        return rows.where(holds).select("seq", "op", "key", "value"), rows.where(~F.coalesce(holds, F.lit(False))).count()

    def stats(self) -> DataFrame:
        """One row: live segments and files, their rows and bytes, and the totals of writes, flushes and compactions."""
        m = self.manifest
        names = ("batches", "rows_written", "rows_rejected", "flushes", "compactions", "files_merged", "rows_dropped", "reads")
        figures = {"version": m.version, "segments": len(m.segments), "files": len(m.files), "log_rows": sum(p.rows for p in m.segments), "file_rows": sum(p.rows for p in m.files)}
        figures |= {k: m.totals.get(k, 0) for k in names}
        return self.spark.createDataFrame([tuple(figures.values())], ", ".join(f"{k} long" for k in figures))
