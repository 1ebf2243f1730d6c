"""Cuts of lineage that outlive lost executors: tables in the folder that the cluster names in spark.checkpoint.dir."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None
_written: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode, a temporary one of our own where the session names none;
    on a cluster that would be a folder of one machine, so there the session has to name one."""
    global _own_root
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own_root = _own_root or "file://" + tempfile.mkdtemp(prefix="weftgraph-")
    return _own_root


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; clear() deletes it."""
    _written.append(path := f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    return path


def written(df: DataFrame, name: str, compression: str = "snappy", **options) -> DataFrame:
    """df, written as Parquet in the shared folder, with the writer's options, and read again."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes what this process wrote by fresh_path() and written(), once its results are no longer read; says how many tables."""
    done = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return done
