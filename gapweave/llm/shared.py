"""Folders that driver and executors share, and settings that every operator needs."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
#: Used only where the session names no shared folder and driver and executors are one process, as in tests.
FALLBACK = "file:///tmp/checkpoints"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep the session's Arrow batches small enough for long texts."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def local_path(uri: str) -> str:
    """The path of a ``file:`` URI; hashed arrays are memory-mapped, so the shared folder has to be mounted."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"the shared folder has to be mounted on every node to be memory-mapped, but it is {uri}")
    return parsed.path


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder (URI) under ``spark.checkpoint.dir``; removed when the driver ends, if it is mounted there."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = FALLBACK
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(base)
    uri = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    if urlparse(uri).scheme in ("", "file"):
        atexit.register(shutil.rmtree, local_path(uri), ignore_errors=True)
    return uri


def drop(spark: SparkSession, uri: str) -> None:
    """Delete a folder that no later plan reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df, uri: str):
    """Write a table to the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def integer_id(df, id_col: str) -> None:
    """An error, before any job, where ids are not integers: they are compared, mixed and stored as 64-bit ones."""
    kind = df.schema[id_col].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} has to be an integer column, but it is {kind}")


def buckets(spark: SparkSession) -> int:
    """Bits of a hash that choose its shard: twice as many shards as shuffle partitions, 64 to 65,536."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(16, max(6, (2 * n - 1).bit_length()))


def shard_bits(docs) -> int:
    """Bits of a hash that choose a shard, where shards send to shards: one for each 16 MB of the input, 64 to 65,536.

    By the input's size and not by the number of tasks, as what all shards send to all is the
    square of their number.  The size is the optimizer's; where it knows none (rows that the driver made), 64 stand.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 6 if size >= 1 << 60 else min(16, max(6, (size // (16 << 20)).bit_length()))
