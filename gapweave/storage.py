"""Tables that several branches of a plan read, written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


@cache
def _own() -> str:
    made = tempfile.mkdtemp(prefix="shared-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def base(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where driver and executors are one process, as in tests."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return _own()


def saved(df: DataFrame, tag: str) -> DataFrame:
    """The same rows, read from Parquet: lineage ends here, branches don't compute them anew, and lost executors lose nothing.

    A mounted folder is removed when the driver ends.
    """
    spark = df.sparkSession
    uri = f"{base(spark)}/{tag}-{uuid.uuid4().hex}"
    if (at := urlparse(uri)).scheme in ("", "file"):
        atexit.register(shutil.rmtree, at.path, ignore_errors=True)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)
