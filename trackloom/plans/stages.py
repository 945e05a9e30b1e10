"""Stages: results kept in the shared folder, under a key of their parameters."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share ({master})")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="trackloom-")
    return _LOCAL[app]


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's JVM delete ``path`` (which exists) when it ends."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, outlives executors, ends with the driver."""
    path = f"{shared_folder(df.sparkSession)}/trackloom-stages/{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` with a hint to broadcast it if it has at most ``most`` rows; a larger side is joined by key."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def stage(spark: SparkSession, folder: str, name: str, params: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The stage ``name`` from ``folder`` if it was finished with the same parameters, else made and kept.

    The key hashes all parameters, so no stage of other parameters is taken for it.
    """
    key = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder}/{name}-{key}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
