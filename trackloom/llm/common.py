"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UNSET: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster.  Only where that is unset
    in local mode, as in tests, a temporary folder is made, once per session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share ({master})")
    app = spark.sparkContext.applicationId
    if app not in _UNSET:
        _UNSET[app] = "file://" + tempfile.mkdtemp(prefix="trackloom-")
        spark.sparkContext.setCheckpointDir(_UNSET[app])
    return _UNSET[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/trackloom/{name}-{uuid.uuid4().hex}"


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's JVM delete ``path`` (which exists) when it ends."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage the way a checkpoint does (a lost executor costs
    nothing: the files are in shared storage) but stays columnar, so later
    readers prune columns.  The files last as long as the driver.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    forget_at_exit(spark, path)
    # shuffle files of finished steps go when the driver's JVM collects garbage
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few bytes up to which a table is broadcast.
FEW_ROWS = 1_000_000


def if_small(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """``df``, which should be written already and have short rows, with a hint to broadcast
    it if it has at most ``rows`` of them; a larger one is joined by key."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
