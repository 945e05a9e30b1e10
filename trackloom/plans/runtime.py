"""What a session runs on: versions, cores, process; and how many tasks a shuffle has."""

from __future__ import annotations

import os
import platform

import numpy
import pyarrow
from pyspark.sql import SparkSession


def runtime_info(spark: SparkSession) -> dict[str, str | int]:
    return {"spark": spark.version, "python": platform.python_version(), "numpy": numpy.__version__, "pyarrow": pyarrow.__version__, "pid": os.getpid(), "threads": spark.sparkContext.defaultParallelism, "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions"))}


def set_threads(spark: SparkSession, n: int) -> int:
    """Tasks of a shuffle from now on (0: as many as there are cores); returns the number before."""
    before = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.shuffle.partitions", n or spark.sparkContext.defaultParallelism)
    return before
