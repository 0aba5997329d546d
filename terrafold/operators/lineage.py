"""Cutting long plans with tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _root(spark) -> str:
    """The shared folder; where it is unset in one process (tests), a folder of our own, on a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
    return root.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and reread; the JVM deletes it when it exits."""
    spark = df.sparkSession
    path = f"{_root(spark)}/{tag}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table of a configuration's size: a vocabulary, a term map, a class list.
MOST_ROWS = 100_000


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows (they are counted), else as it is, for Spark to decide."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
