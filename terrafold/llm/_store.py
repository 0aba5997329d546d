"""Shared scratch tables: written once under ``spark.checkpoint.dir`` and reread.

Executors may be lost at any time, so lineage is cut with tables in the folder
that the whole cluster shares, never with blocks kept on one executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Folder from ``spark.checkpoint.dir``; where that is unset in one process (tests), a folder of our own, on a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path that the JVM deletes when it exits."""
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _filesystem(spark, path)[0].deleteOnExit(_filesystem(spark, path)[1])
    return path


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def drop(spark: SparkSession, path: str) -> None:
    fs, hadoop = _filesystem(spark, path)
    fs.delete(hadoop, True)


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` once and return (the table reread, its path)."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Bytes of an Arrow batch on its way to Python: long texts must not add up to batches of hundreds of megabytes.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound this session's Arrow batches by bytes, where the session has Spark's own default."""
    if spark.conf.get(_BATCH_KEY) == f"{64 << 20}b":
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


#: A table of less than so many bytes a core may be a single row group, which one task would read and work on alone.
SMALL_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; one of few megabytes is dealt out to all cores, any other is read as its splits are."""
    bounded_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < SMALL_BYTES * cores else df
