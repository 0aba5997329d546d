"""Structured Streaming over arriving frames: per-frame labelling, windowed statistics, incremental histograms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import save_cache


def arriving(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """Frames as they land in a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def process_frames(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch operator to every micro-batch and replace just its frames, so a batch that runs twice writes the same."""

    def write(batch: DataFrame, _: int) -> None:
        save_cache(step(batch), out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_scores(stream: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Mean and number of scores per term and event-time window; rows later than ``late`` drop out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "term").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))


def frame_sessions(stream: DataFrame, gap: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """Flight sessions per scene: bursts of frames without a pause of ``gap``."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "scene").agg(F.count(F.lit(1)).alias("frames"))


def running_histogram(stream: DataFrame, classes: list[int]) -> DataFrame:
    """The confusion histogram so far; an aggregation that streams in update mode."""
    from ..operators.metrics import confusion

    return confusion(stream, classes)
