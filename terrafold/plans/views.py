"""The engine's tables as temporary views, for SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures as fx

VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "points": fx.points,
    "segments": fx.segmented,
    "raster": fx.raster,
    "raster_terms": fx.raster_terms,
    "evidence": fx.evidence,
    "captions": fx.captions,
    "term_classes": lambda spark, sf_dir: fx.mapping(spark),
}


def register_views(spark: SparkSession, sf_dir: str, prefix: str = "", names: tuple[str, ...] = tuple(VIEWS)) -> list[str]:
    """Register the tables as temporary views ``<prefix><name>``; they are plans, nothing is computed until a query asks."""
    for n in names:
        VIEWS[n](spark, sf_dir).createOrReplaceTempView(f"{prefix}{n}")
    return [f"{prefix}{n}" for n in names]
