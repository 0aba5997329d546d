"""The clean protocol as one plan: partition, project, lift, rank, map, label, evaluate.

Ground truth is read in the last step alone. The variants become rows of one long table, so all
(variant, mapper) pairs are evaluated by one aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import geometry, lifting, metrics, project, segment, vocab
from ..operators.lineage import small, written

VARIANTS = ("center", "mean", "q75", "top", "fixed_qfe", "rank_qfe", "equal_rank")


@dataclass
class Protocol:
    """What a run needs beside its tables."""

    classes: list[int]
    camera: dict
    target: int = 1200
    least_voxel: float = 0.8
    overshoot: float = 1.25
    variants: tuple[str, ...] = VARIANTS
    terms_key: list[str] = field(default_factory=lambda: ["term"])


def frame_tables(points: DataFrame, target: int, least: float = 0.8, overshoot: float = 1.25) -> tuple[DataFrame, DataFrame]:
    """Points with segments, and the segments with geometry: what every entry point starts from."""
    # the partition is a stage table, as every later stage reads it
    own = written(geometry.adaptive_partition(points, target, least, overshoot), "segments")
    return own, geometry.superpoint_geometry(own)


def lifted(points: DataFrame, raster: DataFrame, terms: DataFrame, priors: DataFrame, protocol: Protocol) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points with segments, evidence of all variants, segment validity).

    ``priors`` is ``(frame_id, term, term_idx, presence, caption_freq)``, one row a frame and term.
    """
    own, nodes = frame_tables(points, protocol.target, protocol.least_voxel, protocol.overshoot)
    w, h = protocol.camera["width"], protocol.camera["height"]
    seen = project.footprint(project.with_projection(own, **protocol.camera), w, h)
    at = nodes.select("frame_id", "sp_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    mids = project.footprint(project.with_projection(at, **protocol.camera), w, h)
    terms = small(terms)
    # points of a segment in one pixel have one score a term: pixels meet terms, not points
    pixels = seen.groupBy("frame_id", "sp_id", "keep", "row", "col").agg(F.count(F.lit(1)).alias("points"))
    samples = project.sample_pixels(pixels.crossJoin(terms), raster, protocol.terms_key)
    centers = project.sample_pixels(mids.crossJoin(terms), raster, protocol.terms_key).withColumnRenamed("score", "center")
    stats = lifting.evidence_stats(samples, centers.select("frame_id", "sp_id", "term", "term_idx", "center"), points="points")
    # eight decimals: ranks and ties do not follow the order in which sums were taken
    stats = stats.withColumns({c: F.rint(F.col(c) * 1e8) / 1e8 for c in ("center", "mean", "q75", "top")})
    return own, written(lifting.equal_rank(lifting.lift(stats), priors), "evidence"), lifting.footprint_validity(seen)


def evaluate(points: DataFrame, evidence: DataFrame, validity: DataFrame, mappers: DataFrame, protocol: Protocol) -> DataFrame:
    """(variant, mapper, miou, macc, oa); ``mappers`` is (mapper, term, class_id), ``points`` has the truth in ``gt``."""
    stacked = ", ".join(f"'{v}', {v}" for v in protocol.variants)
    long = evidence.selectExpr("frame_id", "sp_id", "term", f"stack({len(protocol.variants)}, {stacked}) AS (variant, score)")
    best = long.join(small(mappers.where(F.col("class_id").isin(protocol.classes))), "term").groupBy("frame_id", "sp_id", "variant", "mapper", "class_id").agg(F.max("score").alias("score"))
    place = F.array_position(F.array(*map(F.lit, protocol.classes)), F.col("class_id"))
    label = best.groupBy("frame_id", "sp_id", "variant", "mapper").agg(F.max_by("class_id", F.struct("score", -place)).alias("class_id"), F.max("score").alias("score"))
    label = label.join(validity.select("frame_id", "sp_id", "sp_valid"), ["frame_id", "sp_id"]).withColumn("pred", F.when(F.col("sp_valid") & (F.col("score") > -29.0), F.col("class_id")).otherwise(0))
    # truth by segment and class first: points never meet 21 methods each
    truth = points.groupBy("frame_id", "sp_id", "gt").agg(F.count(F.lit(1)).alias("points"))
    rows = truth.join(label.select("frame_id", "sp_id", "variant", "mapper", "pred"), ["frame_id", "sp_id"])
    pred = F.when(F.col("pred").isin(protocol.classes), F.col("pred")).otherwise(-1)
    hist = rows.where(F.col("gt").isin(protocol.classes)).groupBy("variant", "mapper", "gt", pred.alias("pred")).agg(F.sum("points").alias("n"))
    return metrics.summary_metrics(hist, protocol.classes, ["variant", "mapper"])


def verified_terms(evidence: DataFrame, validity: DataFrame, priors: DataFrame, value: str = "fixed_qfe") -> DataFrame:
    """(frame_id, term): the terms that score and verification keep of each frame."""
    own = evidence.join(validity.select("frame_id", "sp_id", F.col("sp_valid").alias("valid")), ["frame_id", "sp_id"])
    return vocab.verify_terms(vocab.score_terms(own, priors, value)).where("verified").select("frame_id", "term")


def label_points(points: DataFrame, evidence: DataFrame, validity: DataFrame, verified: DataFrame | None, value: str = "fixed_qfe") -> DataFrame:
    """The modular pipeline's last step: verified terms to segments to points."""
    scores = evidence.select("frame_id", "sp_id", "term", "term_idx", F.col(value).alias("score")).join(validity.select("frame_id", "sp_id", F.col("sp_valid").alias("valid")), ["frame_id", "sp_id"])
    return segment.expand_to_points(points.select("frame_id", "point_id", "sp_id"), segment.assign_labels(scores, verified))
