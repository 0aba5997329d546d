"""Evidence of terms on segments: statistics over a segment's pixels, blends of them, rank fusion.

``samples`` are rows ``(frame_id, sp_id, term, term_idx, score, keep)``, one a point and term;
``centers`` rows ``(frame_id, sp_id, term, term_idx, center)``, one a segment and term;
evidence is long: ``(frame_id, sp_id, term, term_idx, <values>)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import qfe, spfe

SEGMENT = ["frame_id", "sp_id"]
KEY = ["frame_id", "sp_id", "term", "term_idx"]


def evidence_stats(samples: DataFrame, centers: DataFrame, top_share: float | None = None, points: str | None = None) -> DataFrame:
    """center, mean, top and q75 of each segment and term over its kept points.

    ``points`` names a column that says for how many points a sample stands (points of one pixel are alike); ``top_share``
    needs a row a point.

    A segment without kept points has zeros; a frame without any has the centre everywhere. With
    ``top_share``, the mean of that share of the best scores is added as ``topk``.
    """
    s = F.when(F.col("keep"), F.col("score"))
    if points is None:
        agg = [F.count(s).alias("n"), F.avg(s).alias("mean"), F.max(s).alias("top"), F.percentile(s, F.lit(0.75)).alias("q75")]
    else:
        n = F.sum(F.when(F.col("keep"), F.col(points)))
        agg = [F.coalesce(n, F.lit(0)).alias("n"), (F.sum(s * F.col(points)) / n).alias("mean"), F.max(s).alias("top"), F.percentile(s, F.lit(0.75), F.col(points)).alias("q75")]
    stats = samples.groupBy(*KEY).agg(*agg)
    if top_share is not None:
        w = Window.partitionBy(*KEY)
        ranked = samples.where("keep").select(*KEY, "score", F.row_number().over(w.orderBy(F.col("score").desc())).alias("r"), F.count(F.lit(1)).over(w).alias("m"))
        best = ranked.where(F.col("r") <= F.greatest(F.lit(1.0), F.rint(F.col("m") * top_share))).groupBy(*KEY).agg(F.avg("score").alias("topk"))
        stats = stats.join(best, KEY, "left")
    seen = samples.groupBy("frame_id").agg(F.bool_or("keep").alias("any_kept"))
    out = centers.join(stats, KEY, "left").join(seen, "frame_id", "left")
    values = ["mean", "top", "q75"] + (["topk"] if top_share is not None else [])
    fixed = {v: F.when(F.coalesce("any_kept", F.lit(False)), F.coalesce(v, F.lit(0.0))).otherwise(F.col("center")) for v in values}
    return out.withColumns(fixed).select(*KEY, "center", *values, F.coalesce("n", F.lit(0)).alias("n"))


def variants(stats: DataFrame) -> DataFrame:
    """The fixed blends of evidence statistics (needs ``topk``)."""
    c, m, q, t, k = (F.col(x) for x in ("center", "mean", "q75", "top", "topk"))
    return stats.select(
        *KEY,
        "center",
        spfe(c, m, t).alias("spfe_default"),
        (0.65 * m + 0.35 * t).alias("spfe_meanmax"),
        (0.25 * c + 0.45 * m + 0.30 * k).alias("spfe_topk"),
        qfe(c, m, q, t).alias("spfe_quantile"),
    )


def footprint_or_center(stats: DataFrame, weights: tuple[float, float, float] = (0.35, 0.45, 0.20)) -> DataFrame:
    """Blend of centre, mean and top by normalised weights; segments without a footprint keep the centre."""
    total = sum(weights)
    a, b, c = (w / total for w in weights)
    return stats.select(*KEY, F.when(F.col("n") > 0, a * F.col("center") + b * F.col("mean") + c * F.col("top")).otherwise(F.col("center")).alias("score"))


def normalized_rank(value: str | Column, by: list[str]) -> Column:
    """1 - rank / (C - 1) in descending order within ``by``, ties to the smaller term_idx; 1.0 for a single term."""
    v = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    r = F.row_number().over(w.orderBy(v.desc(), "term_idx"))
    return F.when(n <= 1, 1.0).otherwise(1.0 - (r - 1) / (n - 1))


def rank_qfe(stats: DataFrame) -> DataFrame:
    """Mean of the normalised ranks of centre, mean, q75 and top: one exchange by segment, four sorts in it."""
    ranks = [normalized_rank(v, SEGMENT) for v in ("center", "mean", "q75", "top")]
    out = stats.withColumns({f"r{i}": r for i, r in enumerate(ranks)})
    return out.withColumn("rank_qfe", (F.col("r0") + F.col("r1") + F.col("r2") + F.col("r3")) / 4).drop("r0", "r1", "r2", "r3")


def lift(stats: DataFrame) -> DataFrame:
    """All evidence variants of the clean protocol in one table."""
    fixed = qfe(F.col("center"), F.col("mean"), F.col("q75"), F.col("top"))
    return rank_qfe(stats.withColumn("fixed_qfe", fixed))


def equal_rank(evidence: DataFrame, terms: DataFrame) -> DataFrame:
    """Mean of the ranks of rank_qfe (within a segment), presence and caption frequency (within a frame).

    ``terms`` is ``(frame_id, term, term_idx, presence, caption_freq)``, one row a frame and term.
    """
    ranked = terms.select("frame_id", "term_idx", normalized_rank("presence", ["frame_id"]).alias("rp"), normalized_rank("caption_freq", ["frame_id"]).alias("rc"))
    own = evidence.withColumn("rq", normalized_rank("rank_qfe", SEGMENT))
    return own.join(ranked, ["frame_id", "term_idx"]).withColumn("equal_rank", (F.col("rq") + F.col("rp") + F.col("rc")) / 3).drop("rq", "rp", "rc")


def footprint_validity(projected: DataFrame) -> DataFrame:
    """Per segment: any valid point, and the share of valid points."""
    return projected.groupBy(*SEGMENT).agg(F.bool_or("valid").alias("sp_valid"), F.avg(F.col("valid").cast("double")).alias("valid_ratio"))


def mask_area(raster: DataFrame, pixels: int) -> DataFrame:
    """Share of the image's ``pixels`` where a term scores above zero."""
    return raster.groupBy("frame_id", "term").agg((F.count(F.when(F.col("score") > 0, 1)) / pixels).alias("mask_area"))


def prompt_scores(maps: DataFrame) -> DataFrame:
    """Per pixel and term the best prompt's larger of (mask x object) and semantic score, times the term's presence.

    ``maps``: (frame_id, term, prompt, row, col, mask, object, semantic, presence); presence is the best prompt's, at least 1e-3.
    """
    seen = maps.groupBy("frame_id", "term").agg(F.greatest(F.max("presence"), F.lit(1e-3)).alias("presence"))
    best = maps.groupBy("frame_id", "term", "row", "col").agg(F.max(F.greatest(F.col("mask") * F.col("object"), F.col("semantic"))).alias("s"))
    return best.join(seen, ["frame_id", "term"]).select("frame_id", "term", "row", "col", (F.col("s") * F.col("presence")).alias("score"))
