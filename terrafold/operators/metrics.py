"""Evaluation: confusion, IoU and accuracy, clustering agreement, open-vocabulary and report metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import AMBIGUITY
from ..functions.numeric import EPS, cosine

SEGMENT = ["frame_id", "sp_id"]


def confusion(rows: DataFrame, classes: list[int], by: list[str] | None = None, other: int = -1) -> DataFrame:
    """(by.., gt, pred, n) over rows whose truth is one of ``classes``; predictions elsewhere count as ``other``, negative truths drop out."""
    by = by or []
    pred = F.when(F.col("pred").isin(classes), F.col("pred")).otherwise(other)
    return rows.where(F.col("gt").isin(classes) & (F.col("gt") >= 0)).groupBy(*by, "gt", pred.alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(hist: DataFrame, classes: list[int], by: list[str] | None = None) -> DataFrame:
    """Per class: IoU (null if union is empty) and accuracy (null without truth), in percent.

    A class's predictions count only where the truth is one of the classes.
    """
    by = by or []
    gt = hist.groupBy(*by, F.col("gt").alias("class_id")).agg(F.sum("n").alias("gt_sum"), F.sum(F.when(F.col("pred") == F.col("gt"), F.col("n")).otherwise(0)).alias("tp"))
    pred = hist.where(F.col("pred").isin(classes)).groupBy(*by, F.col("pred").alias("class_id")).agg(F.sum("n").alias("pred_sum"))
    keys = hist.select(*by).distinct() if by else hist.sparkSession.range(1).select()
    grid = keys.withColumn("class_id", F.explode(F.array(*[F.lit(c) for c in classes])))
    out = grid.join(gt, [*by, "class_id"], "left").join(pred, [*by, "class_id"], "left").fillna(0, ["gt_sum", "tp", "pred_sum"])
    union = F.col("gt_sum") + F.col("pred_sum") - F.col("tp")
    return out.withColumns({"iou": F.when(union > 0, 100.0 * F.col("tp") / union), "acc": F.when(F.col("gt_sum") > 0, 100.0 * F.col("tp") / F.col("gt_sum"))})


def summary_metrics(hist: DataFrame, classes: list[int], by: list[str] | None = None) -> DataFrame:
    """mIoU and mAcc over the classes that have them, and overall accuracy, in percent."""
    by = by or []
    per = class_metrics(hist, classes, by)
    oa = 100.0 * F.sum("tp") / F.greatest(F.sum("gt_sum"), F.lit(1))
    return per.groupBy(*by).agg(F.avg("iou").alias("miou"), F.avg("acc").alias("macc"), oa.alias("oa"))


def macro_iou(rows: DataFrame, void: int = 0, by: list[str] | None = None) -> DataFrame:
    """Accuracy and mean IoU over all classes of truth and prediction but void; rows of void truth drop out."""
    by = by or []
    known = rows.where(F.col("gt") != void)
    pairs = known.groupBy(*by, "gt", "pred").agg(F.count(F.lit(1)).alias("n"))
    gt = pairs.groupBy(*by, F.col("gt").alias("c")).agg(F.sum("n").alias("g"), F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    pred = pairs.groupBy(*by, F.col("pred").alias("c")).agg(F.sum("n").alias("p"))
    both = gt.join(pred, [*by, "c"], "full").fillna(0, ["g", "p", "tp"]).where(F.col("c") != void)
    total = pairs.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    iou = both.groupBy(*by).agg(F.avg(F.col("tp") / (F.col("g") + F.col("p") - F.col("tp"))).alias("miou"))
    joined = iou.join(total, by) if by else iou.crossJoin(total)
    return joined.select(*by, (F.col("hit") / F.col("n")).alias("acc"), "miou")


def agreement(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """NMI (arithmetic mean of entropies) and ARI of gt >= 0 against pred, from the confusion counts."""
    by = by or []
    n = rows.where(F.col("gt") >= 0).groupBy(*by, "gt", "pred").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("t"))
    with_total = lambda df: df.join(total, by) if by else df.crossJoin(total)
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    ent = lambda c: -F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))
    cell = with_total(n).groupBy(*by, "t").agg(ent("n").alias("h"), pairs("n").alias("i"))
    rows_ = with_total(n.groupBy(*by, "gt").agg(F.sum("n").alias("n"))).groupBy(*by).agg(ent("n").alias("hg"), pairs("n").alias("a"))
    cols_ = with_total(n.groupBy(*by, "pred").agg(F.sum("n").alias("n"))).groupBy(*by).agg(ent("n").alias("hp"), pairs("n").alias("b"))
    out = cell.join(rows_, by).join(cols_, by) if by else cell.crossJoin(rows_).crossJoin(cols_)
    mutual = F.col("hg") + F.col("hp") - F.col("h")
    mean_h = (F.col("hg") + F.col("hp")) / 2
    all_pairs = F.col("t") * (F.col("t") - 1) / 2
    expected = F.col("a") * F.col("b") / all_pairs
    limit = (F.col("a") + F.col("b")) / 2
    return out.select(*by, F.when(mean_h <= 0, 1.0).otherwise(mutual / mean_h).alias("nmi"), F.when(limit == expected, 1.0).otherwise((F.col("i") - expected) / (limit - expected)).alias("ari"))


def set_prf(predicted: DataFrame, truth: DataFrame, key: str = "class_id") -> DataFrame:
    """Precision, recall and F1 of sets of class ids per frame."""
    from .vocab import prf

    n = lambda df, name: df.select("frame_id", key).distinct().groupBy("frame_id").agg(F.count(F.lit(1)).alias(name))
    hits = predicted.select("frame_id", key).distinct().join(truth.select("frame_id", key).distinct(), ["frame_id", key])
    frames = predicted.select("frame_id").unionByName(truth.select("frame_id")).distinct()
    out = frames.join(n(predicted, "n_pred"), "frame_id", "left").join(n(truth, "n_gt"), "frame_id", "left").join(n(hits, "tp"), "frame_id", "left").fillna(0)
    return out.withColumns(prf(F.col("tp"), F.col("n_pred"), F.col("n_gt")))


def mapper_coverage(terms: DataFrame, by: list[str]) -> DataFrame:
    """Share of terms that map to a class."""
    return terms.groupBy(*by).agg(F.avg((F.col("class_id") > 0).cast("double")).alias("coverage"))


def ambiguity_accuracy(rows: DataFrame, classes: list[int], by: list[str] | None = None) -> DataFrame:
    """Accuracy over groups of easily confused classes; unknown classes are their own group."""
    table = F.create_map(*[x for k, v in AMBIGUITY.items() for x in (F.lit(k), F.lit(v))])
    group = lambda c: F.coalesce(table[F.col(c)], F.concat(F.lit("class_"), F.col(c).cast("string")))
    return rows.where(F.col("gt").isin(classes)).groupBy(*(by or [])).agg(F.avg((group("gt") == group("pred")).cast("double")).alias("accuracy"))


def topk_recall(points: DataFrame, topk: DataFrame, classes: list[int], k: int = 3) -> DataFrame:
    """Share of points of official truth whose class is among their segment's first k candidate classes (array ``classes``)."""
    hit = points.where(F.col("gt").isin(classes)).join(topk.select(*SEGMENT, F.slice("classes", 1, k).alias("first")), SEGMENT)
    return hit.groupBy("frame_id").agg(F.avg(F.array_contains("first", F.col("gt")).cast("double")).alias("recall"))


def oracle_substitution(points: DataFrame, topk: DataFrame, k: int) -> DataFrame:
    """Predictions replaced by the truth wherever it is among the first k candidate classes."""
    near = points.join(topk.select(*SEGMENT, F.slice("classes", 1, k).alias("first")), SEGMENT)
    return near.select("frame_id", "point_id", "gt", F.when(F.array_contains("first", F.col("gt")), F.col("gt")).otherwise(F.col("pred")).alias("pred"))


def delta_stats(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median (averaged), share above zero, least and largest of paired differences b - a."""
    d = F.col("b") - F.col("a")
    return pairs.withColumn("d", d).groupBy(*by).agg(F.avg("d").alias("mean"), F.median("d").alias("median"), F.avg((F.col("d") > 0).cast("double")).alias("win_rate"), F.min("d").alias("least"), F.max("d").alias("most"))


def report_means(report: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """Means per group; groups without values give 0.0."""
    return report.groupBy(*by).agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics], F.count(F.lit(1)).alias("frames"))


def domain_rollup(report: DataFrame, metrics: list[str], domain: Column) -> DataFrame:
    """Means per (domain, method), per domain and overall."""
    return report.withColumn("domain", domain).rollup("domain", "method").agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("frames"))


def weighted_mean(rows: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1))).alias(value))


def candidate_gap(prf: DataFrame, full: DataFrame, own: DataFrame) -> DataFrame:
    """Open-vocabulary summary: set metrics and what the full candidate list gains in ``miou`` over the generated one."""
    gap = full.select("frame_id", F.col("miou").alias("full_miou")).join(own.select("frame_id", "miou"), "frame_id")
    return prf.join(gap, "frame_id", "left").withColumn("candidate_gap", F.col("full_miou") - F.col("miou")).drop("full_miou", "miou")


def proxy_truth(candidates: DataFrame, predicted: DataFrame, extra: int = 4) -> DataFrame:
    """The first len(predicted) + ``extra`` candidates of each frame as its truth (frame_id, term)."""
    n = predicted.groupBy("frame_id").agg(F.countDistinct("term").alias("n"))
    w = Window.partitionBy("frame_id").orderBy("pos")
    return candidates.withColumn("r", F.row_number().over(w)).join(n, "frame_id").where(F.col("r") <= F.col("n") + extra).select("frame_id", "term")


def cosine_logits(items: DataFrame, texts: DataFrame, temperature: float = 0.07) -> DataFrame:
    """(id, term_idx, logit): cosine of every item with every text over the temperature; ``texts`` is a vocabulary."""
    return items.crossJoin(F.broadcast(texts)).select("id", "term_idx", (cosine(F.col("v"), F.col("text_v")) / temperature).alias("logit"))


def _softmax_sums(logits: DataFrame) -> DataFrame:
    top = logits.groupBy("id").agg(F.max("logit").alias("m"))
    e = F.exp(F.col("logit") - F.col("m"))
    s = logits.join(top, "id").groupBy("id").agg(F.first("m").alias("m"), F.sum(e).alias("s"), F.sum((F.col("logit") - F.col("m")) * e).alias("t"))
    return s.select("id", "m", (F.col("m") + F.log("s")).alias("lse"), (1 / F.col("s")).alias("conf"), (F.log("s") - F.col("t") / F.col("s")).alias("entropy"))


def similarity_loss(logits: DataFrame, target: DataFrame | None = None, least: float = 0.0, entropy_weight: float = 0.0, ignore: int = -100) -> DataFrame:
    """Cross entropy of logits (id, term_idx, logit), minus ``entropy_weight`` times the mean entropy: one row (ce, entropy, loss).

    Against ``target`` (id, index) but ``ignore``, or without it against the own argmax where the confidence reaches ``least``.
    """
    s = _softmax_sums(logits)
    if target is None:
        rows = s.select("id", "entropy", F.when(F.col("conf") >= least, F.col("lse") - F.col("m")).alias("ce"))
    else:
        own = logits.join(target.where(F.col("index") != ignore), "id").where(F.col("term_idx") == F.col("index")).select("id", F.col("logit").alias("own"))
        rows = s.join(own, "id", "left").select("id", "entropy", (F.col("lse") - F.col("own")).alias("ce"))
    ce = F.coalesce(F.avg("ce"), F.lit(0.0))
    return rows.agg(ce.alias("ce"), F.avg("entropy").alias("entropy"), (ce - entropy_weight * F.avg("entropy")).alias("loss"))


def smoothness_loss(edges: DataFrame, probs: DataFrame, geometry: DataFrame | None = None, columns: list[str] | None = None, sigma: float = 1.0) -> DataFrame:
    """Per frame the mean over edges of the squared distance of the ends' probabilities, weighed by exp(-squared geometric distance / sigma)."""
    a = probs.select("frame_id", F.col("sp_id").alias("src"), "term_idx", F.col("p").alias("ps"))
    b = probs.select("frame_id", F.col("sp_id").alias("dst"), "term_idx", F.col("p").alias("pd"))
    d = F.col("ps") - F.col("pd")
    per = edges.select("frame_id", "src", "dst").join(a, ["frame_id", "src"]).join(b, ["frame_id", "dst", "term_idx"]).groupBy("frame_id", "src", "dst").agg(F.sum(d * d).alias("d2"))
    if geometry is not None:
        from .geometry import with_ends

        columns = columns or ["cx", "cy", "cz"]
        far = F.lit(0.0)
        for c in columns:
            far = far + (F.col(f"{c}_s") - F.col(f"{c}_d")) * (F.col(f"{c}_s") - F.col(f"{c}_d"))
        per = with_ends(per, geometry, columns).withColumn("d2", F.col("d2") * F.exp(-far / max(sigma, EPS)))
    return per.groupBy("frame_id").agg(F.avg("d2").alias("smoothness"))


def similarity_report(similarities: DataFrame, predicted: DataFrame) -> DataFrame:
    """Mean cosine of the predicted text, mean best cosine and mean softmax entropy of predicted items: one row.

    ``similarities`` is (id, term_idx, logit) with plain cosines; ``predicted`` (id, index).
    """
    keep = predicted.where(F.col("index") >= 0)
    own = similarities.join(keep, "id").where(F.col("term_idx") == F.col("index")).select("id", F.col("logit").alias("own"))
    s = _softmax_sums(similarities.join(keep.select("id"), "id", "left_semi")).join(own, "id")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return s.agg(mean("own").alias("pred_cosine"), mean("m").alias("max_cosine"), mean("entropy").alias("entropy"))


def point_confidence(labels: DataFrame) -> DataFrame:
    """Point-weighted mean of sigmoid(mean score) x sigmoid(presence) per frame; ``labels`` has score, presence, n."""
    sig = lambda c: 1 / (1 + F.exp(-F.col(c)))
    return weighted_mean(labels.withColumn("confidence", sig("score") * sig("presence")), "confidence", "n", ["frame_id"])


def purity_mean(majorities: DataFrame) -> DataFrame:
    return majorities.groupBy("frame_id").agg(F.avg("purity").alias("purity"), F.count(F.lit(1)).alias("segments"))


def tokenisation_meta(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Per frame: points, segments, their ratio, and the share of segments seen by the camera."""
    n = points.groupBy("frame_id").agg(F.count(F.lit(1)).alias("points"))
    s = segments.groupBy("frame_id").agg(F.count(F.lit(1)).alias("segments"), F.avg(F.col("sp_valid").cast("double")).alias("coverage"))
    return n.join(s, "frame_id").withColumn("compression", F.col("points") / F.greatest("segments", F.lit(1)))


def ignore_ratio(rows: DataFrame, by: list[str]) -> DataFrame:
    """Shares of ignored and uncertain predictions and the mean entropy."""
    return rows.groupBy(*by).agg(F.avg((F.col("pred") == 0).cast("double")).alias("ignored"), F.avg(F.col("uncertain").cast("double")).alias("uncertain"), F.avg("entropy").alias("entropy"))


def cut_objective(labels: DataFrame, edges: DataFrame, silhouettes: DataFrame) -> DataFrame:
    """0.52 silhouette + 0.25 graph consistency + 0.16 balance + 0.07 complexity per frame and candidate labelling.

    ``labels`` is (frame_id, candidate, sp_id, label), ``edges`` undirected weights. One cluster has silhouette
    -1 and neither balance nor complexity; a cluster of one segment makes the silhouette -1. Consistency is one
    less the share of cut weight (0 without weight), balance one less the sizes' relative deviation.
    """
    key = ["frame_id", "candidate"]
    sizes = labels.groupBy(*key, "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    per = sizes.groupBy(*key).agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"), F.min("n").alias("least"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"))
    ends = edges.join(labels.select(*key, F.col("sp_id").alias("src"), F.col("label").alias("a")), ["frame_id", "src"]).join(labels.select(*key, F.col("sp_id").alias("dst"), F.col("label").alias("b")), [*key, "dst"])
    cut = ends.groupBy(*key).agg(F.sum("w").alias("weight"), F.sum(F.when(F.col("a") != F.col("b"), F.col("w")).otherwise(0.0)).alias("cut"))
    out = per.join(cut, key, "left").join(silhouettes, key, "left").fillna(0.0, ["cut", "weight"])
    many = F.col("k") > 1
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    sil = F.when(many & (F.col("least") >= 2), F.coalesce("silhouette", F.lit(-1.0))).otherwise(-1.0)
    balance = F.when(many, 1 - unit(F.col("std") / F.greatest("mean", F.lit(EPS)))).otherwise(0.0)
    complexity = F.when(many, F.log1p(F.col("k").cast("double")) / F.log1p(F.greatest(F.least(F.col("t"), F.lit(12.0)), F.lit(2.0)))).otherwise(0.0)
    whole = F.when(F.col("weight") <= 1e-8, 0.0).otherwise(1 - unit(F.col("cut") / F.col("weight")))
    return out.select(*key, sil.alias("silhouette"), whole.alias("consistency"), balance.alias("balance"), complexity.alias("complexity"), (0.52 * sil + 0.25 * whole + 0.16 * balance + 0.07 * complexity).alias("objective"))


def best_candidate(objectives: DataFrame) -> DataFrame:
    """The candidate of largest objective per frame, the first of equals."""
    return objectives.groupBy("frame_id").agg(F.max_by("candidate", F.struct("objective", -F.col("candidate"))).alias("candidate"), F.max("objective").alias("objective"))


def cube_means(report: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Mean and count of ``metric`` for every combination of ``keys``, totals (null keys) included; ``level`` tells them from null keys."""
    return report.cube(*keys).agg(F.avg(metric).alias("mean"), F.count(metric).alias("n"), F.grouping_id().cast("int").alias("level"))


def grouping_means(report: DataFrame, sets: list[list[str]], metric: str) -> DataFrame:
    """As ``cube_means`` for just these sets of keys."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return report.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.avg(metric).alias("mean"), F.count(metric).alias("n"))


def approximate(report: DataFrame, by: str, key: str, metric: str, error: float = 0.02) -> DataFrame:
    """Per group the approximate number of distinct keys and median, from mergeable sketches."""
    return report.groupBy(by).agg(F.approx_count_distinct(key, error).alias("keys"), F.percentile_approx(metric, 0.5, int(1 / error) * 10).alias("median"))
