"""Labels from evidence: masking, argmax, classes and families, confidence, calibration, routing.

Scores are long rows ``(frame_id, sp_id, term, term_idx, score)`` with an optional ``valid`` flag per segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import FAMILIES
from ..functions.numeric import EPS, MASKED
from ..functions.text import simple_clean

SEGMENT = ["frame_id", "sp_id"]


def argmax(scores: DataFrame, value: str = "score", keep: tuple[str, ...] = ("term", "term_idx"), by: list[str] | None = None, order: str = "term_idx") -> DataFrame:
    """The first best row of each segment, by aggregation (no sort of all terms)."""
    by = SEGMENT if by is None else by
    best = scores.groupBy(*by).agg(F.max_by(F.struct(*keep, F.col(value).alias("best")), F.struct(F.col(value), -F.col(order))).alias("b"))
    return best.select(*by, *[F.col(f"b.{k}").alias(k) for k in keep], F.col("b.best").alias(value))


def assign_labels(scores: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """The best verified term of each segment.

    Without verified terms (or where a frame has none) all count; other terms and invalid segments
    score -30, so an invalid segment gets the first term.
    """
    if verified is not None:
        marked = verified.select("frame_id", "term").distinct().withColumn("ok", F.lit(True))
        any_ok = marked.select("frame_id").distinct().withColumn("routed", F.lit(True))
        scores = scores.join(marked, ["frame_id", "term"], "left").join(any_ok, "frame_id", "left")
        score = F.when(F.coalesce("routed", F.lit(False)) & ~F.coalesce("ok", F.lit(False)), MASKED).otherwise(F.col("score"))
        scores = scores.withColumn("score", score).drop("ok", "routed")
    return argmax(scores.withColumn("score", F.when(F.col("valid"), F.col("score")).otherwise(MASKED)))


def expand_to_points(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Segment labels on their points: a many-to-one equi-join."""
    return points.join(labels, SEGMENT)


def top_k(scores: DataFrame, k: int = 5, value: str = "score") -> DataFrame:
    """The k best terms of each segment in order, as an array; invalid segments count as all -30."""
    v = F.when(F.col("valid"), F.col(value)).otherwise(MASKED)
    w = Window.partitionBy(*SEGMENT).orderBy(v.desc(), "term_idx")
    best = scores.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return best.groupBy(*SEGMENT).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda s: s["term"]).alias("terms"))


def class_collapse(scores: DataFrame, mapping: DataFrame, classes: list[int], value: str = "score") -> DataFrame:
    """The best score of the terms of each class; classes without terms score -30. One row a segment and class."""
    known = scores.join(F.broadcast(mapping.select("term", "class_id")), "term").where(F.col("class_id").isin(classes))
    best = known.groupBy(*SEGMENT, "class_id").agg(F.max(value).alias(value))
    grid = scores.select(*SEGMENT).distinct().withColumn("c", F.explode(F.array(*[F.struct(F.lit(i).alias("class_idx"), F.lit(c).alias("class_id")) for i, c in enumerate(classes)]))).select(*SEGMENT, "c.*")
    return grid.join(best, [*SEGMENT, "class_id"], "left").fillna(MASKED, [value])


def class_argmax(collapsed: DataFrame, valid: DataFrame, value: str = "score") -> DataFrame:
    """The best class of each segment; 0 for invalid ones and where nothing scores above -29."""
    best = argmax(collapsed, value, ("class_id", "class_idx"), order="class_idx").join(valid, SEGMENT)
    return best.select(*SEGMENT, F.when(F.col("valid") & (F.col(value) > -29.0), F.col("class_id")).otherwise(0).alias("class_id"))


def family(term: Column) -> Column:
    """The first coarse family whose name equals the term, or one of whose aliases equals, contains or is part of it."""
    clean = simple_clean(term)
    out = F.lit(None).cast("string")
    for name, aliases in reversed(FAMILIES.items()):
        hit = clean == name
        for a in aliases:
            hit = hit | clean.contains(a) | F.lit(a).contains(clean)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return F.coalesce(out, clean)


def coarsen(scores: DataFrame) -> DataFrame:
    """The best score of each family, families numbered by their first term."""
    names = scores.select("term", "term_idx").distinct().withColumn("family", family(F.col("term")))
    ids = names.groupBy("family").agg(F.min("term_idx").alias("family_idx"))
    named = scores.join(F.broadcast(names.join(ids, "family").drop("term_idx")), "term")
    return named.groupBy(*SEGMENT, "family", "family_idx").agg(F.max("score").alias("score"))


def softmax_stats(scores: DataFrame, value: str = "score") -> DataFrame:
    """Per segment: confidence, margin of the two best, normalised entropy, and whether that is above 0.9.

    With m the largest score and S = sum exp(v - m), the entropy is ln S - sum (v - m) exp(v - m) / S.
    """
    v = F.col(value)
    top = scores.groupBy(*SEGMENT).agg(F.max(v).alias("m"))
    e = F.exp(v - F.col("m"))
    agg = scores.join(top, SEGMENT).groupBy(*SEGMENT).agg(
        F.first("m").alias("m"),
        F.count(F.lit(1)).alias("c"),
        F.sum(e).alias("s"),
        F.sum((v - F.col("m")) * e).alias("t"),
        F.slice(F.sort_array(F.collect_list(v), asc=False), 1, 2).alias("two"),
    )
    second = F.coalesce(F.try_element_at("two", F.lit(2)), F.col("m") - 1e9)
    entropy = (F.log("s") - F.col("t") / F.col("s")) / F.greatest(F.log(F.greatest(F.col("c"), F.lit(2)).cast("double")), F.lit(EPS))
    return agg.select(*SEGMENT, (1 / F.col("s")).alias("confidence"), ((1 - F.exp(second - F.col("m"))) / F.col("s")).alias("margin"), entropy.alias("entropy"), (entropy > 0.9).alias("uncertain"))


def confidence_mask(scores: DataFrame, least: float) -> DataFrame:
    """Segments whose best softmax reaches ``least``."""
    return softmax_stats(scores).select(*SEGMENT, (F.col("confidence") >= least).alias("confident"))


def guarded_prediction(base: DataFrame, refined: DataFrame, valid: DataFrame, least: float = 0.68, margin: float = 0.08, gain: float = 0.02) -> DataFrame:
    """The refined label only where the base is unsure and the refined is surer by ``gain``; invalid segments get 0."""
    side = lambda s, p: argmax(s).select(*SEGMENT, F.col("term_idx").alias(f"{p}_idx")).join(softmax_stats(s).select(*SEGMENT, F.col("confidence").alias(f"{p}_conf"), F.col("margin").alias(f"{p}_margin")), SEGMENT)
    both = side(base, "base").join(side(refined, "fine"), SEGMENT).join(valid, SEGMENT)
    take = ((F.col("base_conf") < least) | (F.col("base_margin") < margin)) & (F.col("fine_conf") >= F.col("base_conf") + gain)
    return both.select(*SEGMENT, F.when(~F.col("valid"), 0).when(take, F.col("fine_idx")).otherwise(F.col("base_idx")).alias("term_idx"))


def hybrid_prediction(points: DataFrame, segments: DataFrame, least: float, margin: float) -> DataFrame:
    """A point's own label where it is sure enough, else its segment's."""
    own = (F.col("point_conf") >= least) & (F.col("point_margin") >= margin)
    return points.join(segments.select(*SEGMENT, F.col("label").alias("sp_label")), SEGMENT).select("frame_id", "point_id", F.when(own, F.col("point_label")).otherwise(F.col("sp_label")).alias("label"))


def balance(scores: DataFrame, mode: str) -> DataFrame:
    """Scores of valid segments without their term's frame-wide bias; invalid ones -30.

    Modes: mean, median (the lower one), halfmean, zscore (sample deviation), robustz (1.4826 x MAD).
    Frames without a valid segment keep their scores.
    """
    by = ["frame_id", "term_idx"]
    v = F.col("score")
    lower = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})")
    ok = scores.where("valid")
    if mode in ("mean", "halfmean", "zscore"):
        bias = ok.groupBy(*by).agg(F.avg(v).alias("b"), F.greatest(F.coalesce(F.stddev_samp(v), F.lit(0.0)), F.lit(EPS)).alias("d"))
    elif mode in ("median", "robustz"):
        bias = ok.groupBy(*by).agg(lower("score").alias("b")).withColumn("d", F.lit(1.0))
        if mode == "robustz":
            mad = ok.join(bias.drop("d"), by).withColumn("e", F.abs(v - F.col("b"))).groupBy(*by).agg(F.greatest(lower("e"), F.lit(EPS)).alias("d"))
            bias = bias.drop("d").join(mad.withColumn("d", 1.4826 * F.col("d")), by)
    else:
        raise ValueError(f"unknown mode: {mode}")
    shift = {"mean": v - F.col("b"), "median": v - F.col("b"), "halfmean": v - 0.5 * F.col("b")}.get(mode, (v - F.col("b")) / F.col("d"))
    out = scores.join(bias, by, "left")
    # a frame without valid segments has no bias row
    return out.withColumn("score", F.when(F.col("b").isNull(), v).when(F.col("valid"), shift).otherwise(MASKED)).drop("b", "d")


def prune_names(scores: DataFrame, penalty: float = 0.35) -> DataFrame:
    """A penalty on terms named after shadows, harbors and bridges."""
    return scores.withColumn("score", F.when(F.lower("term").rlike("shadow|harbor|bridge"), F.col("score") - penalty).otherwise(F.col("score")))


def _salience(scores: DataFrame) -> DataFrame:
    v = F.col("score")
    return scores.where("valid").groupBy("frame_id", "term", "term_idx").agg((0.65 * F.max(v) + 0.35 * F.avg(v)).alias("salience"), (0.55 * F.max(v) + 0.30 * F.avg(v) + 0.15 * F.percentile(v, F.lit(0.75))).alias("support"))


def salience(scores: DataFrame) -> DataFrame:
    """Per frame and term over valid segments: routing salience and selection support."""
    return _salience(scores)


def _force(kept: DataFrame, ranked: DataFrame, background: int) -> DataFrame:
    """Terms kept by rank, the last of them replaced by the background term where that is missing."""
    frames = kept.groupBy("frame_id").agg(F.max("r").alias("last"), F.bool_or(F.col("term_idx") == background).alias("has"))
    out = kept.join(frames, "frame_id").where(F.col("has") | (F.col("r") < F.col("last"))).select("frame_id", "term_idx")
    forced = ranked.where(F.col("term_idx") == background).select("frame_id", "term_idx")
    return out.unionByName(forced).distinct()


def route(scores: DataFrame, mode: str = "top10", background: int | None = 0) -> DataFrame:
    """Scores with the terms a scene does not support at -30 (invalid segments too).

    Modes: ``topN``; ``compact`` (6); ``adaptive``: salience z score >= -0.1, clamped to 5..10 terms.
    ``background`` is always kept, in place of the last kept term. A scene with no more than N
    terms is left alone under ``topN``, as is one without valid segments.
    """
    s = _salience(scores)
    w = Window.partitionBy("frame_id")
    ranked = s.withColumns({"r": F.row_number().over(w.orderBy(F.col("salience").desc(), "term_idx")), "c": F.count(F.lit(1)).over(w)})
    if mode == "adaptive":
        z = (F.col("salience") - F.avg("salience").over(w)) / F.greatest(F.coalesce(F.stddev_samp("salience").over(w), F.lit(0.0)), F.lit(EPS))
        ranked = ranked.withColumn("ok", (z >= -0.10).cast("int"))
        n = F.sum("ok").over(w)
        # z falls with the rank, so a threshold on z is a prefix of the order
        k = F.greatest(F.least(n, F.lit(10)), F.lit(5))
    else:
        k = F.lit({"compact": 6}.get(mode) or int(mode.removeprefix("top")))
    kept = ranked.withColumn("k", k).where((F.col("r") <= F.col("k")))
    if background is not None:
        kept_terms = _force(kept.select("frame_id", "term_idx", "r"), ranked, background)
    else:
        kept_terms = kept.select("frame_id", "term_idx")
    if mode.startswith("top"):
        small = ranked.where(F.col("c") <= int(mode.removeprefix("top"))).select("frame_id", "term_idx")
        kept_terms = kept_terms.unionByName(small).distinct()
    active = s.select("frame_id").distinct().withColumn("active", F.lit(True))
    out = scores.join(kept_terms.withColumn("kept", F.lit(True)), ["frame_id", "term_idx"], "left").join(active, "frame_id", "left")
    off = F.coalesce("active", F.lit(False)) & (~F.coalesce("kept", F.lit(False)) | ~F.col("valid"))
    if mode.startswith("top"):
        all_terms = ranked.select("frame_id", (F.col("c") <= int(mode.removeprefix("top"))).alias("few")).distinct()
        out = out.join(all_terms, "frame_id", "left")
        off = off & ~F.coalesce("few", F.lit(False))
        return out.withColumn("score", F.when(off, MASKED).otherwise(F.col("score"))).drop("kept", "active", "few")
    return out.withColumn("score", F.when(off, MASKED).otherwise(F.col("score"))).drop("kept", "active")


def select_terms(scores: DataFrame, caption_terms: DataFrame, k: int, bonus: float = 0.35) -> DataFrame:
    """The k best terms of a frame by support, plus ``bonus`` for terms of its captions: (frame_id, term, term_idx, score, rank)."""
    s = _salience(scores).join(caption_terms.select("frame_id", "term").distinct().withColumn("said", F.lit(1.0)), ["frame_id", "term"], "left")
    total = F.col("support") + bonus * F.coalesce("said", F.lit(0.0))
    w = Window.partitionBy("frame_id").orderBy(F.col("score").desc(), "term_idx")
    return s.withColumn("score", total).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("frame_id", "term", "term_idx", "score", "rank")


def ontology_prior(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """What colour, height and shape suggest for each term, centred per segment: (frame_id, sp_id, term, term_idx, prior).

    ``segments`` has cz, mean_r, mean_g, mean_b (0..1), log_n, linearity, planarity, scattering.
    """
    from .geometry import robust_min_max

    r, g, b = F.col("mean_r"), F.col("mean_g"), F.col("mean_b")
    mean = (r + g + b) / 3
    std = F.sqrt(((r - mean) * (r - mean) + (g - mean) * (g - mean) + (b - mean) * (b - mean)) / 2)
    df = segments.withColumns({
        "height": F.col("cz"), "green": g - 0.5 * (r + b), "blue": b - 0.5 * (r + g), "bright": mean, "spread": std,
        "brown": 0.55 * r + 0.35 * g - 0.45 * b, "saturation": F.greatest(r, g, b) - F.least(r, g, b), "count": F.col("log_n"),
    })
    df = robust_min_max(df, ["height", "green", "blue", "bright", "spread", "brown", "saturation", "count"])
    x = {c: F.col(c) for c in ("height", "green", "blue", "brown", "saturation")} | {c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) for c in ("linearity", "planarity", "scattering")}
    x |= {"low": 1 - F.col("height"), "dark": 1 - F.col("bright"), "gray": 1 - F.col("spread"), "small": 1 - F.col("count")}
    rows = F.col("term")
    out = F.lit(0.0)
    for words, parts in reversed(_PRIORS):
        value = F.lit(0.0)
        for name, weight in parts.items():
            value = value + weight * x[name]
        out = F.when(F.lower(rows).rlike("|".join(words)), value).otherwise(out)
    long = df.crossJoin(F.broadcast(terms.select("term", "term_idx"))).withColumn("p", out)
    center = F.avg("p").over(Window.partitionBy(*SEGMENT))
    return long.select(*SEGMENT, "term", "term_idx", (F.col("p") - center).alias("prior"))


# Weights of the ontology prior, first matching row wins.
_PRIORS = [
    (("vegetation", "tree", "forest"), {"green": 1.25, "scattering": 0.45, "height": 0.20, "gray": -0.25}),
    (("grass", "farmland", "crop"), {"green": 1.05, "low": 0.55, "planarity": 0.25}),
    (("road", "airport", "parking", "runway"), {"low": 0.85, "planarity": 0.65, "gray": 0.40, "green": -0.35}),
    (("bare", "soil", "ground"), {"low": 0.75, "brown": 0.45, "scattering": 0.25, "green": -0.20}),
    (("building", "roof", "house"), {"height": 0.75, "planarity": 0.75, "gray": 0.35, "green": -0.35}),
    (("vehicle", "car", "truck"), {"small": 0.45, "saturation": 0.40, "planarity": 0.25, "low": 0.15}),
    (("water", "river", "sea"), {"blue": 0.75, "dark": 0.50, "low": 0.35}),
    (("terrain", "hillside", "mountain"), {"height": 0.45, "brown": 0.35, "scattering": 0.35}),
    (("shadow",), {"dark": 0.90}),
    (("wall", "fence"), {"linearity": 0.45, "height": 0.30, "small": 0.25}),
    (("bridge", "harbor", "ship"), {"planarity": 0.30, "height": 0.25, "saturation": 0.20}),
]


def calibrate(scores: DataFrame, prior: DataFrame, strength: float) -> DataFrame:
    """Scores plus ``strength`` times the prior."""
    return scores.join(prior.select(*SEGMENT, "term_idx", "prior"), [*SEGMENT, "term_idx"]).withColumn("score", F.col("score") + strength * F.col("prior")).drop("prior")
