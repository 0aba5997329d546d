"""End-to-end plans over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import qfe
from ..operators import metrics, segment, vocab
from . import fixtures as fx
from . import pipeline
from .fixtures import q6 as r6
from .geometry_queries import rounded
from .registry import query

_CLASS_OF = "CASE term WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END"


def labelled(spark, sf):
    """Points labelled by the best fixed blend of their segment: the minimum slice, end to end."""
    stats = fx.stats(spark, sf)
    blend = F.rint(qfe(F.col("center"), F.col("mean"), F.col("q75"), F.col("top")) * 1e9)
    labels = segment.assign_labels(stats.select("frame_id", "sp_id", "term", "term_idx", blend.alias("score"), (F.col("n") > 0).alias("valid")))
    points = fx.segmented(spark, sf).select("frame_id", "point_id", "sp_id", (F.col("label") % 5 + 1).alias("gt"))
    return segment.expand_to_points(points, labels.select("frame_id", "sp_id", (F.col("term_idx") + 1).alias("pred")))


_FLOW = f"""WITH {fx.STATS}, s AS (SELECT frame_id, sp_id, term_idx, CASE WHEN n > 0 THEN round_even((0.20 * center + 0.45 * mean + 0.25 * q75 + 0.10 * top) * 1e9, 0) ELSE -30 END AS score FROM stats),
lab AS (SELECT frame_id, sp_id, term_idx + 1 AS pred FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, sp_id ORDER BY score DESC, term_idx) AS r FROM s) WHERE r = 1),
rows AS (SELECT frame_id, point_id, label % 5 + 1 AS gt, pred FROM sp JOIN lab USING (frame_id, sp_id)), hist AS (SELECT gt, pred, count(*) AS n FROM rows GROUP BY ALL),
per AS (SELECT c, coalesce(g, 0) AS g, coalesce(tp, 0) AS tp, coalesce(p, 0) AS p FROM (SELECT unnest(range(1, 6)) AS c) LEFT JOIN (SELECT gt AS c, sum(n) AS g, sum(CASE WHEN gt = pred THEN n ELSE 0 END) AS tp FROM hist GROUP BY ALL) USING (c) LEFT JOIN (SELECT pred AS c, sum(n) AS p FROM hist GROUP BY ALL) USING (c))
SELECT {r6('avg(CASE WHEN g + p - tp > 0 THEN 100 * tp / (g + p - tp) END)')} AS miou, {r6('avg(CASE WHEN g > 0 THEN 100 * tp / g END)')} AS macc, {r6('100 * sum(tp) / greatest(sum(g), 1)')} AS oa FROM per"""


@query(_FLOW)
def end_to_end_miou(spark, sf):
    hist = metrics.confusion(labelled(spark, sf), [1, 2, 3, 4, 5])
    return rounded(metrics.summary_metrics(hist, [1, 2, 3, 4, 5]), "miou", "macc", "oa")


def _priors(points, maps, terms):
    """(frame_id, term, term_idx, presence, caption_freq): a term's high raster score, and its share of the names that stand for a frame's caption."""
    presence = maps.groupBy("term").agg(F.percentile("score", F.lit(0.95)).alias("presence"))
    names = points.select("frame_id", F.floor(F.least("r", "b") / 32).cast("int").alias("term_idx")).join(F.broadcast(terms), "term_idx", "left").select("frame_id", "term")
    candidates = points.select("frame_id").distinct().crossJoin(F.broadcast(terms)).join(F.broadcast(presence), "term")
    return vocab.caption_frequency(names, candidates)


def _nearest_classes(spark, sf, terms):
    """(term, class_id): the class whose vector is most like the term's; terms and classes have the vectors of ten labels."""
    v = fx.prototypes(spark, sf)
    items = terms.join(v, "term_idx").select(F.col("term").alias("id"), "text_v")
    classes = v.where("term_idx BETWEEN 5 AND 9").select((F.col("term_idx") - 5).alias("place"), (F.col("term_idx") - 4).cast("int").alias("class_id"), F.col("text_v").alias("v"))
    return vocab.nearest_label(items, classes, "text_v", -1.0).select(F.col("id").alias("term"), "class_id")


def _rank(v: str, by: str = "frame_id, sp_id") -> str:
    return f"(CASE WHEN count(*) OVER (PARTITION BY {by}) <= 1 THEN 1::DOUBLE ELSE 1 - (row_number() OVER (PARTITION BY {by} ORDER BY {v} DESC, term_idx) - 1) / (count(*) OVER (PARTITION BY {by}) - 1)::DOUBLE END)"


_LIFTED = f"""WITH {fx.STATS.replace(fx.segmented_sql(), fx.adaptive_sql(120))},
exact AS MATERIALIZED (SELECT frame_id, sp_id, term, term_idx, {', '.join(f'round_even({c} * 1e8, 0) / 1e8 AS {c}' for c in ('center', 'mean', 'q75', 'top'))} FROM stats),
blended AS (SELECT *, 0.20::DOUBLE * center + 0.45::DOUBLE * mean + 0.25::DOUBLE * q75 + 0.10::DOUBLE * top AS fixed_qfe, ({' + '.join(_rank(c) for c in ('center', 'mean', 'q75', 'top'))}) / 4 AS rank_qfe FROM exact),
presence AS (SELECT term, quantile_cont(score, 0.95) AS presence FROM raster GROUP BY ALL), said AS (SELECT frame_id, t.term FROM (SELECT frame_id, floor(least(r, b) / 32)::INTEGER AS i FROM points) p LEFT JOIN terms t ON t.term_idx = i),
priors AS MATERIALIZED (SELECT f.frame_id, t.term, t.term_idx, p.presence, coalesce(n, 0) / greatest(total, 1)::DOUBLE AS caption_freq FROM (SELECT frame_id, count(*) AS total FROM said GROUP BY ALL) f CROSS JOIN terms t JOIN presence p USING (term) LEFT JOIN (SELECT frame_id, term, count(*) AS n FROM said GROUP BY ALL) s ON s.frame_id = f.frame_id AND s.term = t.term),
prior_ranks AS (SELECT frame_id, term_idx, {_rank('presence', 'frame_id')} AS rp, {_rank('caption_freq', 'frame_id')} AS rc FROM priors),
lifted AS MATERIALIZED (SELECT b.*, ({_rank('rank_qfe')} + rp + rc) / 3 AS equal_rank FROM blended b JOIN prior_ranks USING (frame_id, term_idx)),
validity AS MATERIALIZED (SELECT frame_id, sp_id, bool_or(valid) AS valid FROM foot GROUP BY ALL)"""

_CLEAN = f"""{_LIFTED}, {fx.PROTOTYPES}, near AS (SELECT t.term_idx, l.term_idx - 4 AS class_id, sum(t.p * l.p) / greatest(sqrt(sum(t.p * t.p)) * sqrt(sum(l.p * l.p)), 1e-12) AS s FROM proto t JOIN proto l USING (i) WHERE t.term_idx < 5 AND l.term_idx BETWEEN 5 AND 9 GROUP BY ALL),
mappers AS (SELECT 'rule' AS mapper, term, term_idx + 1 AS class_id FROM terms UNION ALL SELECT 'shifted', term, (term_idx + 1) % 5 + 1 FROM terms UNION ALL SELECT 'nearest', term, class_id FROM terms JOIN (SELECT *, row_number() OVER (PARTITION BY term_idx ORDER BY s DESC, class_id) AS r FROM near) USING (term_idx) WHERE r = 1),
long_form AS ({' UNION ALL '.join(f"SELECT frame_id, sp_id, term, '{v}' AS variant, {v} AS score FROM lifted" for v in pipeline.VARIANTS)}),
by_class AS (SELECT frame_id, sp_id, variant, mapper, class_id, max(score) AS score FROM long_form JOIN mappers USING (term) WHERE class_id BETWEEN 1 AND 5 GROUP BY ALL),
labels AS (SELECT frame_id, sp_id, variant, mapper, CASE WHEN valid AND score > -29 THEN class_id ELSE 0 END AS pred FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, sp_id, variant, mapper ORDER BY score DESC, class_id) AS r FROM by_class) JOIN validity USING (frame_id, sp_id) WHERE r = 1),
truth AS (SELECT frame_id, sp_id, label % 5 + 1 AS gt, count(*) AS n FROM sp GROUP BY ALL), hist AS (SELECT variant, mapper, gt, CASE WHEN pred BETWEEN 1 AND 5 THEN pred ELSE -1 END AS pred, sum(n) AS n FROM truth JOIN labels USING (frame_id, sp_id) GROUP BY ALL),
per AS (SELECT k.variant, k.mapper, c, coalesce(g, 0) AS g, coalesce(tp, 0) AS tp, coalesce(p, 0) AS p FROM (SELECT DISTINCT variant, mapper FROM hist) k CROSS JOIN (SELECT unnest(range(1, 6)) AS c)
LEFT JOIN (SELECT variant, mapper, gt AS c, sum(n) AS g, sum(CASE WHEN gt = pred THEN n ELSE 0 END) AS tp FROM hist GROUP BY ALL) USING (variant, mapper, c) LEFT JOIN (SELECT variant, mapper, pred AS c, sum(n) AS p FROM hist GROUP BY ALL) USING (variant, mapper, c))
SELECT variant, mapper, {r6('avg(CASE WHEN g + p - tp > 0 THEN 100 * tp / (g + p - tp) END)')} AS miou, {r6('avg(CASE WHEN g > 0 THEN 100 * tp / g END)')} AS macc, {r6('100 * sum(tp) / greatest(sum(g), 1)')} AS oa FROM per GROUP BY ALL"""


def _unit(c: str) -> str:
    return f"({c} - min({c}) OVER w) / greatest(max({c}) OVER w - min({c}) OVER w, 1e-6)"


_MODULAR = f"""{_LIFTED}, own_ev AS (SELECT l.*, v.valid FROM lifted l JOIN validity v USING (frame_id, sp_id)),
seen AS (SELECT frame_id, term, quantile_cont(fixed_qfe, 0.9) AS topp, avg((fixed_qfe > 0.20)::INTEGER) AS area FROM own_ev WHERE valid GROUP BY ALL), joined AS (SELECT p.*, coalesce(topp, 0) AS topp, coalesce(area, 0) AS area FROM priors p LEFT JOIN seen USING (frame_id, term)),
scored AS (SELECT *, 0.30 * {_unit('caption_freq')} + 0.25 * {_unit('presence')} + 0.35 * {_unit('topp')} + 0.10 * {_unit('area')} AS score FROM joined WINDOW w AS (PARTITION BY frame_id)),
verified AS (SELECT frame_id, term FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, term_idx) AS r FROM scored) WHERE score >= 0.05 AND r <= 8),
masked AS (SELECT e.frame_id, e.sp_id, e.term, e.term_idx, CASE WHEN NOT e.valid OR (e.frame_id IN (SELECT frame_id FROM verified) AND v.term IS NULL) THEN -30 ELSE fixed_qfe END AS score FROM own_ev e LEFT JOIN verified v ON v.frame_id = e.frame_id AND v.term = e.term)
SELECT sp.frame_id, point_id, sp.sp_id, m.term, m.term_idx, {r6('m.score')} AS score FROM sp JOIN (SELECT *, row_number() OVER (PARTITION BY frame_id, sp_id ORDER BY score DESC, term_idx) AS r FROM masked) m ON m.frame_id = sp.frame_id AND m.sp_id = sp.sp_id AND m.r = 1"""


@query(_CLEAN)
def clean_protocol(spark, sf):
    """Seven variants under three term maps by the pipeline's own partition."""
    protocol = pipeline.Protocol(classes=[1, 2, 3, 4, 5], camera=fx.CAMERA, target=120)
    points = fx.points(spark, sf).withColumn("gt", F.col("label") % 5 + 1)
    maps, terms = fx.raster(spark, sf), fx.raster_terms(spark, sf)
    own, evidence, validity = pipeline.lifted(points, maps, terms, _priors(points, maps, terms), protocol)
    mappers = terms.select(F.lit("rule").alias("mapper"), "term", (F.col("term_idx") + 1).alias("class_id")).unionByName(terms.select(F.lit("shifted").alias("mapper"), "term", ((F.col("term_idx") + 1) % 5 + 1).alias("class_id")))
    mappers = mappers.unionByName(_nearest_classes(spark, sf, terms).select(F.lit("nearest").alias("mapper"), "term", "class_id"))
    return rounded(pipeline.evaluate(own, evidence, validity, mappers, protocol), "miou", "macc", "oa")


@query(_MODULAR)
def modular_labels(spark, sf):
    """Verified terms of each frame on its points."""
    protocol = pipeline.Protocol(classes=[1], camera=fx.CAMERA, target=120)
    points, maps, terms = fx.points(spark, sf), fx.raster(spark, sf), fx.raster_terms(spark, sf)
    priors = _priors(points, maps, terms)
    own, evidence, validity = pipeline.lifted(points, maps, terms, priors, protocol)
    out = pipeline.label_points(own, evidence, validity, pipeline.verified_terms(evidence, validity, priors))
    return rounded(out.select("frame_id", "point_id", "sp_id", "term", "term_idx", "score"), "score")
