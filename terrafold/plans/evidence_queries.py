"""Evidence, labels, calibration, metrics and losses over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backends, geometry, lifting, metrics, procedural, segment, vocab
from . import fixtures as fx
from .fixtures import q6 as r6
from .geometry_queries import r6s, rounded
from .registry import query

KEY = lifting.KEY
SEGMENT = lifting.SEGMENT


@query(f"WITH {fx.STATS} SELECT frame_id, sp_id, term, term_idx, {r6s('center', 'mean', 'top', 'q75', 'topk')}, n FROM stats")
def evidence_stats(spark, sf):
    return rounded(fx.stats(spark, sf), "center", "mean", "top", "q75", "topk")


@query(f"WITH {fx.STATS} SELECT frame_id, sp_id, term, term_idx, {r6s('center')}, {r6('0.35 * center + 0.45 * mean + 0.20 * top')} AS spfe_default, {r6('0.65 * mean + 0.35 * top')} AS spfe_meanmax, {r6('0.25 * center + 0.45 * mean + 0.30 * topk')} AS spfe_topk, {r6('0.20 * center + 0.45 * mean + 0.25 * q75 + 0.10 * top')} AS spfe_quantile FROM stats")
def evidence_variants(spark, sf):
    return rounded(lifting.variants(fx.stats(spark, sf)), "center", "spfe_default", "spfe_meanmax", "spfe_topk", "spfe_quantile")


@query(f"WITH {fx.STATS} SELECT frame_id, sp_id, term, term_idx, {r6('CASE WHEN n > 0 THEN (0.35 * center + 0.45 * mean + 0.20 * top) / 1.0 ELSE center END')} AS score FROM stats")
def footprint_or_center(spark, sf):
    return rounded(lifting.footprint_or_center(fx.stats(spark, sf)), "score")


def _rank(v: str) -> str:
    return f"(CASE WHEN count(*) OVER (PARTITION BY frame_id, sp_id) <= 1 THEN 1 ELSE 1 - (row_number() OVER (PARTITION BY frame_id, sp_id ORDER BY {v} DESC, term_idx) - 1) / (count(*) OVER (PARTITION BY frame_id, sp_id) - 1)::DOUBLE END)"


_V8 = ", ".join(f"round_even({c} * 1e8, 0) AS {c}" for c in ("center", "mean", "q75", "top"))


def _stable(df):
    """Eight decimals, so ties are the same in every engine."""
    return df.withColumns({c: F.rint(F.col(c) * 1e8) for c in ("center", "mean", "q75", "top")})


@query(f"WITH {fx.STATS}, v AS (SELECT frame_id, sp_id, term, term_idx, {_V8} FROM stats) SELECT frame_id, sp_id, term, term_idx, {r6('(' + ' + '.join(_rank(c) for c in ('center', 'mean', 'q75', 'top')) + ') / 4')} AS rank_qfe FROM v")
def rank_qfe(spark, sf):
    return rounded(lifting.lift(_stable(fx.stats(spark, sf))).select(*KEY, "rank_qfe"), "rank_qfe")


_EQ_TERMS = """tt AS (SELECT frame_id, term, term_idx, max(score) AS presence, (term_idx * 7 % 4) / 4::DOUBLE AS caption_freq FROM ev GROUP BY ALL)"""


def _term_table(ev):
    return ev.groupBy("frame_id", "term", "term_idx").agg(F.max("score").alias("presence")).withColumn("caption_freq", F.col("term_idx") * 7 % 4 / 4.0)


@query(f"""WITH {fx.EVIDENCE}, {_EQ_TERMS}, r AS (SELECT frame_id, term_idx, 1 - (row_number() OVER (PARTITION BY frame_id ORDER BY presence DESC, term_idx) - 1) / 9::DOUBLE AS rp, 1 - (row_number() OVER (PARTITION BY frame_id ORDER BY caption_freq DESC, term_idx) - 1) / 9::DOUBLE AS rc FROM tt)
SELECT frame_id, sp_id, term, term_idx, {r6(f'({_rank("score")} + rp + rc) / 3')} AS equal_rank FROM ev JOIN r USING (frame_id, term_idx)""")
def equal_rank(spark, sf):
    ev = fx.evidence(spark, sf)
    return rounded(lifting.equal_rank(ev.withColumn("rank_qfe", F.col("score")), _term_table(ev)).select(*KEY, "equal_rank"), "equal_rank")


@query(f"WITH {fx.SP}, {fx.projected_sql('sp', 'foot')} SELECT frame_id, sp_id, bool_or(valid) AS sp_valid, {r6('avg(valid::INTEGER)')} AS valid_ratio FROM foot GROUP BY ALL")
def footprint_validity(spark, sf):
    return rounded(lifting.footprint_validity(fx.footprints(spark, sf)), "valid_ratio")


@query(f"WITH {fx.RASTER} SELECT term AS frame_id, term, {r6('count(CASE WHEN score > 0 THEN 1 END) / 720::DOUBLE')} AS mask_area FROM raster GROUP BY ALL")
def mask_area(spark, sf):
    return rounded(lifting.mask_area(fx.raster(spark, sf).withColumn("frame_id", F.col("term")), 720), "mask_area")


_PROMPTS = "m AS (SELECT event_type AS frame_id, 't' || (event_id % 3) AS term, 'p' || (event_id % 4) AS prompt, (event_id % 6)::INTEGER AS row, (user_id % 5)::INTEGER AS col, (event_id % 11) / 11::DOUBLE AS mask, (user_id % 13) / 13::DOUBLE AS object, value / 500 AS semantic, (user_id % 9) / 9::DOUBLE AS presence FROM events)"


@query(f"WITH {_PROMPTS}, p AS (SELECT frame_id, term, greatest(max(presence), 1e-3) AS presence FROM m GROUP BY ALL) SELECT frame_id, term, row, col, {r6('max(greatest(mask * object, semantic)) * first(p.presence)')} AS score FROM m JOIN p USING (frame_id, term) GROUP BY ALL")
def prompt_scores(spark, sf):
    e = fx.load(spark, sf, "events")
    name = lambda p, n: F.concat(F.lit(p), (F.col("event_id") % n).cast("string"))
    m = e.select(
        F.col("event_type").alias("frame_id"), name("t", 3).alias("term"), name("p", 4).alias("prompt"), (F.col("event_id") % 6).cast("int").alias("row"), (F.col("user_id") % 5).cast("int").alias("col"),
        (F.col("event_id") % 11 / 11.0).alias("mask"), (F.col("user_id") % 13 / 13.0).alias("object"), (F.col("value") / 500).alias("semantic"), (F.col("user_id") % 9 / 9.0).alias("presence"),
    )
    return rounded(lifting.prompt_scores(m), "score")


_BEST = "row_number() OVER (PARTITION BY frame_id, sp_id ORDER BY score DESC, term_idx)"


@query(f"""WITH {fx.EVIDENCE}, s AS (SELECT frame_id, sp_id, term, term_idx, CASE WHEN NOT valid OR (frame_id <> 'f3' AND term_idx NOT IN (1, 3, 8)) THEN -30 ELSE score END AS score FROM ev)
SELECT frame_id, sp_id, term, term_idx, {r6('score')} AS score FROM (SELECT *, {_BEST} AS r FROM s) WHERE r = 1""")
def assign_labels(spark, sf):
    ev = fx.evidence(spark, sf)
    verified = ev.where("term_idx IN (1, 3, 8) AND frame_id <> 'f3'").select("frame_id", "term").distinct()
    return rounded(segment.assign_labels(ev, verified), "score")


@query(f"WITH {fx.EVIDENCE}, s AS (SELECT frame_id, sp_id, term, term_idx, CASE WHEN valid THEN score ELSE -30 END AS score FROM ev) SELECT frame_id, sp_id, string_agg(term, ',' ORDER BY r) AS terms FROM (SELECT *, {_BEST} AS r FROM s) WHERE r <= 5 GROUP BY ALL")
def topk_terms(spark, sf):
    return segment.top_k(fx.evidence(spark, sf)).withColumn("terms", F.array_join("terms", ","))


@query(f"WITH {fx.SP}, {fx.MAJORITY} SELECT frame_id, point_id, sp_id, m.label AS sp_label FROM sp JOIN (SELECT frame_id, sp_id, label FROM majority) m USING (frame_id, sp_id)")
def expand_to_points(spark, sf):
    p = fx.segmented(spark, sf)
    labels = geometry.majority(p).select(*SEGMENT, F.col("label").alias("sp_label"))
    return segment.expand_to_points(p.select("frame_id", "point_id", "sp_id"), labels).select("frame_id", "point_id", "sp_id", "sp_label")


@query(f"WITH {fx.CLASS_PRED} SELECT frame_id, sp_id, class_id, class_idx, {r6('score')} AS score FROM collapsed")
def class_collapse(spark, sf):
    return rounded(segment.class_collapse(fx.evidence(spark, sf), fx.mapping(spark), fx.CLASSES), "score")


@query(f"WITH {fx.CLASS_PRED} SELECT frame_id, sp_id, gt, pred FROM rows")
def class_argmax_ignore(spark, sf):
    return fx.class_pred(spark, sf)


_FAMILY = {"building": ("building", 0), "road": ("road", 1), "tree": ("vegetation", 2), "vegetation": ("vegetation", 2), "grass": ("grass", 4), "water": ("water", 5), "vehicle": ("vehicle", 6), "parking lot": ("road", 1), "bridge": ("bridge", 8), "shadow": ("shadow", 9)}
_FAM_SQL = " UNION ALL ".join(f"SELECT '{t}' AS term, '{f}' AS family, {i} AS family_idx" for t, (f, i) in _FAMILY.items())


@query(f"WITH {fx.EVIDENCE}, fam AS ({_FAM_SQL}) SELECT frame_id, sp_id, family, family_idx, {r6('max(score)')} AS score FROM ev JOIN fam USING (term) GROUP BY ALL")
def coarse_family(spark, sf):
    return rounded(segment.coarsen(fx.evidence(spark, sf)), "score")


_SOFT = """soft AS (SELECT frame_id, sp_id, max(p) AS confidence, max(p) - coalesce(list_sort(list(p), 'DESC')[2], 0) AS margin, -sum(p * ln(p)) / greatest(ln(greatest(count(*), 2)), 1e-6) AS entropy FROM (SELECT frame_id, sp_id, exp({s}) / sum(exp({s})) OVER (PARTITION BY frame_id, sp_id) AS p FROM {t}) GROUP BY ALL)"""


@query(f"WITH {fx.EVIDENCE}, {_SOFT.format(s='score * 5', t='ev')} SELECT frame_id, sp_id, {r6s('confidence', 'margin', 'entropy')}, entropy > 0.9 AS uncertain FROM soft")
def entropy_uncertainty(spark, sf):
    ev = fx.evidence(spark, sf).withColumn("score", F.col("score") * 5)
    return rounded(segment.softmax_stats(ev), "confidence", "margin", "entropy")


@query(f"""WITH {fx.EVIDENCE}, b AS (SELECT frame_id, sp_id, term_idx, valid, score * 4 AS score FROM ev), f AS (SELECT frame_id, sp_id, term_idx, valid, score * (4 + term_idx % 3) AS score FROM ev),
{_SOFT.format(s='score', t='b').replace('soft AS', 'sb AS')}, {_SOFT.format(s='score', t='f').replace('soft AS', 'sf AS')},
ab AS (SELECT frame_id, sp_id, term_idx AS bi FROM (SELECT *, {_BEST} AS r FROM b) WHERE r = 1), af AS (SELECT frame_id, sp_id, term_idx AS fi FROM (SELECT *, {_BEST} AS r FROM f) WHERE r = 1)
SELECT v.frame_id, v.sp_id, CASE WHEN NOT valid THEN 0 WHEN (sb.confidence < 0.68 OR sb.margin < 0.08) AND sf.confidence >= sb.confidence + 0.02 THEN fi ELSE bi END AS term_idx
FROM (SELECT DISTINCT frame_id, sp_id, valid FROM ev) v JOIN sb USING (frame_id, sp_id) JOIN sf USING (frame_id, sp_id) JOIN ab USING (frame_id, sp_id) JOIN af USING (frame_id, sp_id)""")
def guarded_prediction(spark, sf):
    ev = fx.evidence(spark, sf)
    base = ev.withColumn("score", F.col("score") * 4)
    fine = ev.withColumn("score", F.col("score") * (4 + F.col("term_idx") % 3))
    return segment.guarded_prediction(base, fine, ev.select(*SEGMENT, "valid").distinct())


@query(f"WITH {fx.SP}, {fx.MAJORITY} SELECT frame_id, point_id, CASE WHEN intensity >= 0.6 AND z / 10 >= 0.05 THEN sp.label ELSE m.label END AS label FROM sp JOIN majority m USING (frame_id, sp_id)")
def hybrid_prediction(spark, sf):
    p = fx.segmented(spark, sf)
    pts = p.select(*SEGMENT, "point_id", F.col("label").alias("point_label"), F.col("intensity").alias("point_conf"), (F.col("z") / 10).alias("point_margin"))
    return segment.hybrid_prediction(pts, geometry.majority(p), 0.6, 0.05)


def _balance(mode: str, stat: str, shift: str):
    @query(f"WITH {fx.EVIDENCE}, b AS ({stat}) SELECT frame_id, sp_id, term_idx, {r6(f'CASE WHEN valid THEN {shift} ELSE -30 END')} AS score FROM ev JOIN b USING (frame_id, term_idx)")
    def balanced(spark, sf):
        return rounded(segment.balance(fx.evidence(spark, sf), mode).select(*SEGMENT, "term_idx", "score"), "score")

    from .registry import QUERIES, SQL

    QUERIES[f"balance_{mode}"], SQL[f"balance_{mode}"] = QUERIES.pop("balanced"), SQL.pop("balanced")


_OK = "FROM ev WHERE valid GROUP BY frame_id, term_idx"
_balance("mean", f"SELECT frame_id, term_idx, avg(score) AS b {_OK}", "score - b")
_balance("median", f"SELECT frame_id, term_idx, quantile_disc(score, 0.5) AS b {_OK}", "score - b")
_balance("halfmean", f"SELECT frame_id, term_idx, avg(score) AS b {_OK}", "score - 0.5 * b")
_balance("zscore", f"SELECT frame_id, term_idx, avg(score) AS b, greatest(coalesce(stddev_samp(score), 0), 1e-6) AS d {_OK}", "(score - b) / d")
_balance("robustz", f"SELECT frame_id, term_idx, m.b, 1.4826 * greatest(quantile_disc(abs(e.score - m.b), 0.5), 1e-6) AS d FROM ev e JOIN (SELECT frame_id, term_idx, quantile_disc(score, 0.5) AS b {_OK}) m USING (frame_id, term_idx) WHERE valid GROUP BY ALL", "(score - b) / d")


@query(f"WITH {fx.EVIDENCE} SELECT frame_id, sp_id, term_idx, {r6("CASE WHEN term IN ('bridge', 'shadow') THEN score - 0.35 ELSE score END")} AS score FROM ev")
def prune_names(spark, sf):
    return rounded(segment.prune_names(fx.evidence(spark, sf)).select(*SEGMENT, "term_idx", "score"), "score")


_SAL = "sal AS (SELECT frame_id, term, term_idx, 0.65 * max(score) + 0.35 * avg(score) AS s, 0.55 * max(score) + 0.30 * avg(score) + 0.15 * quantile_cont(score, 0.75) AS support FROM ev WHERE valid GROUP BY ALL)"


@query(f"WITH {fx.EVIDENCE}, {_SAL} SELECT frame_id, term, term_idx, {r6('s')} AS salience, {r6s('support')} FROM sal")
def term_salience(spark, sf):
    return rounded(segment.salience(fx.evidence(spark, sf)), "salience", "support")


def _routed(k: str, where: str = "") -> str:
    """Terms kept by rank up to k, the last one replaced by term 0 where that is missing."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY s DESC, term_idx) AS r, (s - avg(s) OVER (PARTITION BY frame_id)) / greatest(stddev_samp(s) OVER (PARTITION BY frame_id), 1e-6) AS z FROM sal),
    cut AS (SELECT *, {k} AS k FROM ranked), kept AS (SELECT * FROM cut WHERE r <= k), has AS (SELECT frame_id, bool_or(term_idx = 0) AS has, max(r) AS last FROM kept GROUP BY ALL),
    final AS (SELECT frame_id, term_idx FROM kept JOIN has USING (frame_id) WHERE has OR r < last UNION SELECT frame_id, 0 FROM has)
    SELECT e.frame_id, e.sp_id, e.term_idx, {r6('CASE WHEN valid AND f.term_idx IS NOT NULL THEN score ELSE -30 END')} AS score FROM ev e LEFT JOIN final f ON f.frame_id = e.frame_id AND f.term_idx = e.term_idx"""


def _route(spark, sf, mode):
    return rounded(segment.route(fx.evidence(spark, sf), mode).select(*SEGMENT, "term_idx", "score"), "score")


@query(f"WITH {fx.EVIDENCE}, {_SAL}, {_routed('4')}")
def route_top4(spark, sf):
    return _route(spark, sf, "top4")


@query(f"WITH {fx.EVIDENCE}, {_SAL}, {_routed('6')}")
def route_compact(spark, sf):
    return _route(spark, sf, "compact")


@query(f"WITH {fx.EVIDENCE}, {_SAL}, {_routed('greatest(least(sum((z >= -0.10)::INTEGER) OVER (PARTITION BY frame_id), 10), 5)')}")
def route_adaptive(spark, sf):
    return _route(spark, sf, "adaptive")


@query(f"WITH {fx.EVIDENCE}, {_SAL}, t AS (SELECT *, support + CASE WHEN term IN ('bridge', 'shadow', 'grass') THEN 0.35 ELSE 0 END AS score FROM sal), r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, term_idx) AS rank FROM t) SELECT frame_id, term, term_idx, {r6('score')} AS score, rank FROM r WHERE rank <= 4")
def select_terms(spark, sf):
    ev = fx.evidence(spark, sf)
    said = ev.where(F.col("term").isin("bridge", "shadow", "grass")).select("frame_id", "term")
    return rounded(segment.select_terms(ev, said, 4), "score")


@query(f"""WITH {fx.GEOMETRY}, rgb AS (SELECT frame_id, sp_id, avg(r) / 255 AS r, avg(g) / 255 AS g, avg(b) / 255 AS b FROM sp GROUP BY ALL),
f AS (SELECT frame_id, sp_id, cz, r, g, b, log_n, (r + g + b) / 3 AS bright, g - 0.5 * (r + b) AS green, b - 0.5 * (r + g) AS blue, planarity FROM nodes JOIN rgb USING (frame_id, sp_id)),
q AS (SELECT frame_id, {', '.join(f'quantile_cont({c}, 0.02) AS {c}_lo, quantile_cont({c}, 0.98) AS {c}_hi' for c in ('cz', 'green', 'blue', 'bright'))} FROM f GROUP BY ALL),
u AS (SELECT frame_id, sp_id, {', '.join(f'least(greatest(({c} - {c}_lo) / greatest({c}_hi - {c}_lo, 1e-6), 0), 1) AS {c}' for c in ('cz', 'green', 'blue', 'bright'))} FROM f JOIN q USING (frame_id)),
p AS (SELECT frame_id, sp_id, 0.75 * blue + 0.50 * (1 - bright) + 0.35 * (1 - cz) AS water, 0.90 * (1 - bright) AS shadow, 0::DOUBLE AS sky FROM u)
SELECT frame_id, sp_id, term, term_idx, {r6('v - (water + shadow + sky) / 3')} AS prior FROM (SELECT *, unnest(['water', 'shadow', 'sky']) AS term, unnest([0, 1, 2]) AS term_idx, unnest([water, shadow, sky]) AS v FROM p)""")
def ontology_prior(spark, sf):
    p = fx.segmented(spark, sf)
    rgb = p.groupBy(*SEGMENT).agg(*[(F.avg(c) / 255).alias(f"mean_{c}") for c in "rgb"])
    terms = spark.createDataFrame([("water", 0), ("shadow", 1), ("sky", 2)], "term string, term_idx int")
    return rounded(segment.ontology_prior(geometry.superpoint_geometry(p).join(rgb, SEGMENT), terms), "prior")


# metrics ---------------------------------------------------------------------------------------------------------------

_HIST = f"hist AS (SELECT gt, CASE WHEN pred IN ({fx.CLASS_LIST}) THEN pred ELSE -1 END AS pred, count(*) AS n FROM rows WHERE gt IN ({fx.CLASS_LIST}) GROUP BY ALL)"


@query(f"WITH {fx.CLASS_PRED}, {_HIST} SELECT * FROM hist")
def confusion_histogram(spark, sf):
    return metrics.confusion(fx.class_pred(spark, sf), fx.CLASSES)


_PER = f"""per AS (SELECT c.class_id, coalesce(gt_sum, 0) AS gt_sum, coalesce(tp, 0) AS tp, coalesce(pred_sum, 0) AS pred_sum FROM (SELECT unnest([{fx.CLASS_LIST}]) AS class_id) c
LEFT JOIN (SELECT gt AS class_id, sum(n) AS gt_sum, sum(CASE WHEN gt = pred THEN n ELSE 0 END) AS tp FROM hist GROUP BY ALL) USING (class_id) LEFT JOIN (SELECT pred AS class_id, sum(n) AS pred_sum FROM hist GROUP BY ALL) USING (class_id)),
scored AS (SELECT *, CASE WHEN gt_sum + pred_sum - tp > 0 THEN 100 * tp / (gt_sum + pred_sum - tp)::DOUBLE END AS iou, CASE WHEN gt_sum > 0 THEN 100 * tp / gt_sum::DOUBLE END AS acc FROM per)"""


@query(f"WITH {fx.CLASS_PRED}, {_HIST}, {_PER} SELECT class_id, gt_sum::BIGINT AS gt_sum, tp::BIGINT AS tp, pred_sum::BIGINT AS pred_sum, {r6s('iou', 'acc')} FROM scored")
def class_metrics(spark, sf):
    return rounded(metrics.class_metrics(metrics.confusion(fx.class_pred(spark, sf), fx.CLASSES), fx.CLASSES), "iou", "acc")


@query(f"WITH {fx.CLASS_PRED}, {_HIST}, {_PER} SELECT {r6('avg(iou)')} AS miou, {r6('avg(acc)')} AS macc, {r6('100 * sum(tp) / greatest(sum(gt_sum), 1)')} AS oa FROM scored")
def iou_metrics(spark, sf):
    return rounded(metrics.summary_metrics(metrics.confusion(fx.class_pred(spark, sf), fx.CLASSES), fx.CLASSES), "miou", "macc", "oa")


@query(f"""WITH {fx.CLASS_PRED}, k AS (SELECT frame_id, gt, pred, count(*) AS n FROM rows WHERE gt <> 0 GROUP BY ALL), g AS (SELECT frame_id, gt AS c, sum(n) AS g, sum(CASE WHEN gt = pred THEN n ELSE 0 END) AS tp FROM k GROUP BY ALL), p AS (SELECT frame_id, pred AS c, sum(n) AS p FROM k GROUP BY ALL),
b AS (SELECT frame_id, c, coalesce(g, 0) AS g, coalesce(p, 0) AS p, coalesce(tp, 0) AS tp FROM g FULL JOIN p USING (frame_id, c) WHERE c <> 0)
SELECT b.frame_id, {r6('first(t.acc)')} AS acc, {r6('avg(tp / (g + p - tp))')} AS miou FROM b JOIN (SELECT frame_id, sum(CASE WHEN gt = pred THEN n ELSE 0 END) / sum(n) AS acc FROM k GROUP BY ALL) t USING (frame_id) GROUP BY ALL""")
def macro_iou(spark, sf):
    return rounded(metrics.macro_iou(fx.class_pred(spark, sf), by=["frame_id"]), "acc", "miou")


@query(f"""WITH {fx.CLASS_PRED}, n AS (SELECT frame_id, gt, pred, count(*)::DOUBLE AS n FROM rows WHERE gt >= 0 GROUP BY ALL), t AS (SELECT frame_id, sum(n) AS t FROM n GROUP BY ALL), c AS (SELECT frame_id, -sum(n / t * ln(n / t)) AS h, sum(n * (n - 1) / 2) AS i FROM n JOIN t USING (frame_id) GROUP BY ALL),
g AS (SELECT frame_id, -sum(m / t * ln(m / t)) AS hg, sum(m * (m - 1) / 2) AS a FROM (SELECT frame_id, gt, sum(n) AS m FROM n GROUP BY ALL) JOIN t USING (frame_id) GROUP BY ALL), p AS (SELECT frame_id, -sum(m / t * ln(m / t)) AS hp, sum(m * (m - 1) / 2) AS b FROM (SELECT frame_id, pred, sum(n) AS m FROM n GROUP BY ALL) JOIN t USING (frame_id) GROUP BY ALL)
SELECT frame_id, {r6('CASE WHEN hg + hp <= 0 THEN 1 ELSE (hg + hp - h) / ((hg + hp) / 2) END')} AS nmi, {r6('(i - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2))')} AS ari FROM t JOIN c USING (frame_id) JOIN g USING (frame_id) JOIN p USING (frame_id)""")
def nmi_ari(spark, sf):
    return rounded(metrics.agreement(fx.class_pred(spark, sf), by=["frame_id"]), "nmi", "ari")


_SETS = "pr AS (SELECT DISTINCT frame_id, pred AS class_id FROM rows WHERE pred IN (1, 4, 6, 14)), tr AS (SELECT DISTINCT frame_id, gt AS class_id FROM rows WHERE gt IN (1, 3, 14, 6, 20))"


@query(f"""WITH {fx.CLASS_PRED}, {_SETS}, n AS (SELECT frame_id, (SELECT count(*) FROM pr p WHERE p.frame_id = f.frame_id) AS n_pred, (SELECT count(*) FROM tr t WHERE t.frame_id = f.frame_id) AS n_gt, (SELECT count(*) FROM pr p JOIN tr t USING (frame_id, class_id) WHERE p.frame_id = f.frame_id) AS tp FROM (SELECT DISTINCT frame_id FROM rows) f),
m AS (SELECT *, tp / greatest(n_pred, 1) AS precision, tp / greatest(n_gt, 1) AS recall FROM n) SELECT frame_id, n_pred, n_gt, tp, {r6s('precision', 'recall')}, {r6('2 * precision * recall / greatest(precision + recall, 1e-12)')} AS f1 FROM m""")
def official_vocabulary_prf(spark, sf):
    rows = fx.class_pred(spark, sf)
    pred = rows.where("pred IN (1, 4, 6, 14)").select("frame_id", F.col("pred").alias("class_id"))
    truth = rows.where("gt IN (1, 3, 14, 6, 20)").select("frame_id", F.col("gt").alias("class_id"))
    return rounded(metrics.set_prf(pred, truth), "precision", "recall", "f1")


@query(f"WITH {fx.EVIDENCE} SELECT frame_id, {r6(f'avg(([{fx._IDS}][term_idx + 1] > 0)::INTEGER)')} AS coverage FROM (SELECT DISTINCT frame_id, term_idx FROM ev) GROUP BY ALL")
def mapper_coverage(spark, sf):
    terms = fx.evidence(spark, sf).select("frame_id", "term").distinct().join(fx.mapping(spark), "term", "left").fillna(0, ["class_id"])
    return rounded(metrics.mapper_coverage(terms, ["frame_id"]), "coverage")


@query(f"WITH {fx.CLASS_PRED}, g AS (SELECT frame_id, {{0}} AS a, {{1}} AS b FROM rows WHERE gt IN ({fx.CLASS_LIST})) SELECT frame_id, {r6('avg((a = b)::INTEGER)')} AS accuracy FROM g GROUP BY ALL".replace("{0}", "CASE WHEN gt IN (1, 17) THEN 'roof' WHEN gt IN (2, 3, 10, 18, 19) THEN 'surface' WHEN gt IN (4, 5) THEN 'water' WHEN gt IN (13, 14) THEN 'field' WHEN gt IN (20, 24) THEN 'vehicle' WHEN gt = 6 THEN 'bridge' ELSE 'x' || gt END").replace("{1}", "CASE WHEN pred IN (1, 17) THEN 'roof' WHEN pred IN (2, 3, 10, 18, 19) THEN 'surface' WHEN pred IN (4, 5) THEN 'water' WHEN pred IN (13, 14) THEN 'field' WHEN pred IN (20, 24) THEN 'vehicle' WHEN pred = 6 THEN 'bridge' ELSE 'x' || pred END"))
def ambiguity_accuracy(spark, sf):
    return rounded(metrics.ambiguity_accuracy(fx.class_pred(spark, sf), fx.CLASSES, ["frame_id"]), "accuracy")


_TOPC = f"topc AS (SELECT frame_id, sp_id, list([{fx._IDS}][term_idx + 1] ORDER BY r) AS classes FROM (SELECT *, {_BEST} AS r FROM (SELECT frame_id, sp_id, term_idx, CASE WHEN valid THEN score ELSE -30 END AS score FROM ev)) WHERE r <= 5 GROUP BY ALL)"


def _top_classes(spark, sf):
    ids = F.create_map(*[x for k, v in fx.TERM_CLASS.items() for x in (F.lit(k), F.lit(v))])
    return segment.top_k(fx.evidence(spark, sf)).select(*SEGMENT, F.transform("terms", lambda t: F.coalesce(ids[t], F.lit(0))).alias("classes"))


@query(f"WITH {fx.CLASS_PRED}, {_TOPC} SELECT frame_id, {r6('avg(list_contains(classes[1:3], gt)::INTEGER)')} AS recall FROM rows JOIN topc USING (frame_id, sp_id) WHERE gt IN ({fx.CLASS_LIST}) GROUP BY ALL")
def topk_recall(spark, sf):
    return rounded(metrics.topk_recall(fx.class_pred(spark, sf), _top_classes(spark, sf), fx.CLASSES), "recall")


@query(f"WITH {fx.CLASS_PRED}, {_TOPC} SELECT frame_id, sp_id AS point_id, gt, CASE WHEN list_contains(classes[1:5], gt) THEN gt ELSE pred END AS pred FROM rows JOIN topc USING (frame_id, sp_id)")
def oracle_topk(spark, sf):
    return metrics.oracle_substitution(fx.class_pred(spark, sf).withColumn("point_id", F.col("sp_id")), _top_classes(spark, sf), 5)


@query()
def hungarian_matched(spark, sf):
    return procedural.matched_metrics(fx.class_pred(spark, sf))


@query()
def hungarian_all_truths(spark, sf):
    return procedural.matched_metrics(fx.class_pred(spark, sf), denominator="gt")


@query()
def hungarian_with_coverage(spark, sf):
    return procedural.matched_with_coverage(fx.class_pred(spark, sf).withColumn("valid", F.col("sp_id") % 7 != 0))


def _report(spark, sf):
    o = fx.load(spark, sf, "orders")
    return o.select(F.concat(F.lit("s"), (F.col("o_custkey") % 40).cast("string")).alias("frame_id"), F.col("o_orderpriority").alias("method"), (F.col("o_totalprice") / 1000).alias("miou"), F.col("o_custkey"), F.col("o_orderkey"))


@query(f"SELECT o_orderpriority AS method, {r6('avg(o_totalprice / 1000)')} AS miou, count(*) AS frames FROM orders GROUP BY ALL")
def report_means(spark, sf):
    return rounded(metrics.report_means(_report(spark, sf), ["miou"], ["method"]), "miou")


@query(f"WITH r AS (SELECT 'd' || (o_custkey % 4) AS domain, o_orderpriority AS method, o_totalprice / 1000 AS miou FROM orders) SELECT domain, method, {r6('avg(miou)')} AS miou, count(*) AS frames FROM r GROUP BY ROLLUP (domain, method)")
def domain_rollup(spark, sf):
    return rounded(metrics.domain_rollup(_report(spark, sf), ["miou"], F.concat(F.lit("d"), (F.col("o_custkey") % 4).cast("string"))), "miou")


@query(f"WITH d AS (SELECT p_brand, p_retailprice - p_size * 20 AS d FROM part) SELECT p_brand, {r6('avg(d)')} AS mean, {r6('median(d)')} AS median, {r6('avg((d > 0)::INTEGER)')} AS win_rate, {r6('min(d)')} AS least, {r6('max(d)')} AS most FROM d GROUP BY ALL")
def win_rate(spark, sf):
    pairs = fx.load(spark, sf, "part").select("p_brand", (F.col("p_size") * 20).cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return rounded(metrics.delta_stats(pairs, ["p_brand"]), "mean", "median", "win_rate", "least", "most")


@query(f"SELECT l_returnflag, {r6('sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1)')} AS l_discount FROM lineitem GROUP BY ALL")
def weighted_mean(spark, sf):
    return rounded(metrics.weighted_mean(fx.load(spark, sf, "lineitem"), "l_discount", "l_quantity", ["l_returnflag"]), "l_discount")


@query(f"WITH {fx.EVIDENCE}, {_SOFT.format(s='score * 5', t='ev')} SELECT frame_id, {r6('avg((entropy > 0.9)::INTEGER)')} AS uncertain, {r6('avg(entropy)')} AS entropy FROM soft GROUP BY ALL")
def uncertainty_ratio(spark, sf):
    s = segment.softmax_stats(fx.evidence(spark, sf).withColumn("score", F.col("score") * 5)).withColumn("pred", F.lit(1))
    return rounded(metrics.ignore_ratio(s, ["frame_id"]).drop("ignored"), "uncertain", "entropy")


@query(f"WITH {fx.SP}, {fx.MAJORITY} SELECT frame_id, {r6('avg(purity)')} AS purity, count(*) AS segments FROM majority GROUP BY ALL")
def mean_purity(spark, sf):
    return rounded(metrics.purity_mean(geometry.majority(fx.segmented(spark, sf))), "purity")


@query(f"WITH {fx.SP}, {fx.projected_sql('sp', 'foot')}, s AS (SELECT frame_id, sp_id, bool_or(valid) AS v, count(*) AS n FROM foot GROUP BY ALL) SELECT frame_id, sum(n)::BIGINT AS points, count(*) AS segments, {r6('avg(v::INTEGER)')} AS coverage, {r6('sum(n) / count(*)')} AS compression FROM s GROUP BY ALL")
def tokenisation_meta(spark, sf):
    f = fx.footprints(spark, sf)
    return rounded(metrics.tokenisation_meta(f, lifting.footprint_validity(f)), "coverage", "compression")


# similarity and losses -------------------------------------------------------------------------------------------------

_LOGITS = f"{fx.EVIDENCE}, lg AS (SELECT sp_id AS id, term_idx, score / 0.07 AS logit, gt FROM ev)"


def _logits(spark, sf):
    return fx.evidence(spark, sf).select(F.col("sp_id").alias("id"), "term_idx", (F.col("score") / 0.07).alias("logit"), F.col("gt").alias("index"))


@query(f"WITH {fx.PROTOTYPES} SELECT vec_id AS id, term_idx, {r6('sum(e * p) / (sqrt(sum(e * e)) * sqrt(sum(p * p))) / 0.07')} AS logit FROM long JOIN proto USING (i) GROUP BY ALL")
def similarity_logits(spark, sf):
    e = fx.load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return rounded(metrics.cosine_logits(e, fx.prototypes(spark, sf)), "logit")


_LSM = "ls AS (SELECT id, term_idx, logit, gt, m + ln(s) AS lse, m, 1 / s AS conf, ln(s) - t / s AS entropy FROM (SELECT *, sum(exp(logit - m)) OVER (PARTITION BY id) AS s, sum((logit - m) * exp(logit - m)) OVER (PARTITION BY id) AS t FROM (SELECT *, max(logit) OVER (PARTITION BY id) AS m FROM lg)))"


@query(f"WITH {_LOGITS}, {_LSM}, i AS (SELECT id, first(entropy) AS entropy, first(CASE WHEN conf >= 0.3 THEN lse - m END) AS ce FROM ls GROUP BY ALL) SELECT {r6('coalesce(avg(ce), 0)')} AS ce, {r6('avg(entropy)')} AS entropy, {r6('coalesce(avg(ce), 0) - 0.1 * avg(entropy)')} AS loss FROM i")
def pseudo_label_loss(spark, sf):
    return rounded(metrics.similarity_loss(_logits(spark, sf).drop("index"), least=0.3, entropy_weight=0.1), "ce", "entropy", "loss")


@query(f"WITH {_LOGITS}, {_LSM} SELECT {r6('avg(lse - logit)')} AS ce, {r6('avg(entropy)')} AS entropy, {r6('avg(lse - logit)')} AS loss FROM ls WHERE term_idx = gt")
def supervised_loss(spark, sf):
    lg = _logits(spark, sf)
    return rounded(metrics.similarity_loss(lg.drop("index"), lg.select("id", "index").distinct()), "ce", "entropy", "loss")


@query(f"WITH {_LOGITS.replace('score / 0.07', 'score')}, {_LSM} SELECT {r6('avg(logit)')} AS pred_cosine, {r6('avg(m)')} AS max_cosine, {r6('avg(entropy)')} AS entropy FROM ls WHERE term_idx = gt AND id % 7 <> 0")
def similarity_report(spark, sf):
    s = fx.evidence(spark, sf).select(F.col("sp_id").alias("id"), "term_idx", F.col("score").alias("logit"), "gt", "valid")
    return rounded(metrics.similarity_report(s.select("id", "term_idx", "logit"), s.where("valid").select("id", F.col("gt").alias("index")).distinct()), "pred_cosine", "max_cosine", "entropy")


@query(f"""WITH {fx.EVIDENCE}, pb AS (SELECT frame_id, sp_id, term_idx, exp(score) / sum(exp(score)) OVER (PARTITION BY frame_id, sp_id) AS p FROM ev), g AS (SELECT frame_id, sp_id, max(score) AS h FROM ev GROUP BY ALL),
e AS (SELECT frame_id, sp_id AS src, sp_id + 4 AS dst FROM (SELECT DISTINCT frame_id, sp_id FROM ev)),
d AS (SELECT e.frame_id, src, dst, sum((a.p - b.p) * (a.p - b.p)) AS d2 FROM e JOIN pb a ON a.sp_id = src JOIN pb b ON b.sp_id = dst AND b.term_idx = a.term_idx GROUP BY ALL)
SELECT d.frame_id, {r6('avg(d2 * exp(-(x.h - y.h) * (x.h - y.h) / 0.5)) * 1000')} AS smoothness FROM d JOIN g x ON x.sp_id = src JOIN g y ON y.sp_id = dst GROUP BY ALL""")
def smoothness_loss(spark, sf):
    ev = fx.evidence(spark, sf)
    e = F.exp("score")
    total = ev.groupBy(*SEGMENT).agg(F.sum(e).alias("t"), F.max("score").alias("h"))
    probs = ev.join(total, SEGMENT).select(*SEGMENT, "term_idx", (e / F.col("t")).alias("p"))
    edges = total.select("frame_id", F.col("sp_id").alias("src"), (F.col("sp_id") + 4).alias("dst"))
    out = metrics.smoothness_loss(edges, probs, total.select(*SEGMENT, "h"), ["h"], 0.5)
    return rounded(out.withColumn("smoothness", F.col("smoothness") * 1000), "smoothness")


@query(f"WITH {fx.EVIDENCE}, s AS (SELECT frame_id, sp_id, avg(score) AS score, max(score) AS presence, sp_id % 5 + 1 AS n FROM ev GROUP BY ALL) SELECT frame_id, {r6('sum(1 / (1 + exp(-score)) * (1 / (1 + exp(-presence))) * n) / greatest(sum(n), 1)')} AS confidence FROM s GROUP BY ALL")
def point_confidence(spark, sf):
    s = fx.evidence(spark, sf).groupBy(*SEGMENT).agg(F.avg("score").alias("score"), F.max("score").alias("presence")).withColumn("n", F.col("sp_id") % 5 + 1)
    return rounded(metrics.point_confidence(s), "confidence")


@query(f"""WITH {fx.PROTOTYPES}, s AS (SELECT vec_id AS id, term_idx, sum(e * p) / greatest(sqrt(sum(e * e)) * sqrt(sum(p * p)), 1e-12) AS c FROM long JOIN proto USING (i) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, term_idx) AS r FROM s)
SELECT id, CASE WHEN c >= 0.35 THEN term_idx + 1 ELSE 0 END AS class_id, {r6('c')} AS similarity FROM b WHERE r = 1""")
def nearest_label(spark, sf):
    e = fx.load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    labels = fx.prototypes(spark, sf).select(F.col("term_idx").alias("place"), (F.col("term_idx") + 1).alias("class_id"), F.col("text_v").alias("v"))
    return rounded(vocab.nearest_label(e, labels, "v"), "similarity")


_PIX = "px AS (SELECT event_type AS frame_id, (event_id % 30)::INTEGER AS row, (event_id // 30)::INTEGER AS col, (event_id * 37 % 256) / 255::DOUBLE AS r, (user_id * 11 % 256) / 255::DOUBLE AS g, (event_id * 5 % 256) / 255::DOUBLE AS b FROM events)"


def _pixels(spark, sf):
    e = fx.load(spark, sf, "events")
    return e.select(F.col("event_type").alias("frame_id"), (F.col("event_id") % 30).cast("int").alias("row"), F.floor(F.col("event_id") / 30).cast("int").alias("col"), (F.col("event_id") * 37 % 256 / 255.0).alias("r"), (F.col("user_id") * 11 % 256 / 255.0).alias("g"), (F.col("event_id") * 5 % 256 / 255.0).alias("b"))


_PRIOR = """CASE WHEN term = 'tree' THEN 1.4 * greatest(g - 0.5 * (r + b), 0) + 0.2 * m WHEN term = 'water' THEN 1.2 * greatest(b - 0.5 * (r + g), 0) + 0.15 * (1 - m) WHEN term = 'road' THEN 0.9 * gray + 0.35 * m - 0.25 * greatest(g - 0.5 * (r + b), 0)
WHEN term = 'roof' THEN 0.7 * gray + 0.35 * m WHEN term = 'terrain' THEN 0.9 * greatest(0.55 * r + 0.35 * g - 0.45 * b, 0) + 0.2 * m ELSE m END"""
_CP = f"""{_PIX}, pm AS (SELECT *, (r + g + b) / 3 AS m FROM px), pg AS (SELECT *, 1 - sqrt(((r - m) * (r - m) + (g - m) * (g - m) + (b - m) * (b - m)) / 2) AS gray FROM pm), sc AS (SELECT frame_id, term, term_idx, row, col, least(greatest({_PRIOR}, 0), 1) AS score FROM pg CROSS JOIN (SELECT unnest(['tree', 'water', 'road', 'roof', 'terrain', 'sky']) AS term, unnest(range(6)) AS term_idx))"""


def _prior_terms(spark):
    return spark.createDataFrame([(t, i) for i, t in enumerate(("tree", "water", "road", "roof", "terrain", "sky"))], "term string, term_idx int")


@query(f"WITH {_CP} SELECT frame_id, term, row, col, {r6('score')} AS score FROM sc")
def color_evidence(spark, sf):
    return rounded(backends.color_evidence(_pixels(spark, sf), _prior_terms(spark))[0].drop("term_idx"), "score")


@query(f"WITH {_CP} SELECT frame_id, term, {r6('quantile_cont(score, 0.95)')} AS presence FROM sc GROUP BY ALL")
def color_presence(spark, sf):
    return rounded(backends.color_evidence(_pixels(spark, sf), _prior_terms(spark))[1].drop("term_idx"), "presence")


@query(f"""WITH {_PIX}, s AS (SELECT frame_id, avg((g > r * 1.08)::INTEGER) AS gr, avg((b > g * 1.10)::INTEGER) AS bl, avg(((r + g + b) / 3 > 0.45 AND greatest(r, g, b) - least(r, g, b) < 0.13)::INTEGER) AS ga FROM px GROUP BY ALL)
SELECT frame_id, array_to_string(list_concat(['building', 'road', 'tree', 'vegetation'], CASE WHEN gr > 0.18 THEN ['grass', 'farmland'] ELSE [] END, CASE WHEN bl > 0.10 THEN ['water'] ELSE [] END, CASE WHEN ga > 0.16 THEN ['roof', 'parking lot'] ELSE [] END, CASE WHEN contains(frame_id, 'click') THEN ['runway'] ELSE [] END), ', ') AS text FROM s""")
def heuristic_captions(spark, sf):
    px = _pixels(spark, sf)
    images = px.select("frame_id").distinct().withColumn("path", F.when(F.col("frame_id").contains("click"), F.lit("/a/Runway_1.jpg")).otherwise(F.lit("/a/x.jpg")))
    return backends.heuristic_captions(images, px)


@query()
def graph_attention(spark, sf):
    import numpy as np

    rng = np.random.default_rng(7)
    d, h = 8, 16
    w = {n: rng.normal(scale=0.3, size=(d, d)) for n in "qkvo"} | {"g1": rng.normal(scale=0.3, size=(d, h)), "b1": np.zeros(h), "g2": rng.normal(scale=0.3, size=(h, 4)), "b2": np.zeros(4)}
    n = fx.nodes(spark, sf)
    return procedural.graph_attention(n, geometry.knn_edges(n), w, geometry.GATE, geometry.GATE)
