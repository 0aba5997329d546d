"""Message passing on segment graphs: propagation, refinement, repair, boundary measures.

Graphs are ``edges(frame_id, src, dst, w)``; a message goes from ``dst`` to ``src``. Labels are class
indices; scores long rows ``(frame_id, sp_id, term_idx, score)``. Iterated operators work per frame
(a frame is a bounded segment graph) in one grouped pass, so an iteration costs no shuffle; one-step
operators are joins and aggregations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import EPS, MASKED
from .geometry import undirected
from .lineage import written

FRAME = "frame_id"
SEGMENT = ["frame_id", "sp_id"]


#: Segments of a frame that an iterated operator takes in one task.
MOST_SEGMENTS = 65_536


def bounded(nodes: pd.DataFrame, most: int = MOST_SEGMENTS) -> pd.DataFrame:
    """``nodes``, or an error where a frame has more segments than one task should hold: partition it more coarsely, or in parts."""
    if (n := nodes["sp_id"].nunique()) > most:
        raise ValueError(f"a frame of {n} segments; this operator takes {most} at most")
    return nodes


def _per_frame(tables: tuple[DataFrame, DataFrame], run, schema: str) -> DataFrame:
    a, b = tables
    step = lambda key, nodes, links: run(key, bounded(nodes), links)
    return a.groupBy(FRAME).cogroup(b.groupBy(FRAME)).applyInPandas(step, schema)


def _dense(nodes: pd.DataFrame, columns: list[str]) -> tuple[np.ndarray, list[np.ndarray], int]:
    """Sorted node ids, one (segments x terms) matrix per column, number of terms."""
    ids = np.unique(nodes["sp_id"])
    c = int(nodes["term_idx"].max()) + 1
    out = []
    for col in columns:
        m = np.full((len(ids), c), MASKED)
        m[np.searchsorted(ids, nodes["sp_id"]), nodes["term_idx"]] = nodes[col]
        out.append(m)
    return ids, out, c


def _softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _ends(edges: pd.DataFrame, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edges = edges.sort_values(["src", "dst"])
    known = np.isin(edges["src"], ids) & np.isin(edges["dst"], ids)
    edges = edges[known]
    return np.searchsorted(ids, edges["src"]), np.searchsorted(ids, edges["dst"]), edges["w"].to_numpy()


def _gather(n: int, src: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros((n, values.shape[1]))
    np.add.at(out, src, values)
    return out


def _long(frame, ids: np.ndarray, m: np.ndarray) -> pd.DataFrame:
    n, c = m.shape
    return pd.DataFrame({FRAME: frame, "sp_id": np.repeat(ids, c), "term_idx": np.tile(np.arange(c, dtype=np.int32), n), "score": m.reshape(-1)})


_SCORES = "frame_id string, sp_id bigint, term_idx int, score double"


def geometry_refine(scores: DataFrame, edges: DataFrame, iterations: int = 5, beta: float = 0.55, temperature: float = 0.035) -> DataFrame:
    """Two scales of evidence refined by neighbours' opinions over geometry-consistent edges.

    ``scores`` has small, large (context) and valid per segment and term. The unary is 0.62 small + 0.38
    large over the temperature; each round mixes in the log of the weighted mean of the neighbours'
    softmax, the more the less confident a segment is. Invalid segments score -30.
    """

    def run(key: tuple, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        ids, (small, large), _ = _dense(nodes, ["small", "large"])
        unary = (0.62 * small + 0.38 * large) / max(temperature, EPS)
        valid = _valid(nodes, ids)
        conf = _softmax(unary).max(axis=1)
        src, dst, w = _valid_ends(links, ids, valid)
        score = _rounds(unary, valid, src, dst, np.maximum(w, EPS), beta * np.clip(1 - conf, 0, 0.85), iterations)
        return _long(key[0], ids, score)

    return _per_frame((scores, edges), run, _SCORES)


def semantic_refine(scores: DataFrame, edges: DataFrame, iterations: int = 5, beta: float = 0.58, temperature: float = 0.08, power: float = 1.6) -> DataFrame:
    """As ``geometry_refine`` for one scale (``score``): edges also weigh the ends' agreement to ``power``, and a segment
    listens by its share of support over the frame's (lower) median."""

    def run(key: tuple, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        ids, (own,), _ = _dense(nodes, ["score"])
        unary = own / max(temperature, EPS)
        valid = _valid(nodes, ids)
        p = _softmax(np.where(valid[:, None], unary, MASKED))
        conf = p.max(axis=1)
        src, dst, w = _valid_ends(links, ids, valid)
        w = np.maximum(w * np.maximum(np.clip((p[src] * p[dst]).sum(axis=1), 0, 1), 1e-4) ** power, 1e-8)
        total = np.sort(_gather(len(ids), src, w[:, None])[:, 0])
        support = np.clip(_gather(len(ids), src, w[:, None])[:, 0] / max(total[(len(total) - 1) // 2], EPS), 0, 1)
        score = _rounds(unary, valid, src, dst, w, beta * np.clip(1 - conf, 0, 0.85) * support, iterations)
        return _long(key[0], ids, score)

    return _per_frame((scores, edges), run, _SCORES)


def _valid(nodes: pd.DataFrame, ids: np.ndarray) -> np.ndarray:
    return nodes.groupby("sp_id")["valid"].first().reindex(ids).to_numpy(dtype=bool)


def _valid_ends(links: pd.DataFrame, ids: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    src, dst, w = _ends(links, ids)
    ok = valid[src] & valid[dst]
    return src[ok], dst[ok], w[ok]


def _rounds(unary: np.ndarray, valid: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, share: np.ndarray, iterations: int) -> np.ndarray:
    """Rounds of unary mixed with the log of the neighbours' weighted mean opinion."""
    score = np.where(valid[:, None], unary, MASKED)
    if not len(src):
        return score
    total = np.maximum(_gather(len(unary), src, w[:, None]), 1e-8)
    for _ in range(iterations):
        opinion = _gather(len(unary), src, _softmax(score)[dst] * w[:, None]) / total
        mixed = (1 - share[:, None]) * unary + share[:, None] * np.log(np.maximum(opinion, 1e-8))
        score = np.where(valid[:, None], mixed, MASKED)
    return score


def label_propagation(labels: DataFrame, edges: DataFrame, classes: int, alpha: float = 0.72, steps: int = 18, most: int = MOST_SEGMENTS) -> DataFrame:
    """Class indices after ``steps`` of p = alpha * init + (1 - alpha) * weighted mean of neighbours, edges both ways.

    ``labels`` is (frame_id, sp_id, index, valid); unknown or invalid starts are uniform.
    """

    def run(key: tuple, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("sp_id")
        ids, index = nodes["sp_id"].to_numpy(), nodes["index"].to_numpy()
        ok = nodes["valid"].to_numpy(dtype=bool) & (index >= 0)
        start = np.full((len(ids), classes), 1.0 / classes)
        start[ok] = np.eye(classes)[index[ok]]
        src, dst, w = _ends(links, ids)
        w = np.maximum(np.concatenate([w, w]), 1e-5)
        src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
        degree = np.maximum(_gather(len(ids), src, w[:, None]), EPS)
        p = start
        for _ in range(steps):
            p = alpha * start + (1 - alpha) * _gather(len(ids), src, p[dst] * w[:, None]) / degree
        return pd.DataFrame({FRAME: key[0], "sp_id": ids, "index": p.argmax(axis=1).astype(np.int32)})

    large = labels.groupBy(FRAME).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(FRAME)
    if large.isEmpty():
        return _per_frame((labels, edges), run, "frame_id string, sp_id bigint, index int")
    # frames that one task should not hold go round by round, a join and an aggregation each
    some = labels.join(large, FRAME, "left_anti"), edges.join(large, FRAME, "left_anti")
    out = _per_frame(some, run, "frame_id string, sp_id bigint, index int")
    return out.unionByName(_propagated(labels.join(large, FRAME, "left_semi"), edges.join(large, FRAME, "left_semi"), classes, alpha, steps))


def _propagated(labels: DataFrame, edges: DataFrame, classes: int, alpha: float, steps: int) -> DataFrame:
    """``label_propagation`` by ``propagation_step``, with each round's state in a table."""
    known = F.coalesce(F.col("valid") & (F.col("index") >= 0), F.lit(False))
    rows = labels.withColumn("term_idx", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    first = F.when(known, (F.col("term_idx") == F.col("index")).cast("double")).otherwise(1.0 / classes)
    start = now = written(rows.select(*SEGMENT, "term_idx", first.alias("p")), "propagation")
    for _ in range(steps):
        now = written(propagation_step(start, now, edges, alpha), "propagation")
    # sums in other orders differ in the last digits; equal classes tie to the smaller
    return now.groupBy(*SEGMENT).agg(F.max_by("term_idx", F.struct(F.round("p", 12), -F.col("term_idx"))).cast("int").alias("index"))


def propagation_step(start: DataFrame, now: DataFrame, edges: DataFrame, alpha: float = 0.72) -> DataFrame:
    """One synchronous step as joins, for graphs too large for one task: rows (frame_id, sp_id, term_idx, p)."""
    both = undirected(edges.select(FRAME, "src", "dst", F.greatest("w", F.lit(1e-5)).alias("w")))
    degree = both.groupBy(FRAME, F.col("src").alias("sp_id")).agg(F.sum("w").alias("deg"))
    mean = both.join(now.withColumnRenamed("sp_id", "dst"), [FRAME, "dst"]).groupBy(FRAME, F.col("src").alias("sp_id"), "term_idx").agg(F.sum(F.col("p") * F.col("w")).alias("s"))
    out = start.withColumnRenamed("p", "p0").join(mean, [*SEGMENT, "term_idx"], "left").join(degree, SEGMENT, "left")
    return out.select(*SEGMENT, "term_idx", (alpha * F.col("p0") + (1 - alpha) * F.coalesce(F.col("s") / F.greatest("deg", F.lit(EPS)), F.lit(0.0))).alias("p"))


def _votes(edges: DataFrame, seeds: DataFrame, least: float = EPS) -> DataFrame:
    """(frame_id, sp_id, index, vote): normalised weighted votes of seed neighbours (frame_id, sp_id, index, weight)."""
    both = undirected(edges.select(FRAME, "src", "dst", F.greatest("w", F.lit(least)).alias("w")))
    cast = both.join(seeds.withColumnRenamed("sp_id", "dst"), [FRAME, "dst"]).groupBy(FRAME, F.col("src").alias("sp_id"), "index").agg(F.sum(F.col("w") * F.col("weight")).alias("v"))
    total = cast.groupBy(*SEGMENT).agg(F.sum("v").alias("total"))
    return cast.join(total, SEGMENT).select(*SEGMENT, "index", (F.col("v") / F.greatest("total", F.lit(EPS))).alias("vote"))


def _class_weights(seeds: DataFrame, classes: int, power: float) -> DataFrame:
    """(frame_id, index, weight): count**-power over all classes (empty ones count 1), mean one."""
    counts = seeds.groupBy(FRAME, "index").agg(F.count(F.lit(1)).alias("n"))
    grid = seeds.select(FRAME).distinct().withColumn("index", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    raw = grid.join(counts, [FRAME, "index"], "left").withColumn("raw", F.pow(F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).cast("double"), F.lit(-power)))
    mean = raw.groupBy(FRAME).agg(F.greatest(F.avg("raw"), F.lit(EPS)).alias("mean"))
    return raw.join(mean, FRAME).select(FRAME, "index", (F.col("raw") / F.col("mean")).alias("weight"))


def neighbour_repair(labels: DataFrame, edges: DataFrame, beta: float = 0.75, margin: float = 0.18) -> DataFrame:
    """One conservative vote: a valid label changes only if another class's score leads by over ``margin``.

    ``labels`` is (frame_id, sp_id, index, valid). A segment that is not valid keeps the larger of its index and 0.
    """
    ok = labels.where(F.col("valid") & (F.col("index") >= 0))
    votes = _votes(edges, ok.select(*SEGMENT, "index", F.lit(1.0).alias("weight")))
    parts = votes.select(*SEGMENT, "index", (beta * F.col("vote")).alias("s")).unionByName(ok.select(*SEGMENT, "index", F.lit(1.0).alias("s")))
    score = parts.groupBy(*SEGMENT, "index").agg(F.sum("s").alias("s"))
    best = score.groupBy(*SEGMENT).agg(F.max_by(F.struct("index", "s"), F.struct("s", -F.col("index"))).alias("b"))
    own = ok.join(score, [*SEGMENT, "index"]).select(*SEGMENT, F.col("s").alias("own"))
    out = labels.join(best, SEGMENT, "left").join(own, SEGMENT, "left")
    change = F.col("valid") & (F.col("index") >= 0) & (F.col("b.index") != F.col("index")) & (F.col("b.s") - F.col("own") > margin)
    return out.select(*SEGMENT, F.when(change, F.col("b.index")).otherwise(F.greatest("index", F.lit(0))).alias("index"))


def _heads(primary: DataFrame, auxiliary: DataFrame, void: int | None) -> DataFrame:
    """Both heads by segment, with their usability and agreement; ``void`` (an index) never agrees."""
    ok = lambda p: F.col(f"{p}_valid") & (F.col(f"{p}_idx") >= 0)
    both = primary.select(*SEGMENT, F.col("index").alias("p_idx"), F.col("valid").alias("p_valid")).join(auxiliary.select(*SEGMENT, F.col("index").alias("a_idx"), F.col("valid").alias("a_valid")), SEGMENT)
    both = both.withColumns({"p_ok": ok("p"), "a_ok": ok("a")})
    solid = F.lit(True) if void is None else F.col("p_idx") != void
    return both.withColumn("agree", F.col("p_ok") & F.col("a_ok") & (F.col("p_idx") == F.col("a_idx")) & solid)


def dual_prior_refine(primary: DataFrame, auxiliary: DataFrame, edges: DataFrame, classes: int, neighbour_weight: float = 0.65, aux_weight: float = 0.75, power: float = 0.35, void: int | None = None) -> DataFrame:
    """Both heads' votes plus class-balanced votes of neighbours on which they agree; no score at all means class 0."""
    both = _heads(primary, auxiliary, void)
    seeds = both.where("agree").select(*SEGMENT, F.col("p_idx").alias("index"))
    votes = _votes(edges, seeds.join(_class_weights(seeds, classes, power), [FRAME, "index"]))
    parts = both.where("p_ok").select(*SEGMENT, F.col("p_idx").alias("index"), F.lit(1.0).alias("s"))
    parts = parts.unionByName(both.where("a_ok").select(*SEGMENT, F.col("a_idx").alias("index"), F.lit(aux_weight).alias("s")))
    parts = parts.unionByName(votes.select(*SEGMENT, "index", (neighbour_weight * F.col("vote")).alias("s")))
    score = parts.groupBy(*SEGMENT, "index").agg(F.sum("s").alias("s"))
    best = score.groupBy(*SEGMENT).agg(F.max_by("index", F.struct("s", -F.col("index"))).alias("index"))
    return both.select(*SEGMENT).join(best, SEGMENT, "left").fillna(0, ["index"])


def consensus_refine(primary: DataFrame, auxiliary: DataFrame, edges: DataFrame, classes: int, confidence: float = 0.42, margin: float = 0.10, power: float = 0.25, void: int = 0) -> DataFrame:
    """Disagreements alone are settled by neighbours' consensus, the auxiliary label before any other; void is no opinion."""
    both = _heads(primary, auxiliary, None)
    both = both.withColumns({"p_ok": F.col("p_ok") & (F.col("p_idx") != void), "a_ok": F.col("a_ok") & (F.col("a_idx") != void)})
    both = both.withColumn("agree", F.col("p_ok") & F.col("a_ok") & (F.col("p_idx") == F.col("a_idx")))
    seeds = both.where("agree").select(*SEGMENT, F.col("p_idx").alias("index"))
    votes = _votes(edges, seeds.join(_class_weights(seeds, classes, power), [FRAME, "index"]))
    best = votes.groupBy(*SEGMENT).agg(F.max_by(F.struct("index", "vote"), F.struct("vote", -F.col("index"))).alias("b"))
    own = lambda p: both.select(*SEGMENT, F.col(f"{p}_idx").alias("index")).join(votes, [*SEGMENT, "index"]).select(*SEGMENT, F.col("vote").alias(f"{p}_vote"))
    out = both.join(best, SEGMENT, "left").join(own("p"), SEGMENT, "left").join(own("a"), SEGMENT, "left").fillna(0.0, ["p_vote", "a_vote"])
    top, top_idx = F.coalesce(F.col("b.vote"), F.lit(0.0)), F.coalesce(F.col("b.index"), F.lit(0))
    disagree = F.col("p_ok") & F.col("a_ok") & (F.col("p_idx") != F.col("a_idx"))
    aux = disagree & (F.col("a_vote") > F.col("p_vote") + margin) & (F.col("a_vote") >= confidence)
    other = disagree & (top >= confidence) & (top_idx != F.col("p_idx")) & (top > F.col("p_vote") + margin)
    pred = F.when(aux, F.col("a_idx")).when(other, top_idx).when(F.col("p_ok"), F.col("p_idx")).when(F.col("a_ok"), F.col("a_idx")).otherwise(void)
    return out.select(*SEGMENT, pred.alias("index"))


def dual_scale_refine(small: DataFrame, large: DataFrame, edges: DataFrame, classes: int, sure: float = 0.10, unsure: float = 0.14, vote_weight: float = 0.90, power: float = 0.25) -> DataFrame:
    """Predictions of two scales (frame_id, sp_id, index, confidence): sure agreements are class-balanced seeds,
    whose votes count where the scales disagree or neither is sure."""
    both = small.select(*SEGMENT, F.col("index").alias("p"), F.col("confidence").alias("pc")).join(large.select(*SEGMENT, F.col("index").alias("a"), F.col("confidence").alias("ac")), SEGMENT)
    conf = F.greatest("pc", "ac")
    seeds = both.where((F.col("p") == F.col("a")) & (conf >= sure)).select(*SEGMENT, F.col("p").alias("index"))
    votes = _votes(edges, seeds.join(_class_weights(seeds, classes, power), [FRAME, "index"]), least=0.0)
    doubt = both.where((F.col("p") != F.col("a")) | (conf < unsure)).select(*SEGMENT)
    parts = both.select(*SEGMENT, F.col("p").alias("index"), F.greatest("pc", F.lit(0.05)).alias("s"))
    parts = parts.unionByName(both.select(*SEGMENT, F.col("a").alias("index"), (0.75 * F.greatest("ac", F.lit(0.05))).alias("s")))
    parts = parts.unionByName(votes.join(doubt, SEGMENT, "left_semi").select(*SEGMENT, "index", (vote_weight * F.col("vote")).alias("s")))
    score = parts.groupBy(*SEGMENT, "index").agg(F.sum("s").alias("s"))
    return score.groupBy(*SEGMENT).agg(F.max_by("index", F.struct("s", -F.col("index"))).alias("index"))


def corrupt_boundaries(labels: DataFrame, edges: DataFrame, rate: float = 0.25, seed: int = 0, void: int = 0) -> DataFrame:
    """Labels copied across a keyed choice of boundary edges, rate x segments of them and one at least per frame.

    ``labels`` is (frame_id, sp_id, label, valid); of several edges into a segment the last in key order wins.
    """
    ends = edges.join(labels.select(FRAME, F.col("sp_id").alias("src"), F.col("label").alias("ls"), F.col("valid").alias("vs")), [FRAME, "src"]).join(labels.select(FRAME, F.col("sp_id").alias("dst"), F.col("label").alias("ld")), [FRAME, "dst"])
    n = labels.groupBy(FRAME).agg(F.greatest(F.floor(F.count(F.lit(1)) * rate), F.lit(1)).alias("take"))
    w = Window.partitionBy(FRAME).orderBy(F.xxhash64(F.lit(seed), "src", "dst"), "src", "dst")
    chosen = ends.where((F.col("ls") != F.col("ld")) & (F.col("ls") != void) & (F.col("ld") != void) & F.col("vs")).withColumn("r", F.row_number().over(w)).join(n, FRAME).where(F.col("r") <= F.col("take"))
    last = chosen.groupBy(FRAME, F.col("dst").alias("sp_id")).agg(F.max_by("ls", "r").alias("copied"))
    return labels.join(last, SEGMENT, "left").select(*SEGMENT, F.coalesce("copied", "label").alias("label"), (F.col("valid") | F.col("copied").isNotNull()).alias("valid"))


def bleeding(edges: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per frame over edges with known truth: leak rate, mean weights within and across true classes, their gap.

    Leaks are edges across true classes whose ends are predicted alike.
    """
    known = truth.where(F.col("label") >= 0)
    for end, key in (("s", "src"), ("d", "dst")):
        edges = edges.join(known.select(FRAME, F.col("sp_id").alias(key), F.col("label").alias(f"gt_{end}")), [FRAME, key])
        edges = edges.join(predicted.select(FRAME, F.col("sp_id").alias(key), F.col("label").alias(f"p_{end}")), [FRAME, key])
    differ = F.col("gt_s") != F.col("gt_d")
    agg = edges.groupBy(FRAME).agg(
        F.count(F.lit(1)).alias("edges"),
        F.avg((differ & (F.col("p_s") == F.col("p_d"))).cast("double")).alias("leak_rate"),
        F.coalesce(F.avg(F.when(~differ, F.col("w"))), F.lit(0.0)).alias("w_same"),
        F.coalesce(F.avg(F.when(differ, F.col("w"))), F.lit(0.0)).alias("w_diff"),
    )
    return agg.withColumn("gap", F.col("w_same") - F.col("w_diff"))


def smooth_labels(labels: DataFrame, edges: DataFrame, inertia: float = 0.85, steps: int = 2) -> DataFrame:
    """Synchronous weighted majorities of neighbours plus ``inertia`` for the own label; ties to the own label, then to the smaller."""
    now = labels.select(*SEGMENT, "label")
    both = undirected(edges.select(FRAME, "src", "dst", "w"))
    for _ in range(steps):
        near = both.join(now.withColumnRenamed("sp_id", "dst"), [FRAME, "dst"]).select(FRAME, F.col("src").alias("sp_id"), "label", "w", F.lit(0).alias("own"))
        votes = near.unionByName(now.select(*SEGMENT, "label", F.lit(inertia).alias("w"), F.lit(1).alias("own")))
        sums = votes.groupBy(*SEGMENT, "label").agg(F.sum("w").alias("v"), F.max("own").alias("own"))
        now = sums.groupBy(*SEGMENT).agg(F.max_by("label", F.struct("v", "own", -F.col("label"))).alias("label"))
    return now


def describe_clusters(nodes: DataFrame) -> DataFrame:
    """Per cluster: segments, points, mean descriptors and a name for its shape, most points first within a frame.

    ``nodes`` is (frame_id, cluster, n, height, linearity, planarity, scattering), height scaled to 0..1.
    """
    agg = nodes.groupBy(FRAME, "cluster").agg(F.count(F.lit(1)).alias("segments"), F.sum("n").alias("points"), *[F.avg(c).alias(c) for c in ("height", "linearity", "planarity", "scattering")])
    h, lin, pla, sca = (F.col(c) for c in ("height", "linearity", "planarity", "scattering"))
    # Names and thresholds.
    name = (
        F.when((pla >= F.greatest(lin, sca)) & (h < 0.35), "low planar surface")
        .when(pla >= F.greatest(lin, sca), "elevated planar structure")
        .when((sca >= F.greatest(lin, pla)) & (h >= 0.35), "elevated rough object")
        .when(lin >= F.greatest(pla, sca), "linear edge or strip")
        .when(h < 0.25, "low open ground")
        .otherwise("mixed geometric primitive")
    )
    w = Window.partitionBy(FRAME).orderBy(F.col("points").desc(), "cluster")
    return agg.withColumn("name", name).withColumn("rank", F.row_number().over(w))


def dense_ids(labels: DataFrame, column: str = "label", out: str = "cluster") -> DataFrame:
    """Labels as 0..n-1 in ascending order per frame; distinct labels are ranked."""
    ids = labels.select(FRAME, column).distinct().withColumn(out, F.row_number().over(Window.partitionBy(FRAME).orderBy(column)) - 1)
    return labels.join(ids, [FRAME, column])
