"""Segments of points: aggregates, voxel partitions, descriptors, neighbours, edge weights.

Points are ``(frame_id, point_id, x, y, z, intensity)``, segments ``(frame_id, sp_id)``, edges
``(frame_id, src, dst)``. A frame is one sensor sweep; its segments are bounded by
the partition's target, so a frame's segments may meet in one task, its points never have to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import EPS, clamp, eigenvalues3
from .lineage import written

FRAME = "frame_id"
SEGMENT = ["frame_id", "sp_id"]
AXES = ("x", "y", "z")
GATE = ["var_x", "var_y", "var_z", "var_i", "log_n", "linearity", "planarity", "scattering"]


def _dense(stats: DataFrame, segments: DataFrame | None, columns: list[str]) -> DataFrame:
    """Every segment of ``segments`` with ``columns``, 0.0 where it has no points."""
    if segments is None:
        return stats
    return segments.select(*SEGMENT).join(stats, SEGMENT, "left").fillna(0.0, columns)


def segment_sum(points: DataFrame, value: str, segments: DataFrame | None = None, out: str = "total") -> DataFrame:
    return _dense(points.groupBy(*SEGMENT).agg(F.sum(value).alias(out)), segments, [out])


def segment_mean(points: DataFrame, value: str, segments: DataFrame | None = None, out: str = "mean") -> DataFrame:
    return _dense(points.groupBy(*SEGMENT).agg(F.avg(value).alias(out)), segments, [out])


def segment_stats(points: DataFrame, value: str, segments: DataFrame | None = None) -> DataFrame:
    """n, sum, mean, max and upper quartile (linear) per segment; empty segments are all zero."""
    v = F.col(value)
    stats = points.groupBy(*SEGMENT).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.max(v).alias("top"), F.percentile(v, F.lit(0.75)).alias("q75"))
    return _dense(stats, segments, ["n", "total", "mean", "top", "q75"])


def segment_top_mean(points: DataFrame, value: str, share: float = 0.25, out: str = "top_mean") -> DataFrame:
    """Mean of the best ``share`` of each segment's values, at least one."""
    w = Window.partitionBy(*SEGMENT)
    ranked = points.select(*SEGMENT, F.col(value).alias("v"), F.row_number().over(w.orderBy(F.col(value).desc())).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    return ranked.where(F.col("r") <= F.greatest(F.lit(1.0), F.rint(F.col("n") * share))).groupBy(*SEGMENT).agg(F.avg("v").alias(out))


def superpoint_geometry(points: DataFrame) -> DataFrame:
    """Centre, count, the eight-value gate vector and ascending eigenvalues, in one aggregation.

    Moments are taken about the frame's first corner so large coordinates lose no digits.
    """
    low = points.groupBy(FRAME).agg(*[F.min(a).alias(f"o{a}") for a in AXES])
    local = points.join(low, FRAME)
    p = {a: F.col(a) - F.col(f"o{a}") for a in AXES}
    sums = [F.count(F.lit(1)).alias("n"), F.var_pop("intensity").alias("var_i"), *[F.first(f"o{a}").alias(f"o{a}") for a in AXES], *[F.avg(p[a]).alias(f"m{a}") for a in AXES]]
    sums += [F.avg(p[a] * p[b]).alias(f"m{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]
    agg = local.groupBy(*SEGMENT).agg(*sums)
    cov = {a + b: F.col(f"m{a}{b}") - F.col(f"m{a}") * F.col(f"m{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")}
    agg = agg.withColumns({f"c{k}": F.greatest(v, F.lit(0.0)) if k[0] == k[1] else v for k, v in cov.items()})
    l1, l2, l3 = eigenvalues3(*[F.col(f"c{k}") for k in ("xx", "yy", "zz", "xy", "xz", "yz")])
    agg = agg.withColumns({"l1": l1, "l2": l2, "l3": l3}).withColumn("scale", F.greatest(F.col("l3"), F.lit(1e-8)))
    return agg.select(
        *SEGMENT,
        "n",
        *[(F.col(f"m{a}") + F.col(f"o{a}")).alias(f"c{a}") for a in AXES],
        *[F.col(f"c{a}{a}").alias(f"var_{a}") for a in AXES],
        "var_i",
        F.log1p(F.col("n").cast("double")).alias("log_n"),
        ((F.col("l3") - F.col("l2")) / F.col("scale")).alias("linearity"),
        ((F.col("l2") - F.col("l1")) / F.col("scale")).alias("planarity"),
        (F.col("l1") / F.col("scale")).alias("scattering"),
        "l1",
        "l2",
        "l3",
    )


def segment_rgb(points: DataFrame) -> DataFrame:
    """Mean and population variance of colour and the share of coloured points: seven values a segment."""
    c = [F.avg(x).alias(f"mean_{x}") for x in "rgb"] + [F.coalesce(F.var_pop(x), F.lit(0.0)).alias(f"var_{x}") for x in "rgb"]
    return points.groupBy(*SEGMENT).agg(*c, F.avg(F.col("r").isNotNull().cast("double")).alias("rgb_share"))


def voxel_partition(points: DataFrame, size: Column | float) -> DataFrame:
    """Add ``sp_id``: voxels of edge ``size`` from the frame's corner, numbered in lexicographic order.

    Voxels are ranked, not points: one row per occupied voxel reaches the window.
    """
    size = F.lit(float(size)) if isinstance(size, (int, float)) else size
    low = points.groupBy(FRAME).agg(*[F.min(a).alias(f"o{a}") for a in AXES])
    step = F.greatest(size, F.lit(EPS))
    cells = points.join(low, FRAME).withColumns({f"v{a}": F.floor((F.col(a) - F.col(f"o{a}")) / step) for a in AXES}).drop("ox", "oy", "oz")
    voxel = [FRAME, "vx", "vy", "vz"]
    ids = cells.select(*voxel).distinct().withColumn("sp_id", F.row_number().over(Window.partitionBy(FRAME).orderBy("vx", "vy", "vz")).cast("bigint") - 1)
    return cells.join(ids, voxel).drop("vx", "vy", "vz")


def adaptive_voxel_size(points: DataFrame, target: int, least: float = 0.35) -> DataFrame:
    """(frame_id, n, size): the cube root of the span's volume per target segment, at least ``least``."""
    spans = points.groupBy(FRAME).agg(F.count(F.lit(1)).alias("n"), *[F.greatest(F.max(a) - F.min(a), F.lit(EPS)).alias(f"s{a}") for a in AXES])
    size = F.lit(least) if target <= 0 else F.greatest(F.lit(least), F.pow(F.col("sx") * F.col("sy") * F.col("sz"), F.lit(1 / 3)) / F.pow(F.lit(float(target)), F.lit(1 / 3)))
    return spans.select(FRAME, "n", size.alias("size"))


def adaptive_partition(points: DataFrame, target: int, least: float = 0.8, overshoot: float = 1.25, passes: int = 1) -> DataFrame:
    """Voxels of adaptive size, enlarged where a frame has over ``overshoot * target`` of them.

    ``passes`` bounds the corrections. A target of zero or of all points gives every point its own segment.
    """
    sizes = adaptive_voxel_size(points, target, least)
    whole = (F.lit(target) <= 0) | (F.lit(target) >= F.col("n"))
    for _ in range(passes):
        voxels = voxel_partition(points.join(sizes, FRAME), F.col("size"))
        found = voxels.groupBy(FRAME).agg((F.max("sp_id") + 1).alias("found"))
        ratio = F.col("found") / float(max(target, 1))
        sizes = sizes.join(found, FRAME).select(FRAME, "n", F.when(F.col("found") > overshoot * target, F.col("size") * F.pow(ratio, F.lit(1 / 3))).otherwise(F.col("size")).alias("size"))
        if passes > 1:  # a row a frame; without this the plan doubles with every pass
            sizes = written(sizes, "voxel-sizes")
    out = voxel_partition(points.join(sizes, FRAME), F.col("size"))
    own = F.row_number().over(Window.partitionBy(FRAME).orderBy("point_id")).cast("bigint") - 1
    if target <= 0:
        return out.withColumn("sp_id", own).drop("size", "n")
    small = out.where(whole).withColumn("sp_id", own)
    return out.where(~whole).unionByName(small).drop("size", "n")


def external_partition(points: DataFrame, partition: DataFrame) -> DataFrame:
    """Points with the segments of another partition ``(frame_id, point_id, sp_id)``; descriptors follow from the result."""
    return points.drop("sp_id").join(partition.select(FRAME, "point_id", "sp_id"), [FRAME, "point_id"])


#: Segments of a frame that one task takes; larger frames meet tile by tile.
MOST_SEGMENTS = 4096
#: Positions that are compared with all positions of the boxes near them at once.
LEAF = 64


def _leaves(at: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """Rows of ``at`` in boxes of at most ``most``, halved along the widest side."""
    todo, out = [np.arange(len(at))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        part = at[rows]
        half = len(rows) // 2
        order = np.argpartition(part[:, int(np.argmax(part.max(axis=0) - part.min(axis=0)))], half)
        todo += [rows[order[half:]], rows[order[:half]]]
    return [r for r in out if len(r)]


def _distances(own: np.ndarray, at: np.ndarray) -> np.ndarray:
    square = np.zeros((len(own), len(at)))
    for j in range(at.shape[1]):
        d = own[:, j : j + 1] - at[None, :, j]
        square += d * d
    return np.sqrt(square)


def nearest(ids: np.ndarray, own: np.ndarray, near: np.ndarray, at: np.ndarray, k: int, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``own``, id, distance): the exact ``k`` nearest of ``at`` by row, ties to the smaller id, none of the row's own id, none beyond ``reach``.

    Boxes of positions meet only the boxes that a bound on their kth distance reaches, so the work follows the
    number of positions. Of many at one place only the smallest ids can count.
    """
    none = np.zeros(0, dtype=np.int64), near[:0], np.zeros(0)
    fine = np.isfinite(at).all(axis=1)
    near, at = near[fine], at[fine]
    asking = np.flatnonzero(np.isfinite(own).all(axis=1))
    if not len(at) or not len(asking) or k < 1:
        return none
    order = np.lexsort((near, *at.T))
    near, at = near[order], at[order]
    first = np.r_[True, (at[1:] != at[:-1]).any(axis=1)]
    place = np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    take = k + int(np.unique(near, return_counts=True)[1].max())
    near, at = near[place < take], at[place < take]
    boxes = _leaves(at)
    low, high, size = np.array([at[r].min(axis=0) for r in boxes]), np.array([at[r].max(axis=0) for r in boxes]), np.array([len(r) for r in boxes])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [none]
    for block in _leaves(own[asking]):
        rows = asking[block]
        part = own[rows]
        apart = np.maximum(np.maximum(low - part.max(axis=0), part.min(axis=0) - high), 0)
        gap = np.sqrt((apart * apart).sum(axis=1))
        bound = np.inf if reach is None else reach[rows].max()
        close = np.argsort(gap, kind="stable")
        some = close[: 1 + int(np.searchsorted(np.cumsum(size[close]), take))]
        if size[some].sum() >= take:
            pick = np.concatenate([boxes[i] for i in some])
            d = _distances(part, at[pick])
            d[ids[rows, None] == near[None, pick]] = np.inf
            bound = min(bound, np.partition(d, k - 1, axis=1)[:, k - 1].max())
        pick = np.concatenate([boxes[i] for i in np.flatnonzero(gap <= bound * (1 + 1e-9))] or [np.zeros(0, dtype=np.int64)])
        if not len(pick):
            continue
        d = _distances(part, at[pick])
        d[ids[rows, None] == near[None, pick]] = np.inf
        most = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if len(pick) > k else np.full((len(rows), 1), np.inf)
        keep = np.isfinite(d) & (d <= most)
        if reach is not None:
            keep &= d <= reach[rows, None]
        i, j = np.nonzero(keep)
        found.append((rows[i], near[pick[j]], d[i, j]))
    row, dst, dist = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((dst, dist, row))
    row, dst, dist = row[order], dst[order], dist[order]
    first = np.r_[True, row[1:] != row[:-1]][: len(row)]
    best = np.arange(len(row)) - np.flatnonzero(first)[np.cumsum(first) - 1] < k
    return row[best], dst[best], dist[best]


def knn_edges(nodes: DataFrame, k: int = 8, farthest: float | None = None, position: tuple[str, ...] = ("cx", "cy", "cz"), most: int = MOST_SEGMENTS) -> DataFrame:
    """Exact directed k nearest neighbours within each frame: (frame_id, src, dst, dist), ties to the smaller id.

    A frame is one task, and positions meet only those near them. A frame of more than ``most`` segments is cut in slabs
    across its widest side, each a task; a segment whose kth distance reaches into other slabs asks there as well.
    """
    kind = nodes.schema[FRAME].dataType.simpleString()
    rows = nodes.select(FRAME, F.col("sp_id").cast("bigint").alias("sp_id"), *[F.col(c).cast("double").alias(c) for c in position])
    schema = f"frame_id {kind}, src bigint, dst bigint, dist double"

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ids, at = part["sp_id"].to_numpy(), part[list(position)].to_numpy()
        row, dst, dist = nearest(ids, at, ids, at, k)
        return pd.DataFrame({FRAME: key[0], "src": ids[row], "dst": dst, "dist": dist})

    large = rows.groupBy(FRAME).agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"s_{i}") for i, c in enumerate(position)]).where(F.col("n") > most).collect()
    if not large:
        out = rows.groupBy(FRAME).applyInPandas(run, schema)
    else:
        out = _knn_by_slabs(rows, large, k, list(position), most, kind)
    return out if farthest is None else out.where(F.col("dist") <= farthest)


def _knn_by_slabs(rows: DataFrame, large: list, k: int, position: list[str], most: int, kind: str) -> DataFrame:
    """``knn_edges`` where the frames of ``large`` (frame_id, n, extents) are cut; others are a slab of their own."""
    spark = rows.sparkSession
    span = lambda s: -1.0 if s["lo"] is None or not np.isfinite(s["hi"] - s["lo"]) else s["hi"] - s["lo"]
    wide = {r[FRAME]: max(range(len(position)), key=lambda i: span(r[f"s_{i}"])) for r in large}
    # a row a frame of over `most` segments
    axes = F.broadcast(spark.createDataFrame(list(wide.items()), f"frame_id {kind}, axis int"))
    along = F.element_at(F.array(*position), F.col("axis") + 1)
    slabs = -(-max(r["n"] for r in large) // most)
    ends = rows.join(axes, FRAME).groupBy(FRAME, "axis").agg(F.percentile_approx(along, [i / slabs for i in range(1, slabs)], 10_000).alias("cuts")).collect()
    cuts = {r[FRAME]: np.unique(np.array(r["cuts"] or [], dtype=float)) for r in ends}
    ends = F.broadcast(spark.createDataFrame([(f, wide[f], c.tolist()) for f, c in cuts.items()], f"frame_id {kind}, axis int, cuts array<double>"))
    tile = F.coalesce(F.size(F.filter("cuts", lambda c: c <= along)), F.lit(0)).alias("tile")
    dealt = lambda how: rows.join(ends, FRAME, how).select(FRAME, "sp_id", *position, tile)
    places = ", ".join(f"{c} double" for c in position)

    def within(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ids, at = part["sp_id"].to_numpy(), part[position].to_numpy()
        row, dst, dist = nearest(ids, at, ids, at, k)
        asks, is_open = [], np.zeros(len(ids), dtype=bool)
        if key[0] in cuts:
            edges, c = cuts[key[0]], at[:, wide[key[0]]]
            n = np.bincount(row, minlength=len(ids))
            reach = np.full(len(ids), -np.inf)
            np.maximum.at(reach, row, dist)
            reach[n < k] = np.inf
            reach[~np.isfinite(at).all(axis=1)] = -np.inf
            pad = reach + np.where(np.isfinite(reach), np.abs(reach) * 1e-9 + 4 * np.spacing(np.abs(np.nan_to_num(c))), 0)
            some = np.flatnonzero(reach >= 0)
            lo, hi = np.searchsorted(edges, c[some] - pad[some], "right"), np.searchsorted(edges, c[some] + pad[some], "right")
            many = hi - lo + 1
            who = np.repeat(some, many)
            other = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            who, other = who[other != key[1]], other[other != key[1]]
            is_open[who] = True
            asks = [pd.DataFrame({FRAME: key[0], "tile": other, "src": ids[who], "dst": pd.array([None] * len(who), dtype="Int64"), "dist": reach[who], "open": True, **{p: at[who, i] for i, p in enumerate(position)}})]
        own = pd.DataFrame({FRAME: key[0], "tile": key[1], "src": ids[row], "dst": pd.array(dst, dtype="Int64"), "dist": dist, "open": is_open[row], **{p: np.nan for p in position}})
        return pd.concat([own, *asks], ignore_index=True)

    first = written(dealt("left").groupBy(FRAME, "tile").applyInPandas(within, f"frame_id {kind}, tile int, src bigint, dst bigint, dist double, open boolean, {places}"), "neighbours")

    def across(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ask, give = part[part["reach"].notna()], part[part["reach"].isna()]
        ids = ask["sp_id"].to_numpy()
        row, dst, dist = nearest(ids, ask[position].to_numpy(), give["sp_id"].to_numpy(), give[position].to_numpy(), k, ask["reach"].to_numpy())
        return pd.DataFrame({FRAME: key[0], "src": ids[row], "dst": dst, "dist": dist})

    asks = first.where("dst IS NULL").select(FRAME, F.col("src").alias("sp_id"), *position, "tile", F.col("dist").alias("reach"))
    met = asks.unionByName(dealt("inner").withColumn("reach", F.lit(None).cast("double"))).groupBy(FRAME, "tile").applyInPandas(across, f"frame_id {kind}, src bigint, dst bigint, dist double")
    own = first.where("dst IS NOT NULL")
    edge = [FRAME, "src", "dst", "dist"]
    order = Window.partitionBy(FRAME, "src").orderBy("dist", "dst")
    rest = own.where("open").select(*edge).unionByName(met).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
    return own.where("NOT open").select(*edge).unionByName(rest)


def with_ends(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """``edges`` with ``columns`` of both end nodes, as ``<column>_s`` and ``<column>_d``."""
    for end, key in (("s", "src"), ("d", "dst")):
        edges = edges.join(nodes.select(FRAME, F.col("sp_id").alias(key), *[F.col(c).alias(f"{c}_{end}") for c in columns]), [FRAME, key])
    return edges


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, repeats kept."""
    back = edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionByName(back)


def z_scores(nodes: DataFrame, columns: list[str], sample: bool = True, by: str = FRAME) -> DataFrame:
    """Columns as z scores within a frame; deviations below 1e-6 (and those of single rows) count as 1e-6."""
    std = F.stddev_samp if sample else F.stddev_pop
    stats = nodes.groupBy(by).agg(*[F.avg(c).alias(f"a_{c}") for c in columns], *[F.greatest(F.coalesce(std(c), F.lit(0.0)), F.lit(EPS)).alias(f"d_{c}") for c in columns])
    out = nodes.join(stats, by)
    return out.withColumns({c: (F.col(c) - F.col(f"a_{c}")) / F.col(f"d_{c}") for c in columns}).drop(*[f"{p}_{c}" for c in columns for p in "ad"])


def min_max(nodes: DataFrame, column: str, by: str = FRAME) -> DataFrame:
    """A column scaled to 0..1 within a frame (ranges below 1e-6 count as 1e-6)."""
    s = nodes.groupBy(by).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return nodes.join(s, by).withColumn(column, (F.col(column) - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(EPS))).drop("lo", "hi")


def robust_min_max(nodes: DataFrame, column: str | list[str], out: str | None = None, by: str = FRAME, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Columns between their 2nd and 98th percentile as 0..1, clipped: one aggregation for all of them."""
    columns = [column] if isinstance(column, str) else column
    s = nodes.groupBy(by).agg(*[F.percentile(c, [low, high]).alias(f"q_{c}") for c in columns])
    q = lambda c, i: F.col(f"q_{c}")[i]
    scaled = {out or c: clamp((F.col(c) - q(c, 0)) / F.greatest(q(c, 1) - q(c, 0), F.lit(EPS)), 0.0, 1.0) for c in columns}
    return nodes.join(s, by).withColumns(scaled).drop(*[f"q_{c}" for c in columns])


def _distance(columns: list[str]) -> Column:
    total = F.lit(0.0)
    for c in columns:
        d = F.col(f"{c}_s") - F.col(f"{c}_d")
        total = total + d * d
    return F.sqrt(total)


def edge_weights(edges: DataFrame, nodes: DataFrame, gate_share: float = 0.55, tau: float = 1.0, gate: list[str] | None = None) -> DataFrame:
    """``w = exp(-(d_center + gate_share * d_gate) / (lower median * tau))`` on z-scored centres and gates."""
    gate = GATE if gate is None else gate
    z = z_scores(nodes, ["cx", "cy", "cz", *gate])
    far = with_ends(edges.select(FRAME, "src", "dst"), z, ["cx", "cy", "cz", *gate])
    far = far.select(FRAME, "src", "dst", (_distance(["cx", "cy", "cz"]) + gate_share * _distance(gate)).alias("d"))
    middle = far.groupBy(FRAME).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d)").alias("m"))
    return far.join(middle, FRAME).select(FRAME, "src", "dst", F.exp(-F.col("d") / (F.greatest(F.col("m"), F.lit(EPS)) * tau)).alias("w"))


def edge_features(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The twelve differences of an edge's ends (eight gate, three centre, their length), its heuristic weight, and whether labels agree.

    ``nodes`` has z-scorable centres and gates and a ``label`` (0: void, never equal).
    """
    z = z_scores(nodes, ["cx", "cy", "cz", *GATE])
    ends = with_ends(edges.select(FRAME, "src", "dst"), z, ["cx", "cy", "cz", *GATE, "label"])
    parts = [F.abs(F.col(f"{c}_s") - F.col(f"{c}_d")) for c in (*GATE, "cx", "cy", "cz")] + [_distance(["cx", "cy", "cz"])]
    same = (F.col("label_s") == F.col("label_d")) & (F.col("label_s") != 0)
    far = ends.select(FRAME, "src", "dst", F.array(*parts).alias("features"), same.alias("same"))
    far = far.withColumn("d", F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, v: s + v * v)))
    middle = far.groupBy(FRAME).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d)").alias("m"))
    return far.join(middle, FRAME).select(FRAME, "src", "dst", "features", "same", F.exp(-F.col("d") / F.greatest(F.col("m"), F.lit(EPS))).alias("w"))


def affinity(edges: DataFrame, nodes: DataFrame, features: list[str], power: float = 1.0, feature_share: float = 0.72) -> DataFrame:
    """Symmetric affinities: kernels of z-scored centres and of features over averaged medians, the larger of both directions kept."""
    d = with_ends(edges.select(FRAME, "src", "dst"), z_scores(nodes, ["cx", "cy", "cz"], sample=False), ["cx", "cy", "cz", *features]).select(FRAME, "src", "dst", _distance(["cx", "cy", "cz"]).alias("dx"), _distance(features).alias("df"))
    s = d.groupBy(FRAME).agg(F.median(F.when(F.col("dx") > 0, F.col("dx"))).alias("sx"), F.median(F.when(F.col("df") > 0, F.col("df"))).alias("sf"))
    scaled = lambda v, m: F.pow(F.col(v) / F.greatest(F.coalesce(F.col(m), F.lit(1.0)), F.lit(EPS)), F.lit(power))
    w = d.join(s, FRAME).withColumn("w", clamp(F.exp(-scaled("dx", "sx")) * F.exp(-feature_share * scaled("df", "sf")), 1e-6, 1.0))
    return w.groupBy(FRAME, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("w").alias("w"))


def nearest_within(points: DataFrame, sites: DataFrame, radius: float) -> DataFrame:
    """The nearest site within ``radius`` of every point (frame_id, point_id, site_id, dist): a range join over grid cells.

    Points stay in their own cell, sites, the fewer by far, go to the 27 around theirs, so the join is an equality and
    exact for this radius. Neither side is broadcast: Spark takes exploded rows for as few as there were before.
    ``min`` combines before the shuffle.
    """
    # a hair wider than the radius, so that a distance that rounds to the radius is met as well
    cell = lambda a: F.floor(F.col(a) / (radius * (1 + 1e-9)))
    near = F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))
    asked = points.select(FRAME, "point_id", *AXES, *[cell(a).alias(f"g{a}") for a in AXES])
    kept = sites.select(FRAME, "site_id", *AXES)
    for a in AXES:
        kept = kept.withColumn("step", near).withColumn(f"g{a}", cell(a) + F.col("step")).drop("step")
    kept = kept.select(FRAME, "site_id", *[F.col(a).alias(f"s{a}") for a in AXES], *[f"g{a}" for a in AXES])
    pairs = asked.join(kept.hint("merge"), [FRAME, "gx", "gy", "gz"])
    d = [F.col(a) - F.col(f"s{a}") for a in AXES]
    pairs = pairs.withColumn("dist", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).where(F.col("dist") <= radius)
    best = pairs.groupBy(FRAME, "point_id").agg(F.min(F.struct("dist", "site_id")).alias("b"))
    return best.select(FRAME, "point_id", F.col("b.site_id").alias("site_id"), F.col("b.dist").alias("dist"))


def majority(points: DataFrame, label: str = "label", by: list[str] | None = None, smallest: bool = False) -> DataFrame:
    """Most frequent label and its share per segment; ties go to the first seen (least point_id) or the smallest label."""
    by = SEGMENT if by is None else by
    counts = points.groupBy(*by, F.col(label).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("point_id").alias("first"))
    tie = -F.col("value") if smallest else -F.col("first")
    out = counts.groupBy(*by).agg(F.max_by(F.struct("value", "n"), F.struct("n", tie)).alias("m"), F.sum("n").alias("total"))
    return out.select(*by, F.col("m.value").alias(label), (F.col("m.n") / F.col("total")).alias("purity"))


def majority_valid(points: DataFrame, segments: DataFrame, label: str = "label") -> DataFrame:
    """Majority among labels >= 0; segments without one get -1."""
    return segments.select(*SEGMENT).join(majority(points.where(F.col(label) >= 0), label).drop("purity"), SEGMENT, "left").fillna(-1, [label])


def majority_official(points: DataFrame, segments: DataFrame, official: list[int], label: str = "label") -> DataFrame:
    """Majority among the official labels, ties to the smallest; segments without one get 0."""
    own = majority(points.where(F.col(label).isin(official)), label, smallest=True).drop("purity")
    return segments.select(*SEGMENT).join(own, SEGMENT, "left").fillna(0, [label])


def compact_labels(points: DataFrame, label: str = "label", void: int | None = 0, out: str = "label_id") -> DataFrame:
    """Labels as 0..n-1 in ascending order per frame, ``void`` as -1 (``None``: no void). Distinct values are ranked, not points."""
    values = points.select(FRAME, label).distinct()
    if void is not None:
        values = values.where(F.col(label) != void)
    ids = values.withColumn(out, F.row_number().over(Window.partitionBy(FRAME).orderBy(label)) - 1)
    return points.join(ids, [FRAME, label], "left").fillna(-1, [out])


def color_ids(points: DataFrame, color: str = "color") -> DataFrame:
    """Ids of colours per frame, black first, then ascending."""
    ids = points.select(FRAME, color).distinct().withColumn("color_id", F.row_number().over(Window.partitionBy(FRAME).orderBy(F.col(color) != 0, color)) - 1)
    return points.join(ids, [FRAME, color])


def remap_labels(points: DataFrame, values: list[int], label: str = "label", out: str = "index") -> DataFrame:
    """The place of each label in ``values``, -1 where it is not there."""
    place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(label)).cast("int") - 1
    return points.withColumn(out, F.coalesce(place, F.lit(-1)))


def not_supported(method: str) -> Iterator[None]:
    """Partitions that need a trained network are not part of this engine."""
    raise RuntimeError(f"{method} needs its own trained model; give its result to external_partition")
