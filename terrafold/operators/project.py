"""Camera geometry and rasters: footprints, pixel sampling, views, top surfaces, depth buffers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import project_pinhole, project_x_forward

FRAME = "frame_id"


def with_projection(points: DataFrame, x_forward: bool = True, **camera) -> DataFrame:
    """Add u, v, depth and valid."""
    f = project_x_forward if x_forward else project_pinhole
    return points.select("*", *f(F.col("x"), F.col("y"), F.col("z"), **camera))


def footprint(projected: DataFrame, width: int, height: int) -> DataFrame:
    """Add the pixel (rounded half to even) and whether it is kept: valid and inside the raster."""
    col, row = F.rint("u").cast("int"), F.rint("v").cast("int")
    keep = F.col("valid") & (F.rint("u") >= 0) & (F.rint("u") < width) & (F.rint("v") >= 0) & (F.rint("v") < height)
    return projected.withColumns({"col": F.when(keep, col), "row": F.when(keep, row), "keep": keep})


def sample_pixels(footprints: DataFrame, raster: DataFrame, keys: list[str], missing: float = 0.0, value: str = "score") -> DataFrame:
    """The raster's value at every kept pixel; points that are not kept or whose pixel is absent get ``missing``."""
    return footprints.join(raster.select(*keys, "row", "col", value), [*keys, "row", "col"], "left").fillna(missing, [value])


def sample_terms(footprints: DataFrame, raster: DataFrame, terms: DataFrame, missing: float = 0.0) -> DataFrame:
    """One row per point and term; ``terms`` (term, term_idx) is the vocabulary, a few hundred rows."""
    return sample_pixels(footprints.crossJoin(F.broadcast(terms)), raster, [FRAME, "term"] if FRAME in raster.columns else ["term"], missing)


def bilinear(points: DataFrame, raster: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """Bilinear samples at (u, v), corners aligned, zero outside and for invalid points: (.., point_id, value)."""
    u0, v0 = F.floor("u"), F.floor("v")
    near = F.array(*[F.struct((v0 + dy).cast("int").alias("row"), (u0 + dx).cast("int").alias("col"), (F.abs(1 - dx - (F.col("u") - u0)) * F.abs(1 - dy - (F.col("v") - v0))).alias("w")) for dx in (0, 1) for dy in (0, 1)])
    # only valid points have pixels: others may lie beyond what an integer holds, and meet no raster
    ends = points.where("valid").select(FRAME, "point_id", F.explode(near).alias("e")).select(FRAME, "point_id", "e.*")
    hit = ends.join(raster.select(*keys, "row", "col", value), [*keys, "row", "col"], "left").select(FRAME, "point_id", F.coalesce(F.col("w") * F.col(value), F.lit(0.0)).alias(value))
    rest = points.where(~F.coalesce("valid", F.lit(False))).select(FRAME, "point_id", F.lit(0.0).alias(value))
    return hit.unionByName(rest).groupBy(FRAME, "point_id").agg(F.sum(value).alias(value))


def fuse_views(views: DataFrame, value: str = "score") -> DataFrame:
    """Per point the mean and population variance over its valid views and their number, at least one."""
    v, ok = F.col(value), F.col("valid").cast("double")
    n = F.greatest(F.sum(ok), F.lit(1.0))
    out = views.groupBy(FRAME, "point_id").agg(n.alias("views"), (F.sum(F.when(F.col("valid"), v).otherwise(0.0)) / n).alias("mean"), F.var_pop(F.when(F.col("valid"), v)).alias("var"))
    return out.fillna(0.0, ["var"])


def rigid_transform(points: DataFrame, matrix: list[list[float]], inverse: bool = False) -> DataFrame:
    """Points times a 4x4 pose; a 4x4 inverse is the driver's work."""
    m = np.linalg.inv(np.array(matrix, dtype=float)) if inverse else np.array(matrix, dtype=float)
    return points.withColumns({a: F.col("x") * float(r[0]) + F.col("y") * float(r[1]) + F.col("z") * float(r[2]) + float(r[3]) for a, r in zip("xyz", m, strict=False)})


def sign_search(points: DataFrame, raster: DataFrame, width: int, height: int, **camera) -> DataFrame:
    """The axis signs under which most point colours equal their pixel's: 1000 x matches + valid points, first of equals."""
    signs = [(1.0, 1.0), (1.0, -1.0), (-1.0, 1.0), (-1.0, -1.0)]
    scored = []
    for i, (ys, zs) in enumerate(signs):
        seen = footprint(with_projection(points, y_sign=ys, z_sign=zs, width=width, height=height, **camera), width, height)
        hit = seen.join(raster.select(FRAME, "row", "col", F.col("color").alias("pixel")), [FRAME, "row", "col"], "left")
        scored.append(hit.groupBy(FRAME).agg((1000.0 * F.coalesce(F.avg(F.when(F.col("keep"), (F.col("color") == F.col("pixel")).cast("double"))), F.lit(0.0)) + F.sum(F.col("valid").cast("int"))).alias("score")).select(FRAME, F.lit(i).alias("place"), F.lit(ys).alias("y_sign"), F.lit(zs).alias("z_sign"), "score"))
    every = scored[0].unionByName(scored[1]).unionByName(scored[2]).unionByName(scored[3])
    best = F.max_by(F.struct("y_sign", "z_sign", "score"), F.struct("score", -F.col("place")))
    return every.groupBy(FRAME).agg(best.alias("b")).select(FRAME, "b.*")


def top_surface(points: DataFrame, cell: float, values: list[str], by: str = "z") -> DataFrame:
    """Per pixel of edge ``cell`` the highest point's values (ties: the largest point_id)."""
    px, py = F.floor(F.col("x") / cell).cast("bigint"), F.floor(F.col("y") / cell).cast("bigint")
    top = points.groupBy(FRAME, px.alias("px"), py.alias("py")).agg(F.max(F.struct(by, "point_id", *[v for v in values if v != by])).alias("t"), F.count(F.lit(1)).alias("n"))
    return top.select(FRAME, "px", "py", F.col(f"t.{by}").alias("top"), *[F.col(f"t.{v}").alias(v) for v in values if v != by], "n")


def depth_buffer(projected: DataFrame, width: int, height: int, radius: int, values: list[str]) -> DataFrame:
    """The nearest point of every pixel after each point is splatted as a disk."""
    disk = [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in disk])
    spread = projected.where("valid").withColumn("o", F.explode(offsets))
    spread = spread.withColumns({"col": F.rint("u").cast("int") + F.col("o.dx"), "row": F.rint("v").cast("int") + F.col("o.dy")})
    spread = spread.where(F.col("col").between(0, width - 1) & F.col("row").between(0, height - 1))
    best = spread.groupBy(FRAME, "row", "col").agg(F.min(F.struct("depth", "point_id", *values)).alias("b"))
    return best.select(FRAME, "row", "col", "b.*")


def fill_holes(raster: DataFrame, frames: DataFrame, width: int, height: int, radius: int, value: str) -> DataFrame:
    """Every pixel with the value of the nearest valid one within ``radius`` (ties: least row, then column); null beyond."""
    disk = [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dx * dx + dy * dy).alias("d")) for dx, dy in disk])
    spread = raster.select(FRAME, F.col("row").alias("r"), F.col("col").alias("c"), value, F.explode(offsets).alias("o"))
    near = spread.select(FRAME, (F.col("r") + F.col("o.dy")).alias("row"), (F.col("c") + F.col("o.dx")).alias("col"), F.struct("o.d", "r", "c", value).alias("s"))
    best = near.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).groupBy(FRAME, "row", "col").agg(F.min("s").alias("s"))
    grid = frames.select(FRAME).distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return grid.join(best, [FRAME, "row", "col"], "left").select(FRAME, "row", "col", F.col(f"s.{value}").alias(value))


def gaussian_smooth(raster: DataFrame, value: str, sigma: float, radius: int) -> DataFrame:
    """Weighted mean over the pixels present in a square of ``radius``."""
    taps = [(dx, dy, float(np.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)))) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dx, dy, w in taps])
    spread = raster.select(FRAME, "row", "col", value, F.explode(offsets).alias("o")).select(FRAME, (F.col("row") + F.col("o.dy")).alias("row"), (F.col("col") + F.col("o.dx")).alias("col"), F.col("o.w").alias("w"), F.col(value).alias("v"))
    mean = spread.groupBy(FRAME, "row", "col").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias(value))
    return mean.join(raster.select(FRAME, "row", "col"), [FRAME, "row", "col"], "left_semi")


def stretch_contrast(raster: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """1st to 99th percentile of a frame to 0..1, clipped."""
    from .geometry import robust_min_max

    return robust_min_max(raster, value, low=low, high=high)


def downsample(raster: DataFrame, keys: list[str], factor: int, width: int, height: int, value: str = "score") -> DataFrame:
    """Bilinear reduction by ``factor`` with pixel centres aligned (corners not); absent pixels are zero."""
    w, h = max(1, width // factor), max(1, height // factor)

    def taps(n_out: int, n_in: int) -> list[tuple[int, int, float]]:
        out = []
        for i in range(n_out):
            at = min(max((i + 0.5) * n_in / n_out - 0.5, 0.0), n_in - 1.0)
            lo = int(at)
            hi = min(lo + 1, n_in - 1)
            out += [(lo, i, 1 - (at - lo)), (hi, i, at - lo)]
        return [t for t in out if t[2] > 0]

    spark = raster.sparkSession
    # a few numbers per raster line
    rows = F.broadcast(spark.createDataFrame(taps(h, height), "row int, out_row int, wr double"))
    cols = F.broadcast(spark.createDataFrame(taps(w, width), "col int, out_col int, wc double"))
    hit = raster.join(rows, "row").join(cols, "col")
    return hit.groupBy(*keys, F.col("out_row").alias("row"), F.col("out_col").alias("col")).agg(F.sum(F.col(value) * F.col("wr") * F.col("wc")).alias(value))


def crop_views(frames: DataFrame) -> DataFrame:
    """The full view and its four quadrants as boxes (view, x0, y0, x1, y1) of ``(frame_id, width, height)``."""
    w, h = F.col("width"), F.col("height")
    mw, mh = F.floor(w / 2).cast("int"), F.floor(h / 2).cast("int")
    zero = F.lit(0)
    boxes = [("full", zero, zero, w, h), ("crop00", zero, zero, mw, mh), ("crop01", mw, zero, w, mh), ("crop10", zero, mh, mw, h), ("crop11", mw, mh, w, h)]
    views = F.array(*[F.struct(F.lit(n).alias("view"), a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1")) for n, a, b, c, d in boxes])
    return frames.select(FRAME, F.explode(views).alias("v")).select(FRAME, "v.*")


def square_box(u: Column, v: Column, size: int, width: int, height: int) -> list[Column]:
    """A box of edge ``size`` around (u, v), rounded half to even and clamped to the image; ``empty`` if nothing is left."""
    edge = lambda c, d, n: F.least(F.greatest(F.rint(c + d), F.lit(0.0)), F.lit(float(n))).cast("int")
    x0, y0, x1, y1 = edge(u, -size / 2, width), edge(v, -size / 2, height), edge(u, size / 2, width), edge(v, size / 2, height)
    return [x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), ((x1 <= x0) | (y1 <= y0)).alias("empty")]


def rank_pixels(raster: DataFrame, value: str, k: int) -> DataFrame:
    """The k best pixels of a frame."""
    w = Window.partitionBy(FRAME).orderBy(F.col(value).desc(), "row", "col")
    return raster.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
