"""Segments, projections, rasters and graphs over the fixture tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.numeric import q6
from ..operators import frames, geometry, graph, metrics, procedural, project
from ..operators.lineage import written
from . import fixtures as fx
from .fixtures import q6 as r6
from .registry import query

SEGMENT = geometry.SEGMENT


def rounded(df, *columns):
    return df.withColumns({c: q6(F.col(c)) for c in columns})


def r6s(*columns: str) -> str:
    return ", ".join(f"{r6(c)} AS {c}" for c in columns)


@query(f"WITH {fx.SP} SELECT frame_id, point_id, sp_id FROM sp")
def voxel_partition(spark, sf):
    return fx.segmented(spark, sf).select("frame_id", "point_id", "sp_id")


@query(f"WITH {fx.POINTS}, s AS (SELECT frame_id, count(*) AS n, greatest(0.35, pow(greatest(max(x) - min(x), 1e-6) * greatest(max(y) - min(y), 1e-6) * greatest(max(z) - min(z), 1e-6), 1.0 / 3) / pow(200.0, 1.0 / 3)) AS size FROM points GROUP BY frame_id) SELECT frame_id, n, {r6s('size')} FROM s")
def adaptive_voxel_size(spark, sf):
    return rounded(geometry.adaptive_voxel_size(fx.points(spark, sf), 200), "size")


_ADAPT = f"""WITH {fx.POINTS},
first_size AS (SELECT frame_id, count(*) AS n, greatest(0.8::DOUBLE, pow(greatest(max(x) - min(x), 1e-6) * greatest(max(y) - min(y), 1e-6) * greatest(max(z) - min(z), 1e-6), 1::DOUBLE / 3) / pow(100::DOUBLE, 1::DOUBLE / 3)) AS size FROM points GROUP BY frame_id),
p1 AS (SELECT p.*, n, size FROM points p JOIN first_size USING (frame_id)), {fx.segmented_sql('greatest(size, 1e-6)', 'p1', 's1')},
found AS (SELECT frame_id, max(sp_id) + 1 AS found FROM s1 GROUP BY frame_id),
second AS (SELECT frame_id, n, CASE WHEN found > 125 THEN size * pow(found::DOUBLE / 100, 1::DOUBLE / 3) ELSE size END AS size FROM first_size JOIN found USING (frame_id)),
p2 AS (SELECT p.*, n, size FROM points p JOIN second USING (frame_id)), {fx.segmented_sql('greatest(size, 1e-6)', 'p2', 's2')}
SELECT frame_id, point_id, CASE WHEN n <= 100 THEN row_number() OVER (PARTITION BY frame_id ORDER BY point_id) - 1 ELSE sp_id END AS sp_id FROM s2"""


@query(_ADAPT)
def adaptive_partition(spark, sf):
    return geometry.adaptive_partition(fx.points(spark, sf), 100).select("frame_id", "point_id", "sp_id")


def _pass_sql(i: int) -> str:
    """Correction i of the partition's voxel size, as geometry.adaptive_partition makes it."""
    return f"""q{i} AS MATERIALIZED (SELECT p.*, n, size FROM points p JOIN z{i} USING (frame_id)), {fx.segmented_sql('greatest(size, 1e-6)', f'q{i}', f't{i}')},
f{i} AS (SELECT frame_id, max(sp_id) + 1 AS found FROM t{i} GROUP BY frame_id),
z{i + 1} AS MATERIALIZED (SELECT frame_id, n, CASE WHEN found > 1.30::DOUBLE * 60 THEN size * pow(found::DOUBLE / 60, 1::DOUBLE / 3) ELSE size END AS size FROM z{i} JOIN f{i} USING (frame_id))"""


@query(f"""WITH {fx.POINTS},
z0 AS (SELECT frame_id, count(*) AS n, greatest(0.45::DOUBLE, pow(greatest(max(x) - min(x), 1e-6) * greatest(max(y) - min(y), 1e-6) * greatest(max(z) - min(z), 1e-6), 1::DOUBLE / 3) / pow(60::DOUBLE, 1::DOUBLE / 3)) AS size FROM points GROUP BY frame_id),
{', '.join(_pass_sql(i) for i in range(4))}, last AS (SELECT p.*, n, size FROM points p JOIN z4 USING (frame_id)), {fx.segmented_sql('greatest(size, 1e-6)', 'last', 'own')}
SELECT frame_id, point_id, CASE WHEN n <= 60 THEN row_number() OVER (PARTITION BY frame_id ORDER BY point_id) - 1 ELSE sp_id END AS sp_id FROM own""")
def adaptive_partition_iterated(spark, sf):
    return geometry.adaptive_partition(fx.points(spark, sf), 60, least=0.45, overshoot=1.30, passes=4).select("frame_id", "point_id", "sp_id")


_LINE = "pts AS (SELECT l_linenumber AS frame_id, floor(l_quantity / 5)::BIGINT * 100 + floor(l_discount * 100)::BIGINT AS sp_id, l_extendedprice / 1999::DOUBLE AS v FROM lineitem)"


@query(f"WITH {_LINE} SELECT frame_id, sp_id, count(*) AS n, {r6('sum(v)')} AS total, {r6('avg(v)')} AS mean, {r6('max(v)')} AS top, {r6('quantile_cont(v, 0.75)')} AS q75 FROM pts GROUP BY ALL")
def segment_stats(spark, sf):
    p = fx.load(spark, sf, "lineitem").select(F.col("l_linenumber").alias("frame_id"), (F.floor(F.col("l_quantity") / 5) * 100 + F.floor(F.col("l_discount") * 100)).alias("sp_id"), (F.col("l_extendedprice") / 1999.0).alias("v"))
    return rounded(geometry.segment_stats(p, "v"), "total", "mean", "top", "q75")


_EMPTY = f"""WITH {fx.SP}, kept AS (SELECT * FROM sp WHERE intensity < 0.3), ids AS (SELECT DISTINCT frame_id, sp_id FROM sp)"""


@query(f"{_EMPTY} SELECT frame_id, sp_id, {r6('coalesce(sum(intensity), 0)')} AS total FROM ids LEFT JOIN kept USING (frame_id, sp_id) GROUP BY ALL")
def segment_sum_dense(spark, sf):
    p = fx.segmented(spark, sf)
    return rounded(geometry.segment_sum(p.where("intensity < 0.3"), "intensity", p.select(*SEGMENT).distinct()), "total")


@query(f"{_EMPTY} SELECT frame_id, sp_id, {r6('coalesce(avg(intensity), 0)')} AS mean FROM ids LEFT JOIN kept USING (frame_id, sp_id) GROUP BY ALL")
def segment_mean_dense(spark, sf):
    p = fx.segmented(spark, sf)
    return rounded(geometry.segment_mean(p.where("intensity < 0.3"), "intensity", p.select(*SEGMENT).distinct()), "mean")


@query(f"WITH {fx.SP}, r AS (SELECT frame_id, sp_id, z, row_number() OVER (PARTITION BY frame_id, sp_id ORDER BY z DESC) AS r, count(*) OVER (PARTITION BY frame_id, sp_id) AS n FROM sp) SELECT frame_id, sp_id, {r6('avg(z)')} AS top_mean FROM r WHERE r <= greatest(1, round_even((n * 0.25)::DOUBLE, 0)) GROUP BY ALL")
def segment_top_mean(spark, sf):
    return rounded(geometry.segment_top_mean(fx.segmented(spark, sf), "z"), "top_mean")


_GEO = ["cx", "cy", "cz", *geometry.GATE, "l1", "l2", "l3"]


@query(f"WITH {fx.GEOMETRY} SELECT frame_id, sp_id, n, {r6s(*[c for c in _GEO if c not in ('linearity', 'planarity', 'scattering')])}, {', '.join(f'round_even({c} * 1e4, 0) / 1e4 + 0 AS {c}' for c in ('linearity', 'planarity', 'scattering'))} FROM nodes")
def superpoint_geometry(spark, sf):
    df = geometry.superpoint_geometry(fx.segmented(spark, sf))
    return rounded(df, *[c for c in _GEO if c not in ("linearity", "planarity", "scattering")]).withColumns({c: F.rint(F.col(c) * 1e4) / 1e4 + 0.0 for c in ("linearity", "planarity", "scattering")})


@query(f"WITH {fx.SP} SELECT frame_id, sp_id, {', '.join(r6(f'avg({c})') + f' AS mean_{c}' for c in 'rgb')}, {', '.join(r6(f'coalesce(var_pop({c}), 0)') + f' AS var_{c}' for c in 'rgb')}, {r6('avg((r IS NOT NULL)::INTEGER)')} AS rgb_share FROM (SELECT frame_id, sp_id, CASE WHEN point_id % 5 > 0 THEN r END AS r, CASE WHEN point_id % 5 > 0 THEN g END AS g, CASE WHEN point_id % 5 > 0 THEN b END AS b FROM sp) GROUP BY ALL")
def segment_rgb(spark, sf):
    p = fx.segmented(spark, sf)
    p = p.withColumns({c: F.when(F.col("point_id") % 5 > 0, F.col(c)) for c in "rgb"})
    return rounded(geometry.segment_rgb(p), *[f"mean_{c}" for c in "rgb"], *[f"var_{c}" for c in "rgb"], "rgb_share")


@query(f"WITH {fx.SP}, {fx.MAJORITY} SELECT frame_id, sp_id, label, {r6s('purity')} FROM majority")
def majority_purity(spark, sf):
    return rounded(geometry.majority(fx.segmented(spark, sf)), "purity")


@query(f"""WITH {fx.SP}, c AS (SELECT frame_id, sp_id, label, count(*) AS n, min(point_id) AS f FROM sp WHERE label - 2 >= 0 GROUP BY ALL), m AS (SELECT frame_id, sp_id, label - 2 AS label FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, sp_id ORDER BY n DESC, f) AS r FROM c) WHERE r = 1)
SELECT frame_id, sp_id, coalesce(label, -1) AS label FROM (SELECT DISTINCT frame_id, sp_id FROM sp) LEFT JOIN m USING (frame_id, sp_id)""")
def majority_valid(spark, sf):
    p = fx.segmented(spark, sf).withColumn("label", F.col("label") - 2)
    return geometry.majority_valid(p, p.select(*SEGMENT).distinct())


@query(f"""WITH {fx.SP}, c AS (SELECT frame_id, sp_id, label, count(*) AS n FROM sp WHERE label IN (1, 3, 5) GROUP BY ALL), m AS (SELECT frame_id, sp_id, label FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, sp_id ORDER BY n DESC, label) AS r FROM c) WHERE r = 1)
SELECT frame_id, sp_id, coalesce(label, 0) AS label FROM (SELECT DISTINCT frame_id, sp_id FROM sp) LEFT JOIN m USING (frame_id, sp_id)""")
def majority_official(spark, sf):
    p = fx.segmented(spark, sf)
    return geometry.majority_official(p, p.select(*SEGMENT).distinct(), [1, 3, 5])


@query(f"WITH {fx.POINTS}, p AS (SELECT *, (r // 32 * 7 % 5)::INTEGER AS c FROM points) SELECT frame_id, point_id, CASE WHEN c = 0 THEN -1 ELSE dense_rank() OVER (PARTITION BY frame_id, c <> 0 ORDER BY c) - 1 END AS label_id, dense_rank() OVER (PARTITION BY frame_id ORDER BY c <> 0, c) - 1 AS color_id, coalesce(list_position([4, 2, 9], c), 0) - 1 AS index FROM p")
def label_ids(spark, sf):
    p = fx.points(spark, sf).withColumn("c", (F.floor(F.col("r") / 32) * 7 % 5).cast("int"))
    p = geometry.compact_labels(p, "c")
    p = geometry.color_ids(p, "c")
    return geometry.remap_labels(p, [4, 2, 9], "c").select("frame_id", "point_id", "label_id", "color_id", "index")


@query(f"WITH {fx.POINTS} SELECT point_id, (r << 16) + (g << 8) + b AS packed, r, g, b FROM points")
def packed_colors(spark, sf):
    p = fx.points(spark, sf).withColumn("packed", numeric.pack_rgb(F.col("r"), F.col("g"), F.col("b")))
    return p.select("point_id", "packed", *numeric.unpack_rgb(F.col("packed")))


@query(f"WITH {fx.POINTS}, {fx.projected_sql('points', 'f')} SELECT frame_id, point_id, {r6s('u', 'v', 'depth')}, valid, keep, CASE WHEN keep THEN col END AS col, CASE WHEN keep THEN row END AS row FROM f")
def project_x_forward(spark, sf):
    p = project.footprint(project.with_projection(fx.points(spark, sf), **fx.CAMERA), 24, 30)
    return rounded(p, "u", "v", "depth").select("frame_id", "point_id", "u", "v", "depth", "valid", "keep", "col", "row")


_K, _T = [[20.0, 0.0, 16.0], [0.0, 18.0, 12.0], [0.0, 0.0, 1.0]], [[0.0, -1.0, 0.0, 7.0], [0.0, 0.0, -1.0, 2.0], [1.0, 0.0, 0.0, 1.5], [0.0, 0.0, 0.0, 1.0]]


@query(f"""WITH {fx.POINTS}, c AS (SELECT frame_id, point_id, -y + 7 AS ca, -z + 2 AS cb, x + 1.5 AS d FROM points), p AS (SELECT *, (20 * ca + 16 * d) / greatest(d, 1e-6) AS u, (18 * cb + 12 * d) / greatest(d, 1e-6) AS v FROM c)
SELECT frame_id, point_id, {r6s('u', 'v')}, {r6('d')} AS depth, d > 1e-6 AND u >= 0 AND u <= 31 AND v >= 0 AND v <= 23 AS valid FROM p""")
def project_pinhole(spark, sf):
    p = project.with_projection(fx.points(spark, sf), x_forward=False, k=_K, t=_T, width=32, height=24)
    return rounded(p, "u", "v", "depth").select("frame_id", "point_id", "u", "v", "depth", "valid")


@query(f"WITH {fx.POINTS} SELECT point_id, {r6('-y + 7')} AS x, {r6('-z + 2')} AS y, {r6('x + 1.5')} AS z FROM points")
def rigid_transform(spark, sf):
    return rounded(project.rigid_transform(fx.points(spark, sf), _T), "x", "y", "z").select("point_id", "x", "y", "z")


@query(f"WITH {fx.STATS} SELECT frame_id, sp_id, term, keep, count(*) AS n, {r6('sum(score)')} AS score FROM own GROUP BY ALL")
def pixel_sample(spark, sf):
    own, _ = fx.samples(spark, sf)
    return rounded(own.groupBy("frame_id", "sp_id", "term", "keep").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score")), "score")


_RASTER1 = "one AS (SELECT row, col, score FROM raster WHERE term = 'click')"


@query(f"""WITH {fx.POINTS}, {fx.RASTER}, {_RASTER1}, {fx.projected_sql('points', 'f')},
ends AS (SELECT frame_id, point_id, valid, (floor(u) + dx)::INTEGER AS col, (floor(v) + dy)::INTEGER AS row, abs(1 - dx - (u - floor(u))) * abs(1 - dy - (v - floor(v))) AS w FROM f CROSS JOIN (SELECT unnest([0, 1, 0, 1]) AS dx, unnest([0, 0, 1, 1]) AS dy))
SELECT frame_id, point_id, {r6('sum(CASE WHEN valid THEN w * coalesce(score, 0) ELSE 0 END)')} AS score FROM ends LEFT JOIN one USING (row, col) GROUP BY ALL""")
def bilinear_sample(spark, sf):
    p = project.with_projection(fx.points(spark, sf), **fx.CAMERA)
    return rounded(project.bilinear(p, fx.raster(spark, sf).where("term = 'click'"), []), "score")


@query(f"""WITH {fx.POINTS}, v AS (SELECT frame_id, point_id // 4 AS point_id, z AS score, point_id % 3 > 0 AS valid FROM points)
SELECT frame_id, point_id, greatest(sum(valid::INTEGER), 1)::DOUBLE AS views, {r6('sum(CASE WHEN valid THEN score ELSE 0 END) / greatest(sum(valid::INTEGER), 1)')} AS mean, {r6('coalesce(var_pop(CASE WHEN valid THEN score END), 0)')} AS var FROM v GROUP BY ALL""")
def multiview_fusion(spark, sf):
    v = fx.points(spark, sf).select("frame_id", F.floor(F.col("point_id") / 4).alias("point_id"), F.col("z").alias("score"), (F.col("point_id") % 3 > 0).alias("valid"))
    return rounded(project.fuse_views(v), "mean", "var")


_SIGNS = " UNION ALL ".join(
    f"""SELECT frame_id, {i} AS place, {a}::DOUBLE AS y_sign, {b}::DOUBLE AS z_sign, 1000 * coalesce(avg(CASE WHEN keep THEN (coalesce(color = pixel, NULL))::INTEGER END), 0) + sum(valid::INTEGER) AS score
FROM (SELECT s.*, p.pixel FROM (SELECT *, valid AND round_even(u, 0) < 24 AND round_even(v, 0) < 30 AS keep FROM (SELECT *, x > 1e-6 AND u >= 0 AND u <= 23 AND v >= 0 AND v <= 29 AS valid FROM (SELECT frame_id, label % 4 AS color, x, 12 * ((y * ({a})) / greatest(x, 1e-6)) + 12 AS u, 10 * ((z * ({b})) / greatest(x, 1e-6)) + 15 AS v FROM points))) s
LEFT JOIN pix p ON s.keep AND s.frame_id = p.frame_id AND p.row = round_even(s.v, 0) AND p.col = round_even(s.u, 0)) GROUP BY frame_id"""
    for i, (a, b) in enumerate(((1, 1), (1, -1), (-1, 1), (-1, -1)))
)


@query(f"""WITH {fx.POINTS}, pix AS (SELECT frame_id, row, col, (row * 7 + col * 3) % 4 AS pixel FROM (SELECT DISTINCT frame_id FROM points) CROSS JOIN (SELECT unnest(range(30)) AS row) CROSS JOIN (SELECT unnest(range(24)) AS col)), s AS ({_SIGNS})
SELECT frame_id, y_sign, z_sign, {r6s('score')} FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, place) AS r FROM s) WHERE r = 1""")
def sign_search(spark, sf):
    p = fx.points(spark, sf).withColumn("color", F.col("label") % 4)
    grid = p.select("frame_id").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("color", (F.col("row") * 7 + F.col("col") * 3) % 4)
    return rounded(project.sign_search(p, grid, 24, 30, fx=12.0, fy=10.0, cx=12.0, cy=15.0), "score")


@query(f"""WITH {fx.POINTS}, m AS (SELECT *, floor(x / 2)::BIGINT AS px, floor(y / 2)::BIGINT AS py FROM points) SELECT frame_id, px, py, {r6('z')} AS top, r, g, b, n FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, px, py ORDER BY z DESC, point_id DESC) AS k, count(*) OVER (PARTITION BY frame_id, px, py) AS n FROM m) WHERE k = 1""")
def top_surface_raster(spark, sf):
    return rounded(project.top_surface(fx.points(spark, sf), 2.0, ["r", "g", "b"]), "top")


_DISK = "(SELECT dx, dy FROM (SELECT unnest(range(-1, 2)) AS dx) CROSS JOIN (SELECT unnest(range(-1, 2)) AS dy) WHERE dx * dx + dy * dy <= 1)"


@query(f"""WITH {fx.POINTS}, {fx.projected_sql('points', 'f')}, s AS (SELECT frame_id, point_id, depth, r, g, b, row + dy AS row, col + dx AS col FROM f CROSS JOIN {_DISK} d WHERE valid),
o AS (SELECT *, row_number() OVER (PARTITION BY frame_id, row, col ORDER BY depth, point_id) AS k FROM s WHERE col BETWEEN 0 AND 23 AND row BETWEEN 0 AND 29)
SELECT frame_id, row, col, {r6s('depth')}, point_id, r, g, b FROM o WHERE k = 1""")
def perspective_zbuffer(spark, sf):
    p = project.with_projection(fx.points(spark, sf), **fx.CAMERA)
    return rounded(project.depth_buffer(p, 24, 30, 1, ["r", "g", "b"]), "depth")


def _z_raster(spark, sf):
    p = project.footprint(project.with_projection(fx.points(spark, sf), **fx.CAMERA), 24, 30)
    return p.where("keep").groupBy("frame_id", "row", "col").agg(F.avg("z").alias("value"))


_ZR = f"{fx.POINTS}, {fx.projected_sql('points', 'f')}, zr AS (SELECT frame_id, row, col, avg(z) AS value FROM f WHERE keep GROUP BY ALL)"
_DISK2 = "(SELECT dx, dy FROM (SELECT unnest(range(-2, 3)) AS dx) CROSS JOIN (SELECT unnest(range(-2, 3)) AS dy) WHERE dx * dx + dy * dy <= 4)"


@query(f"""WITH {_ZR}, s AS (SELECT frame_id, row + dy AS row, col + dx AS col, dx * dx + dy * dy AS d, row AS r, col AS c, value FROM zr CROSS JOIN {_DISK2}), b AS (SELECT *, row_number() OVER (PARTITION BY frame_id, row, col ORDER BY d, r, c) AS k FROM s)
SELECT f.frame_id, f.row, f.col, {r6('value')} AS value FROM (SELECT frame_id, row::INTEGER AS row, col::INTEGER AS col FROM (SELECT DISTINCT frame_id FROM zr) CROSS JOIN (SELECT unnest(range(30)) AS row) CROSS JOIN (SELECT unnest(range(24)) AS col)) f LEFT JOIN b ON b.k = 1 AND b.frame_id = f.frame_id AND b.row = f.row AND b.col = f.col""")
def fill_holes(spark, sf):
    z = _z_raster(spark, sf)
    return rounded(project.fill_holes(z, z, 24, 30, 2, "value"), "value")


@query(f"""WITH {_ZR}, s AS (SELECT frame_id, row + dy AS row, col + dx AS col, exp(-(dx * dx + dy * dy) / 2::DOUBLE) AS w, value FROM zr CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy)), m AS (SELECT frame_id, row, col, sum(w * value) / sum(w) AS value FROM s GROUP BY ALL),
k AS (SELECT m.* FROM m SEMI JOIN zr USING (frame_id, row, col)), q AS (SELECT frame_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM k GROUP BY ALL)
SELECT frame_id, row, col, {r6('least(greatest((value - lo) / greatest(hi - lo, 1e-6), 0), 1)')} AS value FROM k JOIN q USING (frame_id)""")
def smooth_and_stretch(spark, sf):
    return rounded(project.stretch_contrast(project.gaussian_smooth(_z_raster(spark, sf), "value", 1.0, 1), "value"), "value")


@query(f"""WITH {fx.RASTER}, t AS (SELECT i, n_in, least(greatest((i + 0.5) * n_in / n_out - 0.5, 0), n_in - 1)::DOUBLE AS a FROM (SELECT unnest(range(6)) AS i, 24 AS n_in, 6 AS n_out UNION ALL SELECT unnest(range(7)), 30, 7)),
taps AS (SELECT i, n_in, floor(a)::INTEGER AS src, 1 - (a - floor(a)) AS w FROM t UNION ALL SELECT i, n_in, least(floor(a)::INTEGER + 1, n_in - 1), a - floor(a) FROM t)
SELECT term, y.i::INTEGER AS row, x.i::INTEGER AS col, {r6('sum(score * y.w * x.w)')} AS score FROM raster r JOIN taps y ON y.n_in = 30 AND y.src = r.row AND y.w > 0 JOIN taps x ON x.n_in = 24 AND x.src = r.col AND x.w > 0 GROUP BY ALL""")
def evidence_downsample(spark, sf):
    return rounded(project.downsample(fx.raster(spark, sf), ["term"], 4, 24, 30), "score")


@query("""WITH f AS (SELECT event_type AS frame_id, (max(user_id) * 13 % 700 + 101)::INTEGER AS width, (max(event_id) % 500 + 99)::INTEGER AS height FROM events GROUP BY ALL)
SELECT frame_id, 'full' AS view, 0 AS x0, 0 AS y0, width AS x1, height AS y1 FROM f UNION ALL SELECT frame_id, 'crop00', 0, 0, width // 2, height // 2 FROM f UNION ALL SELECT frame_id, 'crop01', width // 2, 0, width, height // 2 FROM f
UNION ALL SELECT frame_id, 'crop10', 0, height // 2, width // 2, height FROM f UNION ALL SELECT frame_id, 'crop11', width // 2, height // 2, width, height FROM f""")
def crop_views(spark, sf):
    f = fx.load(spark, sf, "events").groupBy(F.col("event_type").alias("frame_id")).agg((F.max("user_id") * 13 % 700 + 101).cast("int").alias("width"), (F.max("event_id") % 500 + 99).cast("int").alias("height"))
    return project.crop_views(f)


@query(f"""WITH {fx.POINTS}, {fx.projected_sql('points', 'f')}, b AS (SELECT point_id, least(greatest(round_even(u - 4.5, 0), 0), 24)::INTEGER AS x0, least(greatest(round_even(v - 4.5, 0), 0), 30)::INTEGER AS y0, least(greatest(round_even(u + 4.5, 0), 0), 24)::INTEGER AS x1, least(greatest(round_even(v + 4.5, 0), 0), 30)::INTEGER AS y1 FROM f)
SELECT *, x1 <= x0 OR y1 <= y0 AS empty FROM b""")
def square_crops(spark, sf):
    p = project.with_projection(fx.points(spark, sf), **fx.CAMERA)
    return p.select("point_id", *project.square_box(F.col("u"), F.col("v"), 9, 24, 30))


@query(f"WITH {fx.GEOMETRY}, {fx.KNN} SELECT frame_id, src, dst, {r6s('dist')} FROM knn")
def knn_edges(spark, sf):
    return rounded(geometry.knn_edges(fx.nodes(spark, sf)), "dist")


_Z = ", ".join(f"({c} - avg({c}) OVER w) / greatest(coalesce(stddev_samp({c}) OVER w, 0), 1e-6) AS {c}" for c in ("cx", "cy", "cz", *geometry.GATE))


def _gap(columns) -> str:
    return "sqrt(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in columns) + ")"


EDGES_SQL = f"""{fx.GEOMETRY}, {fx.KNN}, z AS (SELECT frame_id, sp_id, {_Z} FROM nodes WINDOW w AS (PARTITION BY frame_id)),
far AS (SELECT k.frame_id, src, dst, {_gap(('cx', 'cy', 'cz'))} + 0.55::DOUBLE * {_gap(geometry.GATE)} AS d FROM knn k JOIN z a ON a.frame_id = k.frame_id AND a.sp_id = src JOIN z b ON b.frame_id = k.frame_id AND b.sp_id = dst),
edges AS (SELECT frame_id, src, dst, exp(-d / greatest(m, 1e-6)) AS w FROM far JOIN (SELECT frame_id, quantile_disc(d, 0.5) AS m FROM far GROUP BY ALL) USING (frame_id))"""


# shapes of tiny segments amplify rounding; weights agree to three decimals
@query(f"WITH {EDGES_SQL} SELECT frame_id, count(*) AS edges, round_even(avg(w) * 1e3, 0) / 1e3 AS w FROM edges GROUP BY ALL")
def edge_weights(spark, sf):
    return fx.edges(spark, sf).groupBy("frame_id").agg(F.count(F.lit(1)).alias("edges"), (F.rint(F.avg("w") * 1e3) / 1e3).alias("w"))


_PLAIN = ["var_i", "log_n", "cx", "cy", "cz"]


# shapes of tiny segments amplify rounding: they are compared as means, everything else edge by edge
@query(f"""WITH {fx.GEOMETRY}, {fx.MAJORITY}, {fx.KNN}, z AS (SELECT frame_id, sp_id, {_Z} FROM nodes WINDOW w AS (PARTITION BY frame_id)), e AS (SELECT k.frame_id, src, dst, {', '.join(f'abs(a.{c} - b.{c}) AS {c}' for c in (*geometry.GATE, 'cx', 'cy', 'cz'))}, {_gap(('cx', 'cy', 'cz'))} AS far, l.label = m.label AND l.label <> 0 AS same
FROM knn k JOIN z a ON a.frame_id = k.frame_id AND a.sp_id = src JOIN z b ON b.frame_id = k.frame_id AND b.sp_id = dst JOIN majority l ON l.frame_id = k.frame_id AND l.sp_id = src JOIN majority m ON m.frame_id = k.frame_id AND m.sp_id = dst),
d AS (SELECT *, sqrt({' + '.join(f'{c} * {c}' for c in (*geometry.GATE, 'cx', 'cy', 'cz', 'far'))}) AS d FROM e), w AS (SELECT *, exp(-d / greatest(quantile_disc(d, 0.5) OVER (PARTITION BY frame_id), 1e-6)) AS w FROM d)
SELECT frame_id, src, dst, {', '.join(f'{r6(c)} AS {c}' for c in _PLAIN)}, {r6('far')} AS far, same, {', '.join(f'round_even(avg({c}) OVER f * 100, 0) / 100 AS mean_{c}' for c in ('linearity', 'planarity', 'scattering', 'w'))} FROM w WINDOW f AS (PARTITION BY frame_id)""")
def edge_features(spark, sf):
    n = fx.nodes(spark, sf)
    e = geometry.edge_features(geometry.knn_edges(n), n)
    names = [*geometry.GATE, "cx", "cy", "cz", "far"]
    e = e.select("frame_id", "src", "dst", "same", "w", *[F.col("features")[i].alias(c) for i, c in enumerate(names)])
    own = Window.partitionBy("frame_id")
    means = [(F.rint(F.avg(c).over(own) * 100) / 100).alias(f"mean_{c}") for c in ("linearity", "planarity", "scattering", "w")]
    return rounded(e.select("frame_id", "src", "dst", *_PLAIN, "far", "same", *means), *_PLAIN, "far")


_AFF = f"""{fx.GEOMETRY}, {fx.KNN}, zp AS (SELECT frame_id, sp_id, log_n, {', '.join(f'({c} - avg({c}) OVER w) / greatest(stddev_pop({c}) OVER w, 1e-6) AS {c}' for c in ('cx', 'cy', 'cz'))} FROM nodes WINDOW w AS (PARTITION BY frame_id)),
d AS (SELECT k.frame_id, src, dst, {_gap(('cx', 'cy', 'cz'))} AS dx, {_gap(('log_n',))} AS df FROM knn k JOIN zp a ON a.frame_id = k.frame_id AND a.sp_id = src JOIN zp b ON b.frame_id = k.frame_id AND b.sp_id = dst),
s AS (SELECT frame_id, median(CASE WHEN dx > 0 THEN dx END) AS sx, median(CASE WHEN df > 0 THEN df END) AS sf FROM d GROUP BY ALL),
affinity AS (SELECT frame_id, least(src, dst) AS src, greatest(src, dst) AS dst, max(least(greatest(exp(-dx / greatest(coalesce(sx, 1), 1e-6)) * exp(-0.72 * (df / greatest(coalesce(sf, 1), 1e-6))), 1e-6), 1)) AS w FROM d JOIN s USING (frame_id) GROUP BY ALL)"""


def _affinity(n):
    return written(geometry.affinity(geometry.knn_edges(n), n, ["log_n"]), "affinity")


@query(f"WITH {_AFF} SELECT frame_id, src, dst, {r6s('w')} FROM affinity")
def graph_affinity(spark, sf):
    return rounded(_affinity(fx.nodes(spark, sf)), "w")


# all points against the centres of all segments
@query(f"""WITH {fx.GEOMETRY}, site AS (SELECT frame_id, sp_id AS site_id, cx AS sx, cy AS sy, cz AS sz FROM nodes),
d AS (SELECT a.frame_id, a.point_id, site_id, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz)) AS dist FROM points a JOIN site s ON a.frame_id = s.frame_id AND s.sx BETWEEN x - 1 AND x + 1)
SELECT frame_id, point_id, site_id, {r6s('dist')} FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, point_id ORDER BY dist, site_id) AS r FROM d WHERE dist <= 1) WHERE r = 1""")
def nearest_within_radius(spark, sf):
    sites = geometry.superpoint_geometry(fx.segmented(spark, sf)).select("frame_id", F.col("sp_id").alias("site_id"), *[F.col(f"c{a}").alias(a) for a in "xyz"])
    return rounded(geometry.nearest_within(fx.points(spark, sf), sites, 1.0), "dist")


@query(f"WITH {fx.GEOMETRY}, q AS (SELECT frame_id, quantile_cont(cz, 0.02) AS lo, quantile_cont(cz, 0.98) AS hi, min(log_n) AS a, max(log_n) AS b FROM nodes GROUP BY ALL) SELECT frame_id, sp_id, {r6('least(greatest((cz - lo) / greatest(hi - lo, 1e-6), 0), 1)')} AS cz, {r6('(log_n - a) / greatest(b - a, 1e-6)')} AS log_n FROM nodes JOIN q USING (frame_id)")
def robust_and_plain_minmax(spark, sf):
    n = fx.nodes(spark, sf).select("frame_id", "sp_id", "cz", "log_n")
    return rounded(geometry.min_max(geometry.robust_min_max(n, "cz"), "log_n"), "cz", "log_n")


@query(f"WITH {fx.GEOMETRY} SELECT frame_id, sp_id, {r6('(cx - avg(cx) OVER w) / greatest(coalesce(stddev_samp(cx) OVER w, 0), 1e-6)')} AS cx, {r6('(cy - avg(cy) OVER w) / greatest(stddev_pop(cy) OVER w, 1e-6)')} AS cy FROM nodes WINDOW w AS (PARTITION BY frame_id)")
def z_scores(spark, sf):
    n = fx.nodes(spark, sf).select("frame_id", "sp_id", "cx", "cy")
    return rounded(geometry.z_scores(geometry.z_scores(n, ["cx"]), ["cy"], sample=False), "cx", "cy")


# graph operators on exact weights: 1 / (1 + dist) needs no shapes
GRAPH_SQL = f"{fx.GEOMETRY}, {fx.MAJORITY}, {fx.KNN}, edges AS (SELECT frame_id, src, dst, 1 / (1 + dist) AS w FROM knn), labels AS (SELECT frame_id, sp_id, label::INTEGER AS label, label::INTEGER AS index, sp_id % 5 <> 0 AS valid FROM majority)"


def _graph(spark, sf):
    n = fx.nodes(spark, sf)
    e = written(geometry.knn_edges(n).select("frame_id", "src", "dst", (1 / (1 + F.col("dist"))).alias("w")), "edges")
    return n.select(*SEGMENT, "label", F.col("label").alias("index"), (F.col("sp_id") % 5 != 0).alias("valid")), e


def _step_sql(i: int) -> str:
    return f"""p{i + 1} AS (SELECT frame_id, sp_id, c, 0.72 * i0.p + 0.28 * coalesce(s / greatest(deg, 1e-6), 0) AS p FROM p0 i0 LEFT JOIN (SELECT b.frame_id, b.src AS sp_id, q.c, sum(q.p * b.w) AS s FROM both_ways b JOIN p{i} q ON q.frame_id = b.frame_id AND q.sp_id = b.dst GROUP BY ALL) USING (frame_id, sp_id, c) LEFT JOIN degree USING (frame_id, sp_id))"""


_BOTH = "both_ways AS (SELECT frame_id, src, dst, greatest(w, 1e-5) AS w FROM edges UNION ALL SELECT frame_id, dst, src, greatest(w, 1e-5) FROM edges)"


@query(f"""WITH {GRAPH_SQL}, {_BOTH}, degree AS (SELECT frame_id, src AS sp_id, sum(w) AS deg FROM both_ways GROUP BY ALL),
p0 AS (SELECT frame_id, sp_id, c, CASE WHEN NOT valid THEN 1 / 6::DOUBLE WHEN c = index THEN 1::DOUBLE ELSE 0 END AS p FROM labels CROSS JOIN (SELECT unnest(range(6)) AS c)), {_step_sql(0)}, {_step_sql(1)}, {_step_sql(2)}
SELECT frame_id, sp_id, c::INTEGER AS index FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, sp_id ORDER BY round(p, 9) DESC, c) AS r FROM p3) WHERE r = 1""")
def label_propagation_3(spark, sf):
    labels, e = _graph(spark, sf)
    return graph.label_propagation(labels, e, 6, steps=3)


@query(f"""WITH {GRAPH_SQL}, both_ways AS (SELECT frame_id, src, dst, greatest(w, 1e-6) AS w FROM edges UNION ALL SELECT frame_id, dst, src, greatest(w, 1e-6) FROM edges),
v AS (SELECT b.frame_id, b.src AS sp_id, l.index, sum(b.w) AS v FROM both_ways b JOIN labels l ON l.frame_id = b.frame_id AND l.sp_id = b.dst AND l.valid GROUP BY ALL),
sc AS (SELECT frame_id, sp_id, index, sum(s) AS s FROM (SELECT frame_id, sp_id, index, 0.75 * v / greatest(sum(v) OVER (PARTITION BY frame_id, sp_id), 1e-6) AS s FROM v UNION ALL SELECT frame_id, sp_id, index, 1 FROM labels WHERE valid) GROUP BY ALL),
b AS (SELECT frame_id, sp_id, index AS bi, s AS bs FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, sp_id ORDER BY s DESC, index) AS r FROM sc) WHERE r = 1)
SELECT frame_id, sp_id, CASE WHEN valid AND bi <> l.index AND bs - sc.s > 0.18 THEN bi ELSE l.index END AS index FROM labels l LEFT JOIN b USING (frame_id, sp_id) LEFT JOIN sc ON sc.frame_id = l.frame_id AND sc.sp_id = l.sp_id AND sc.index = l.index""")
def neighbour_repair(spark, sf):
    return graph.neighbour_repair(*_graph(spark, sf))


_HEADS = """p AS (SELECT frame_id, sp_id, index, valid FROM labels), a AS (SELECT frame_id, sp_id, ((index + (sp_id % 3 = 0)::INTEGER) % 6)::INTEGER AS index, sp_id % 4 <> 1 AS valid FROM labels)"""


def _heads(spark, sf):
    labels, e = _graph(spark, sf)
    aux = labels.select(*SEGMENT, ((F.col("index") + (F.col("sp_id") % 3 == 0).cast("int")) % 6).alias("index"), (F.col("sp_id") % 4 != 1).alias("valid"))
    return labels, aux, e


def _vote_sql(power: str) -> str:
    return f"""seeds AS (SELECT frame_id, sp_id, pi AS index FROM heads WHERE agree), raw AS (SELECT g.frame_id, g.c AS index, pow(greatest(count(s.sp_id), 1)::DOUBLE, -{power}::DOUBLE) AS raw FROM (SELECT DISTINCT frame_id, unnest(range(6)) AS c FROM seeds) g LEFT JOIN seeds s ON s.frame_id = g.frame_id AND s.index = g.c GROUP BY ALL),
cw AS (SELECT frame_id, index, raw / greatest(avg(raw) OVER (PARTITION BY frame_id), 1e-6) AS weight FROM raw),
cast_v AS (SELECT b.frame_id, b.src AS sp_id, s.index, sum(greatest(b.w, 1e-6) * cw.weight) AS v FROM both_ways b JOIN seeds s ON s.frame_id = b.frame_id AND s.sp_id = b.dst JOIN cw ON cw.frame_id = s.frame_id AND cw.index = s.index GROUP BY ALL),
votes AS (SELECT frame_id, sp_id, index, v / greatest(sum(v) OVER (PARTITION BY frame_id, sp_id), 1e-6) AS vote FROM cast_v)"""


@query(f"""WITH {GRAPH_SQL}, {_BOTH}, {_HEADS}, heads AS (SELECT frame_id, sp_id, p.index AS pi, a.index AS ai, p.valid AS p_ok, a.valid AS a_ok, p.valid AND a.valid AND p.index = a.index AND p.index <> 0 AS agree FROM p JOIN a USING (frame_id, sp_id)), {_vote_sql('0.35')},
sc AS (SELECT frame_id, sp_id, index, sum(s) AS s FROM (SELECT frame_id, sp_id, pi AS index, 1::DOUBLE AS s FROM heads WHERE p_ok UNION ALL SELECT frame_id, sp_id, ai, 0.75 FROM heads WHERE a_ok UNION ALL SELECT frame_id, sp_id, index, 0.65 * vote FROM votes) GROUP BY ALL)
SELECT frame_id, sp_id, coalesce(index, 0)::INTEGER AS index FROM heads LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY frame_id, sp_id ORDER BY s DESC, index) AS r FROM sc) b USING (frame_id, sp_id) WHERE coalesce(r, 1) = 1""")
def dual_prior_refine(spark, sf):
    p, a, e = _heads(spark, sf)
    return graph.dual_prior_refine(p, a, e, 6, void=0).withColumn("index", F.col("index").cast("int"))


@query(f"""WITH {GRAPH_SQL}, {_BOTH}, {_HEADS}, h0 AS (SELECT frame_id, sp_id, p.index AS pi, a.index AS ai, p.valid AND p.index <> 0 AS p_ok, a.valid AND a.index <> 0 AS a_ok FROM p JOIN a USING (frame_id, sp_id)), heads AS (SELECT *, p_ok AND a_ok AND pi = ai AS agree FROM h0), {_vote_sql('0.25')},
b AS (SELECT frame_id, sp_id, index AS bi, vote AS bv FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, sp_id ORDER BY vote DESC, index) AS r FROM votes) WHERE r = 1),
j AS (SELECT h.*, coalesce(bi, 0) AS bi, coalesce(bv, 0) AS bv, coalesce(x.vote, 0) AS pv, coalesce(y.vote, 0) AS av FROM heads h LEFT JOIN b USING (frame_id, sp_id) LEFT JOIN votes x ON x.frame_id = h.frame_id AND x.sp_id = h.sp_id AND x.index = pi LEFT JOIN votes y ON y.frame_id = h.frame_id AND y.sp_id = h.sp_id AND y.index = ai)
SELECT frame_id, sp_id, (CASE WHEN p_ok AND a_ok AND pi <> ai AND av > pv + 0.10 AND av >= 0.42 THEN ai WHEN p_ok AND a_ok AND pi <> ai AND bv >= 0.42 AND bi <> pi AND bv > pv + 0.10 THEN bi WHEN p_ok THEN pi WHEN a_ok THEN ai ELSE 0 END)::INTEGER AS index FROM j""")
def consensus_refine(spark, sf):
    p, a, e = _heads(spark, sf)
    return graph.consensus_refine(p, a, e, 6).withColumn("index", F.col("index").cast("int"))


@query(f"""WITH {GRAPH_SQL}, {_BOTH}, {_HEADS}, heads AS (SELECT frame_id, sp_id, p.index AS pi, a.index AS ai, (sp_id % 10) / 40::DOUBLE AS pc, (sp_id % 7) / 35::DOUBLE AS ac, p.index = a.index AND greatest((sp_id % 10) / 40::DOUBLE, (sp_id % 7) / 35::DOUBLE) >= 0.10 AS agree FROM p JOIN a USING (frame_id, sp_id)), {_vote_sql('0.25')},
sc AS (SELECT frame_id, sp_id, index, sum(s) AS s FROM (SELECT frame_id, sp_id, pi AS index, greatest(pc, 0.05) AS s FROM heads UNION ALL SELECT frame_id, sp_id, ai, 0.75 * greatest(ac, 0.05) FROM heads UNION ALL SELECT v.frame_id, v.sp_id, v.index, 0.90 * vote FROM votes v JOIN heads h USING (frame_id, sp_id) WHERE pi <> ai OR greatest(pc, ac) < 0.14) GROUP BY ALL)
SELECT frame_id, sp_id, index::INTEGER AS index FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, sp_id ORDER BY s DESC, index) AS r FROM sc) WHERE r = 1""")
def dual_scale_refine(spark, sf):
    p, a, e = _heads(spark, sf)
    conf = lambda df, n, d: df.select(*SEGMENT, "index", (F.col("sp_id") % n / d).alias("confidence"))
    return graph.dual_scale_refine(conf(p, 10, 40.0), conf(a, 7, 35.0), e, 6).withColumn("index", F.col("index").cast("int"))


@query(f"""WITH {GRAPH_SQL}, t AS (SELECT frame_id, sp_id, label - 1 AS label FROM labels), pr AS (SELECT frame_id, sp_id, (label + (sp_id % 4 = 0)::INTEGER) % 6 AS label FROM labels),
j AS (SELECT e.frame_id, w, a.label <> b.label AS differ, c.label = d.label AS same_p FROM edges e JOIN t a ON a.frame_id = e.frame_id AND a.sp_id = src JOIN t b ON b.frame_id = e.frame_id AND b.sp_id = dst JOIN pr c ON c.frame_id = e.frame_id AND c.sp_id = src JOIN pr d ON d.frame_id = e.frame_id AND d.sp_id = dst WHERE a.label >= 0 AND b.label >= 0),
m AS (SELECT frame_id, count(*) AS edges, avg((differ AND same_p)::INTEGER) AS leak_rate, coalesce(avg(CASE WHEN NOT differ THEN w END), 0) AS w_same, coalesce(avg(CASE WHEN differ THEN w END), 0) AS w_diff FROM j GROUP BY ALL)
SELECT frame_id, edges, {r6s('leak_rate', 'w_same', 'w_diff')}, {r6('w_same - w_diff')} AS gap FROM m""")
def boundary_bleeding(spark, sf):
    labels, e = _graph(spark, sf)
    truth = labels.select(*SEGMENT, (F.col("label") - 1).alias("label"))
    pred = labels.select(*SEGMENT, ((F.col("label") + (F.col("sp_id") % 4 == 0).cast("int")) % 6).alias("label"))
    return rounded(graph.bleeding(e, truth, pred), "leak_rate", "w_same", "w_diff", "gap")


def _smooth_sql(i: int) -> str:
    return f"s{i + 1} AS (SELECT frame_id, sp_id, label FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, sp_id ORDER BY v DESC, own DESC, label) AS r FROM (SELECT frame_id, sp_id, label, round(sum(w), 9) AS v, max(own) AS own FROM (SELECT b.frame_id, b.src AS sp_id, q.label, b.w, 0 AS own FROM both_ways b JOIN s{i} q ON q.frame_id = b.frame_id AND q.sp_id = b.dst UNION ALL SELECT frame_id, sp_id, label, 0.85, 1 FROM s{i}) GROUP BY ALL)) WHERE r = 1)"


@query(f"WITH {GRAPH_SQL}, both_ways AS (SELECT frame_id, src, dst, w FROM edges UNION ALL SELECT frame_id, dst, src, w FROM edges), s0 AS (SELECT frame_id, sp_id, label FROM labels), {_smooth_sql(0)}, {_smooth_sql(1)} SELECT * FROM s2")
def smooth_labels(spark, sf):
    labels, e = _graph(spark, sf)
    return graph.smooth_labels(labels, e)


_REFINE_EDGES = """seat AS MATERIALIZED (SELECT frame_id, sp_id, max(CASE WHEN term_idx = 0 THEN score END) AS cx, max(CASE WHEN term_idx = 1 THEN score END) AS cy, max(CASE WHEN term_idx = 2 THEN score END) AS cz, bool_and(valid) AS valid FROM ev GROUP BY ALL),
far AS (SELECT a.frame_id, a.sp_id AS src, b.sp_id AS dst, a.valid AND b.valid AS both_valid, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) + (a.cz - b.cz) * (a.cz - b.cz)) AS dist FROM seat a JOIN seat b ON a.frame_id = b.frame_id AND a.sp_id <> b.sp_id),
links AS MATERIALIZED (SELECT frame_id, src, dst, exp(-dist) AS w FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, src ORDER BY dist, dst) AS r FROM far) WHERE r <= 4 AND both_valid)"""


def _softmax_sql(source: str, out: str) -> str:
    own = "OVER (PARTITION BY frame_id, sp_id)"
    return f"{out} AS MATERIALIZED (SELECT frame_id, sp_id, term_idx, e / sum(e) {own} AS p FROM (SELECT *, exp(s - max(s) {own}) AS e FROM {source}))"


def _round_sql(i: int, weights: str) -> str:
    """One round: the unary mixed with the log of the neighbours' mean opinion, by each segment's share."""
    return f"""{_softmax_sql(f's{i}', f'o{i}')}, m{i} AS (SELECT l.frame_id, l.src AS sp_id, o.term_idx, sum(l.w * o.p) AS m FROM {weights} l JOIN o{i} o ON o.frame_id = l.frame_id AND o.sp_id = l.dst GROUP BY ALL),
s{i + 1} AS MATERIALIZED (SELECT u.frame_id, u.sp_id, u.term_idx, CASE WHEN valid THEN (1 - share) * u.s + share * ln(greatest(coalesce(m, 0) / greatest(coalesce(total, 0), 1e-8), 1e-8)) ELSE -30::DOUBLE END AS s
FROM u JOIN shares USING (frame_id, sp_id) LEFT JOIN m{i} USING (frame_id, sp_id, term_idx))"""


def _refine_sql(unary: str, weights: str, conf: str, share: str) -> str:
    rounds = ", ".join(_round_sql(i, weights) for i in range(5))
    return f"""u AS MATERIALIZED (SELECT frame_id, sp_id, term_idx, valid, {unary} AS s FROM ev), s0 AS (SELECT frame_id, sp_id, term_idx, CASE WHEN valid THEN s ELSE -30::DOUBLE END AS s FROM u), {_softmax_sql('u', 'up')}, {_softmax_sql('s0', 'vp')}, conf AS (SELECT frame_id, sp_id, max(p) AS conf FROM {conf} GROUP BY ALL),
agree AS MATERIALIZED (SELECT l.frame_id, src, dst, w, sum(a.p * b.p) AS agree FROM links l JOIN vp a ON a.frame_id = l.frame_id AND a.sp_id = src JOIN vp b ON b.frame_id = l.frame_id AND b.sp_id = dst AND b.term_idx = a.term_idx GROUP BY ALL),
plain AS (SELECT frame_id, src, dst, greatest(w, 1e-6) AS w FROM links), semantic AS MATERIALIZED (SELECT frame_id, src, dst, greatest(w * pow(greatest(least(agree, 1), 1e-4), 1.6), 1e-8) AS w FROM agree),
totals AS (SELECT seat.frame_id, seat.sp_id, coalesce(t, 0) AS total FROM seat LEFT JOIN (SELECT frame_id, src AS sp_id, sum(w) AS t FROM {weights} GROUP BY ALL) USING (frame_id, sp_id)), mids AS (SELECT frame_id, quantile_disc(total, 0.5) AS middle FROM totals GROUP BY ALL),
shares AS MATERIALIZED (SELECT frame_id, sp_id, total, {share} AS share FROM totals JOIN conf USING (frame_id, sp_id) JOIN mids USING (frame_id)), {rounds} SELECT frame_id, sp_id, term_idx, {r6('s')} AS score FROM s5"""


@query(f"WITH {fx.EVIDENCE}, {_REFINE_EDGES}, {_refine_sql('(0.62 * score + 0.38 * (score * 0.9::DOUBLE)) / 0.035', 'plain', 'up', '0.55 * least(greatest(1 - conf, 0), 0.85)')}")
def geometry_refine(spark, sf):
    ev = fx.evidence(spark, sf)
    n = ev.select("frame_id", "sp_id", "term_idx", F.col("score").alias("small"), (F.col("score") * 0.9).alias("large"), "valid")
    return rounded(graph.geometry_refine(n, _evidence_edges(ev)), "score")


@query(f"WITH {fx.EVIDENCE}, {_REFINE_EDGES}, {_refine_sql('score / 0.08::DOUBLE', 'semantic', 'vp', '0.58 * least(greatest(1 - conf, 0), 0.85) * least(total / greatest(middle, 1e-6), 1)')}")
def semantic_refine(spark, sf):
    ev = fx.evidence(spark, sf)
    return rounded(graph.semantic_refine(ev.select("frame_id", "sp_id", "term_idx", "score", "valid"), _evidence_edges(ev)), "score")


def _evidence_edges(ev):
    """Neighbours of embeddings by their scores for the first three terms."""
    at = ev.groupBy("frame_id", "sp_id").agg(*[F.max(F.when(F.col("term_idx") == i, F.col("score"))).alias(c) for i, c in enumerate(("cx", "cy", "cz"))])
    return geometry.knn_edges(at, 4).select("frame_id", "src", "dst", F.exp(-F.col("dist")).alias("w"))


@query()
def corrupt_boundaries(spark, sf):
    labels, e = _graph(spark, sf)
    return graph.corrupt_boundaries(labels.select(*SEGMENT, "label", "valid"), e)


@query()
def grow_regions(spark, sf):
    n = fx.nodes(spark, sf)
    return procedural.grow_regions(n, _affinity(n), 12)


@query()
def merge_small(spark, sf):
    n = fx.nodes(spark, sf)
    e = _affinity(n)
    return procedural.merge_small(procedural.grow_regions(n, e, 40), e, 4)


@query()
def spectral_clusters(spark, sf):
    n = fx.nodes(spark, sf)
    return procedural.spectral_clusters(n, _affinity(n), ["cx", "cy", "cz"], 2, 5)


def _candidates(spark, sf):
    n = fx.nodes(spark, sf)
    both = n.select("frame_id", "sp_id", F.explode(F.array(F.struct(F.lit(0).alias("candidate"), F.col("label").alias("label")), F.struct(F.lit(1).alias("candidate"), (F.col("label") % 3).alias("label")))).alias("c")).select("frame_id", "sp_id", "c.*")
    return both, _affinity(n), n


@query(f"""WITH {_AFF}, {fx.MAJORITY}, cand AS (SELECT frame_id, sp_id, 0 AS candidate, label FROM majority UNION ALL SELECT frame_id, sp_id, 1, label % 3 FROM majority),
sz AS (SELECT frame_id, candidate, label, count(*)::DOUBLE AS n FROM cand GROUP BY ALL), per AS (SELECT frame_id, candidate, sum(n) AS t, count(*) AS k, min(n) AS least, avg(n) AS mean, stddev_pop(n) AS std FROM sz GROUP BY ALL),
cut AS (SELECT a.frame_id, a.candidate, sum(w) AS weight, sum(CASE WHEN a.label <> b.label THEN w ELSE 0 END) AS cut FROM affinity e JOIN cand a ON a.frame_id = e.frame_id AND a.sp_id = src JOIN cand b ON b.frame_id = e.frame_id AND b.sp_id = dst AND a.candidate = b.candidate GROUP BY ALL)
SELECT frame_id, candidate, {r6('CASE WHEN weight <= 1e-8 THEN 0 ELSE 1 - cut / weight END')} AS consistency, {r6('CASE WHEN k > 1 THEN 1 - least(std / mean, 1) ELSE 0 END')} AS balance, {r6('CASE WHEN k > 1 THEN ln(1 + k) / ln(1 + greatest(least(t, 12), 2)) ELSE 0 END')} AS complexity FROM per JOIN cut USING (frame_id, candidate)""")
def cluster_objective(spark, sf):
    labels, e, _ = _candidates(spark, sf)
    none = labels.select("frame_id", "candidate").distinct().withColumn("silhouette", F.lit(0.0))
    return rounded(metrics.cut_objective(labels, e, none).select("frame_id", "candidate", "consistency", "balance", "complexity"), "consistency", "balance", "complexity")


@query()
def best_clustering(spark, sf):
    labels, e, n = _candidates(spark, sf)
    s = procedural.silhouettes(labels, n, ["cx", "cy", "cz"])
    return metrics.best_candidate(metrics.cut_objective(labels, e, s))


@query(f"""WITH {fx.GEOMETRY}, {fx.MAJORITY}, q AS (SELECT frame_id, quantile_cont(cz, 0.02) AS lo, quantile_cont(cz, 0.98) AS hi FROM nodes GROUP BY ALL),
h AS (SELECT n.frame_id, m.label AS cluster, n.n, least(greatest((cz - lo) / greatest(hi - lo, 1e-6), 0), 1) AS height, linearity, planarity, scattering FROM nodes n JOIN majority m USING (frame_id, sp_id) JOIN q USING (frame_id)),
a AS (SELECT frame_id, cluster, count(*) AS segments, sum(n) AS points, avg(height) AS h, avg(linearity) AS l, avg(planarity) AS p, avg(scattering) AS s FROM h GROUP BY ALL)
SELECT frame_id, cluster, segments, points::BIGINT AS points, CASE WHEN p >= greatest(l, s) AND h < 0.35 THEN 'low planar surface' WHEN p >= greatest(l, s) THEN 'elevated planar structure' WHEN s >= greatest(l, p) AND h >= 0.35 THEN 'elevated rough object' WHEN l >= greatest(p, s) THEN 'linear edge or strip' WHEN h < 0.25 THEN 'low open ground' ELSE 'mixed geometric primitive' END AS name,
row_number() OVER (PARTITION BY frame_id ORDER BY points DESC, cluster) AS rank FROM a""")
def describe_clusters(spark, sf):
    n = geometry.robust_min_max(fx.nodes(spark, sf), "cz", "height").withColumnRenamed("label", "cluster")
    return graph.describe_clusters(n).select("frame_id", "cluster", "segments", "points", "name", "rank")


@query()
def local_global_features(spark, sf):
    n = fx.nodes(spark, sf).join(geometry.segment_rgb(fx.segmented(spark, sf)), SEGMENT)
    return procedural.local_global_features(n, rgb=True)


@query()
def kmeans_baseline(spark, sf):
    return procedural.kmeans_baseline(fx.nodes(spark, sf).select("frame_id", "sp_id", "cx", "cy", "cz"), ["cx", "cy", "cz"], 6)


@query()
def entity_vocabulary(spark, sf):
    e = fx.load(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    parts = e.select("*", *[F.element_at("v", i + 1).alias(f"e{i}") for i in range(8)])
    return procedural.entity_vocabulary(parts, fx.prototypes(spark, sf), [f"e{i}" for i in range(8)], 6)


@query()
def learned_edge_gate(spark, sf):
    n = fx.nodes(spark, sf)
    return procedural.edge_gate(written(geometry.edge_features(geometry.knn_edges(n), n), "edge-features"))[1].select("frame_id", "src", "dst", "same", "w")


# frames and manifests --------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_type AS scene, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events),
s AS (SELECT scene, n, round_even((n - 1) * 0.1, 0) AS lo, round_even((n - 1) * 0.9, 0) AS hi FROM (SELECT DISTINCT scene, n FROM e)),
spots AS (SELECT scene, round_even(lo + i * ((hi - lo) / 6), 0)::BIGINT AS place FROM s CROSS JOIN (SELECT unnest(range(7)) AS i))
SELECT scene, event_id, place FROM e SEMI JOIN spots USING (scene, place)""")
def stratified_sampling(spark, sf):
    e = fx.load(spark, sf, "events").select(F.col("event_type").alias("scene"), "event_id", "ts")
    return frames.sample_frames(e, 7, 0.1, order=("ts", "event_id")).select("scene", "event_id", F.col("place").cast("bigint").alias("place"))


_ALIAS = """f AS (SELECT event_id, 'f' || event_id AS frame_id, ['k' || (event_id % 50), 'k' || (event_id % 70), 'k' || (event_id % 90)] AS aliases FROM events),
asked AS (SELECT frame_id, unnest(aliases) AS key, unnest(range(3)) AS priority FROM f), rec AS (SELECT 'k' || (user_id + 20) AS key, max(value) AS value FROM events WHERE value > 300 GROUP BY ALL)"""


def _aliases(spark, sf):
    e = fx.load(spark, sf, "events")
    k = lambda n: F.concat(F.lit("k"), (F.col("event_id") % n).cast("string"))
    f = e.select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("frame_id"), F.array(k(50), k(70), k(90)).alias("aliases"))
    rec = e.where("value > 300").groupBy(F.concat(F.lit("k"), (F.col("user_id") + 20).cast("string")).alias("key")).agg(F.max("value").alias("value"))
    return f, rec


@query(f"WITH {_ALIAS} SELECT f.frame_id, key, value FROM f LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY priority) AS r FROM asked JOIN rec USING (key)) h ON h.frame_id = f.frame_id AND r = 1")
def alias_first_hit(spark, sf):
    return frames.first_alias(*_aliases(spark, sf))


@query(f"WITH {_ALIAS} SELECT frame_id, priority::INTEGER AS priority, key, value FROM asked JOIN rec USING (key)")
def alias_all_hits(spark, sf):
    return frames.all_aliases(*_aliases(spark, sf))


_MAN = "m AS (SELECT 'o' || o_orderkey AS frame_id, (o_orderkey % 4)::INTEGER AS n_points FROM orders), c AS (SELECT 'o' || l_orderkey AS frame_id, count(*)::INTEGER AS n_cached FROM lineitem GROUP BY ALL)"


def _manifest(spark, sf):
    m = fx.load(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("frame_id"), (F.col("o_orderkey") % 4).cast("int").alias("n_points"))
    c = fx.load(spark, sf, "lineitem").groupBy(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("frame_id")).agg(F.count(F.lit(1)).cast("int").alias("n_cached"))
    return m, c


@query(f"WITH {_MAN} SELECT m.* FROM m ANTI JOIN c USING (frame_id)")
def manifest_missing(spark, sf):
    return frames.missing(*_manifest(spark, sf))


@query(f"WITH {_MAN} SELECT m.*, n_cached, n_points <> n_cached AS bad_shape FROM m JOIN c USING (frame_id)")
def manifest_present(spark, sf):
    return frames.present(*_manifest(spark, sf))


@query(f"WITH {_MAN} SELECT m.frame_id FROM m WHERE frame_id NOT IN (SELECT frame_id FROM c WHERE n_cached > 3 INTERSECT SELECT frame_id FROM c WHERE n_cached < 6)")
def resume_anti_join(spark, sf):
    from ..sources import sinks

    m, c = _manifest(spark, sf)
    return sinks.pending_all(m.select("frame_id"), c.where("n_cached > 3"), c.where("n_cached < 6"))


@query("""WITH k AS (SELECT part_key % 7 AS a, part_key AS b, name AS path FROM (SELECT p_partkey AS part_key, CASE WHEN p_partkey % 3 = 0 THEN '/data/interval5_' || p_brand || '/CAM_x/image' || p_partkey || '_' || p_size || '.jpg' WHEN p_partkey % 3 = 1 THEN '/data/set/' || p_brand || '/lidar.txt' ELSE 'interval5_CAM/a/frame.v2.' || p_size || 'x.bin' END AS name FROM part))
SELECT path, coalesce(list_filter(string_split(path, '/')[:-2], lambda p: starts_with(p, 'interval') AND NOT contains(p, 'CAM'))[1], string_split(path, '/')[-2], '') || ':' ||
coalesce(regexp_extract_all(regexp_replace(string_split(path, '/')[-1], '(.)\\.[^.]*$', '\\1'), '\\d+')[-1], regexp_replace(string_split(path, '/')[-1], '(.)\\.[^.]*$', '\\1')) AS key FROM k""".replace("\\\\", "\\"))
def frame_keys(spark, sf):
    from ..functions.text import frame_key

    p = fx.load(spark, sf, "part")
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    path = (
        F.when(k % 3 == 0, F.concat(F.lit("/data/interval5_"), "p_brand", F.lit("/CAM_x/image"), k.cast("string"), F.lit("_"), s, F.lit(".jpg")))
        .when(k % 3 == 1, F.concat(F.lit("/data/set/"), "p_brand", F.lit("/lidar.txt")))
        .otherwise(F.concat(F.lit("interval5_CAM/a/frame.v2."), s, F.lit("x.bin")))
    )
    return p.select(path.alias("path")).select("path", frame_key(F.col("path")).alias("key"))


@query("SELECT o_orderkey, CASE WHEN contains(s, 'AMtown') THEN 'AMtown' WHEN contains(s, 'AMvalley') THEN 'AMvalley' WHEN contains(s, 'HKairport') THEN 'HKairport' WHEN contains(s, 'HKisland') THEN 'HKisland' ELSE 'other' END AS domain FROM (SELECT o_orderkey, 'interval5_' || ['AMtown01', 'AMvalley02', 'HKairport_GNSS01', 'HKisland03', 'site'][o_orderkey % 5 + 1] AS s FROM orders)")
def scene_domain(spark, sf):
    names = F.array(*map(F.lit, ("AMtown01", "AMvalley02", "HKairport_GNSS01", "HKisland03", "site")))
    o = fx.load(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("interval5_"), F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("scene"))
    return o.select("o_orderkey", frames.domain(F.col("scene")).alias("domain"))
