"""The engine's tables built from the driver's parquet tables, as DataFrames and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import cosine
from ..operators import geometry, lifting, project
from ..operators.lineage import written

TERMS = ["building", "road", "tree", "vegetation", "grass", "water", "vehicle", "parking lot", "bridge", "shadow"]
CLASSES = [1, 3, 14, 13, 4, 6, 20, 18]
#: Term -> class of the fixture vocabulary; shadow stays unmapped.
TERM_CLASS = {"building": 1, "road": 3, "tree": 14, "vegetation": 14, "grass": 13, "water": 4, "vehicle": 20, "parking lot": 18, "bridge": 6}
CAMERA = {"fx": 12.0, "fy": 10.0, "cx": 12.0, "cy": 15.0, "width": 24, "height": 30, "y_sign": -1.0, "z_sign": -1.0}
VOXEL = 3.0


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    us = F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000
    return load(spark, sf_dir, "events").select(
        F.col("event_type").alias("frame_id"),
        F.col("event_id").alias("point_id"),
        (us.cast("double") / 86400000000.0).alias("x"),
        (F.col("user_id") / 10.0).alias("y"),
        (F.col("value") / 50.0).alias("z"),
        (k / 100.0).alias("intensity"),
        (F.col("user_id") % 6).cast("int").alias("label"),
        (F.col("event_id") * 37 % 256).cast("int").alias("r"),
        (F.col("user_id") * 11 % 256).cast("int").alias("g"),
        (k * 5 % 256).cast("int").alias("b"),
    )


def segmented(spark: SparkSession, sf_dir: str, size: float = VOXEL) -> DataFrame:
    return geometry.voxel_partition(points(spark, sf_dir), size)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superpoints with geometry, majority label and n."""
    p = segmented(spark, sf_dir)
    # a stage table: neighbours, weights and labels all start from it
    return written(geometry.superpoint_geometry(p).join(geometry.majority(p), geometry.SEGMENT), "nodes")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    day = F.floor((F.unix_micros("t") - 1704067200000000) / 86400000000).cast("int")
    return e.groupBy(F.col("event_type").alias("term"), day.alias("row"), F.hour("t").alias("col")).agg((F.avg("value") / 100.0).alias("score"))


def raster_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "events").select(F.col("event_type").alias("term")).distinct()
    return names.withColumn("term_idx", F.row_number().over(Window.orderBy("term")) - 1)


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project.with_projection(segmented(spark, sf_dir), **CAMERA)
    return project.footprint(p, CAMERA["width"], CAMERA["height"])


def samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pixel samples of every point and term, and of every segment centre and term."""
    maps, terms = raster(spark, sf_dir), raster_terms(spark, sf_dir)
    own = project.sample_terms(footprints(spark, sf_dir), maps, terms).select("frame_id", "sp_id", "term", "term_idx", "score", "keep")
    centers = geometry.superpoint_geometry(segmented(spark, sf_dir)).select("frame_id", "sp_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    seen = project.footprint(project.with_projection(centers, **CAMERA), CAMERA["width"], CAMERA["height"])
    mid = project.sample_terms(seen, maps, terms).select("frame_id", "sp_id", "term", "term_idx", F.col("score").alias("center"))
    return own, mid


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifting.evidence_stats(*samples(spark, sf_dir), top_share=0.25)


def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term_idx, text_v): the mean vector of each label."""
    long = load(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "e")).groupBy("label", "i").agg(F.avg(F.col("e").cast("double")).alias("p"))
    return long.groupBy(F.col("label").alias("term_idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda s: s["p"]).alias("text_v"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, sp_id, term, term_idx, score, gt, valid): cosines with the label prototypes, eight decimals."""
    e = load(spark, sf_dir, "embeddings").crossJoin(F.broadcast(prototypes(spark, sf_dir)))
    names = F.array(*map(F.lit, TERMS))
    return e.select(
        F.concat(F.lit("f"), (F.col("vec_id") % 4).cast("string")).alias("frame_id"),
        F.col("vec_id").alias("sp_id"),
        F.element_at(names, F.col("term_idx") + 1).alias("term"),
        "term_idx",
        (F.rint(cosine(F.col("embedding"), F.col("text_v")) * 1e8) / 1e8 + 0.0).alias("score"),
        F.col("label").alias("gt"),
        (F.col("vec_id") % 7 != 0).alias("valid"),
    )


def mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TERM_CLASS.items()), "term string, class_id int")


def class_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (frame_id, sp_id, gt, pred) of official classes: truth by label through the term map, prediction by class argmax."""
    from ..operators import segment

    ev = evidence(spark, sf_dir)
    best = segment.class_argmax(segment.class_collapse(ev, mapping(spark), CLASSES), ev.select("frame_id", "sp_id", "valid").distinct())
    names = F.array(*[F.lit(TERM_CLASS.get(t, 0)) for t in TERMS])
    truth = ev.select("frame_id", "sp_id", F.element_at(names, F.col("gt") + 1).alias("gt")).distinct()
    return truth.join(best.withColumnRenamed("class_id", "pred"), ["frame_id", "sp_id"])


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, caption_idx, text): noun phrases of parts by brand."""
    p = load(spark, sf_dir, "part")
    text = F.concat(F.lit("- A "), F.col("p_name"), F.lit(" and some "), F.lower("p_type"), F.lit("s, houses; the Parking_lot with "), F.regexp_extract("p_name", r"^(\w+)", 1), F.lit("ies"))
    return p.select(F.col("p_brand").alias("frame_id"), F.col("p_partkey").alias("caption_idx"), text.alias("text"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return geometry.edge_weights(geometry.knn_edges(n), n)


# SQL of the same tables ------------------------------------------------------------------------------------------------

POINTS = """points AS (
    SELECT event_type AS frame_id, event_id AS point_id,
        (epoch_us(ts) - 1704067200000000)::DOUBLE / 86400000000::DOUBLE AS x, user_id::DOUBLE / 10::DOUBLE AS y, value / 50::DOUBLE AS z,
        (props->>'$.k')::DOUBLE / 100::DOUBLE AS intensity, (user_id % 6)::INTEGER AS label,
        (event_id * 37 % 256)::INTEGER AS r, (user_id * 11 % 256)::INTEGER AS g, ((props->>'$.k')::INTEGER * 5 % 256)::INTEGER AS b
    FROM events)"""


def segmented_sql(size: str = "3::DOUBLE", source: str = "points", out: str = "sp") -> str:
    return f"""lows_{out} AS (SELECT frame_id, min(x) AS ox, min(y) AS oy, min(z) AS oz FROM {source} GROUP BY frame_id),
    cells_{out} AS (SELECT p.*, ox, oy, oz, floor((x - ox) / {size}) AS vx, floor((y - oy) / {size}) AS vy, floor((z - oz) / {size}) AS vz FROM {source} p JOIN lows_{out} USING (frame_id)),
    {out} AS (SELECT *, dense_rank() OVER (PARTITION BY frame_id ORDER BY vx, vy, vz) - 1 AS sp_id FROM cells_{out})"""


SP = f"{POINTS}, {segmented_sql()}"


def adaptive_sql(target: int, least: float = 0.8, overshoot: float = 1.25, out: str = "sp") -> str:
    """The partition of geometry.adaptive_partition, with the same columns as ``segmented_sql`` gives."""
    volume = " * ".join(f"greatest(max({a}) - min({a}), 1e-6)" for a in "xyz")
    return f"""size_1 AS (SELECT frame_id, count(*) AS n, greatest({least}::DOUBLE, pow({volume}, 1::DOUBLE / 3) / pow({target}::DOUBLE, 1::DOUBLE / 3)) AS size FROM points GROUP BY frame_id),
    sized_1 AS (SELECT p.*, n, size FROM points p JOIN size_1 USING (frame_id)), {segmented_sql('greatest(size, 1e-6)', 'sized_1', 'cut_1')},
    found_1 AS (SELECT frame_id, max(sp_id) + 1 AS found FROM cut_1 GROUP BY frame_id),
    size_2 AS (SELECT frame_id, n, CASE WHEN found > {overshoot} * {target} THEN size * pow(found::DOUBLE / {target}, 1::DOUBLE / 3) ELSE size END AS size FROM size_1 JOIN found_1 USING (frame_id)),
    sized_2 AS (SELECT p.*, n, size FROM points p JOIN size_2 USING (frame_id)), {segmented_sql('greatest(size, 1e-6)', 'sized_2', 'cut_2')},
    {out} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN n <= {target} THEN row_number() OVER (PARTITION BY frame_id ORDER BY point_id) - 1 ELSE sp_id END AS sp_id) FROM cut_2)"""


GEOMETRY = f"""{SP},
moments AS (
    SELECT frame_id, sp_id, count(*) AS n, var_pop(intensity) AS var_i, first(ox) AS ox, first(oy) AS oy, first(oz) AS oz,
        avg(x - ox) AS mx, avg(y - oy) AS my, avg(z - oz) AS mz, avg((x - ox) * (x - ox)) AS mxx, avg((y - oy) * (y - oy)) AS myy, avg((z - oz) * (z - oz)) AS mzz,
        avg((x - ox) * (y - oy)) AS mxy, avg((x - ox) * (z - oz)) AS mxz, avg((y - oy) * (z - oz)) AS myz
    FROM sp GROUP BY frame_id, sp_id),
cov AS (SELECT *, greatest(mxx - mx * mx, 0) AS a, greatest(myy - my * my, 0) AS b, greatest(mzz - mz * mz, 0) AS c, mxy - mx * my AS d, mxz - mx * mz AS e, myz - my * mz AS f FROM moments),
mid AS (SELECT *, (a + b + c) / 3 AS q FROM cov),
dev AS (SELECT *, sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM mid),
ang AS (SELECT *, acos(least(greatest(CASE WHEN p > 0 THEN ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p * p * p) ELSE 0 END, -1), 1)) / 3 AS t FROM dev),
eig AS (SELECT *, q + 2 * p * cos(t) AS e3, q + 2 * p * cos(t + 2 * pi() / 3) AS e1 FROM ang),
nodes AS (
    SELECT frame_id, sp_id, n, mx + ox AS cx, my + oy AS cy, mz + oz AS cz, a AS var_x, b AS var_y, c AS var_z, var_i, ln(1 + n) AS log_n,
        (greatest(e3, 0) - greatest(3 * q - e1 - e3, 0)) / greatest(e3, 1e-8) AS linearity, (greatest(3 * q - e1 - e3, 0) - greatest(e1, 0)) / greatest(e3, 1e-8) AS planarity,
        greatest(e1, 0) / greatest(e3, 1e-8) AS scattering, greatest(e1, 0) AS l1, greatest(3 * q - e1 - e3, 0) AS l2, greatest(e3, 0) AS l3
    FROM eig)"""

MAJORITY = """counts AS (SELECT frame_id, sp_id, label, count(*) AS n, min(point_id) AS first FROM sp GROUP BY ALL),
majority AS (SELECT frame_id, sp_id, label, purity FROM (SELECT frame_id, sp_id, label, n / sum(n) OVER (PARTITION BY frame_id, sp_id) AS purity, row_number() OVER (PARTITION BY frame_id, sp_id ORDER BY n DESC, first) AS r FROM counts) WHERE r = 1)"""

KNN = """pairs AS (
    SELECT a.frame_id, a.sp_id AS src, b.sp_id AS dst, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) + (a.cz - b.cz) * (a.cz - b.cz)) AS dist
    FROM nodes a JOIN nodes b ON a.frame_id = b.frame_id AND a.sp_id <> b.sp_id),
knn AS (SELECT frame_id, src, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, src ORDER BY dist, dst) AS r FROM pairs) WHERE r <= 8)"""

RASTER = """raster AS (SELECT event_type AS term, floor((epoch_us(ts) - 1704067200000000) / 86400000000)::INTEGER AS row, hour(ts)::INTEGER AS col, avg(value) / 100::DOUBLE AS score FROM events GROUP BY ALL),
terms AS (SELECT term, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS term_idx FROM (SELECT DISTINCT event_type AS term FROM events))"""


def projected_sql(source: str, out: str) -> str:
    return f"""{out}_uv AS (SELECT *, 12::DOUBLE * ((y * (-1)::DOUBLE) / greatest(x, 1e-6::DOUBLE)) + 12::DOUBLE AS u, 10::DOUBLE * ((z * (-1)::DOUBLE) / greatest(x, 1e-6::DOUBLE)) + 15::DOUBLE AS v, x AS depth FROM {source}),
    {out}_ok AS (SELECT *, depth > 1e-6::DOUBLE AND u >= 0 AND u <= 23 AND v >= 0 AND v <= 29 AS valid FROM {out}_uv),
    {out} AS (SELECT *, valid AND round_even(u, 0) >= 0 AND round_even(u, 0) < 24 AND round_even(v, 0) >= 0 AND round_even(v, 0) < 30 AS keep, round_even(u, 0)::INTEGER AS col, round_even(v, 0)::INTEGER AS row FROM {out}_ok)"""


STATS = f"""{GEOMETRY}, {RASTER}, {projected_sql("sp", "foot")},
centers AS (SELECT frame_id, sp_id, cx AS x, cy AS y, cz AS z FROM nodes), {projected_sql("centers", "mids")},
own AS (SELECT f.frame_id, f.sp_id, t.term, t.term_idx, f.keep, coalesce(r.score, 0) AS score FROM foot f CROSS JOIN terms t LEFT JOIN raster r ON f.keep AND r.term = t.term AND r.row = f.row AND r.col = f.col),
middle AS (SELECT f.frame_id, f.sp_id, t.term, t.term_idx, coalesce(r.score, 0) AS center FROM mids f CROSS JOIN terms t LEFT JOIN raster r ON f.keep AND r.term = t.term AND r.row = f.row AND r.col = f.col),
agg AS (SELECT frame_id, sp_id, term_idx, count(*) AS n, avg(score) AS mean, max(score) AS top, quantile_cont(score, 0.75) AS q75 FROM own WHERE keep GROUP BY ALL),
best AS (SELECT frame_id, sp_id, term_idx, avg(score) AS topk FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, sp_id, term_idx ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY frame_id, sp_id, term_idx) AS m FROM own WHERE keep) WHERE r <= greatest(1, round_even((m * 0.25)::DOUBLE, 0)) GROUP BY ALL),
kept AS (SELECT frame_id, bool_or(keep) AS any_kept FROM own GROUP BY ALL),
stats AS (
    SELECT m.frame_id, m.sp_id, m.term, m.term_idx, center, CASE WHEN any_kept THEN coalesce(mean, 0) ELSE center END AS mean, CASE WHEN any_kept THEN coalesce(top, 0) ELSE center END AS top,
        CASE WHEN any_kept THEN coalesce(q75, 0) ELSE center END AS q75, CASE WHEN any_kept THEN coalesce(topk, 0) ELSE center END AS topk, coalesce(n, 0) AS n
    FROM middle m LEFT JOIN agg USING (frame_id, sp_id, term_idx) LEFT JOIN best USING (frame_id, sp_id, term_idx) LEFT JOIN kept USING (frame_id))"""

_NAMES = ", ".join(f"'{t}'" for t in TERMS)
_IDS = ", ".join(str(TERM_CLASS.get(t, 0)) for t in TERMS)
PROTOTYPES = """long AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings),
proto AS (SELECT label AS term_idx, i, avg(e) AS p FROM long GROUP BY ALL)"""
EVIDENCE = f"""{PROTOTYPES},
ev AS (
    SELECT 'f' || (vec_id % 4) AS frame_id, vec_id AS sp_id, [{_NAMES}][term_idx + 1] AS term, term_idx,
        round_even(sum(e * p) / greatest(sqrt(sum(e * e)) * sqrt(sum(p * p)), 1e-12) * 1e8, 0) / 1e8 + 0 AS score, first(l.label) AS gt, vec_id % 7 <> 0 AS valid
    FROM long l JOIN proto USING (i) GROUP BY vec_id, term_idx)"""
CLASS_LIST = ", ".join(map(str, CLASSES))
CLASS_PRED = f"""{EVIDENCE},
mapped AS (SELECT *, [{_IDS}][term_idx + 1] AS class_id FROM ev),
grid AS (SELECT frame_id, sp_id, valid, c.class_id, c.class_idx FROM (SELECT DISTINCT frame_id, sp_id, valid FROM ev) CROSS JOIN (SELECT unnest([{CLASS_LIST}]) AS class_id, unnest(range({len(CLASSES)})) AS class_idx) c),
collapsed AS (SELECT g.frame_id, g.sp_id, g.valid, g.class_id, g.class_idx, coalesce(max(m.score), -30) AS score FROM grid g LEFT JOIN mapped m USING (frame_id, sp_id, class_id) GROUP BY ALL),
picked AS (SELECT frame_id, sp_id, CASE WHEN valid AND score > -29 THEN class_id ELSE 0 END AS pred FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, sp_id ORDER BY score DESC, class_idx) AS r FROM collapsed) WHERE r = 1),
rows AS (SELECT frame_id, sp_id, gt, pred FROM (SELECT DISTINCT frame_id, sp_id, [{_IDS}][gt + 1] AS gt FROM ev) JOIN picked USING (frame_id, sp_id))"""
CAPTIONS = r"""captions AS (
    SELECT p_brand AS frame_id, p_partkey AS caption_idx, '- A ' || p_name || ' and some ' || lower(p_type) || 's, houses; the Parking_lot with ' || regexp_extract(p_name, '^(\w+)', 1) || 'ies' AS text
    FROM part)"""


def q6(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 0.5003) / 1e6"
