"""Samples, records, windows and joins over frames, and the engine's tables in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backends, frames, geometry, metrics
from ..sources import readers
from . import fixtures as fx
from . import views
from .fixtures import q6 as r6
from .geometry_queries import rounded
from .registry import query


@query(f"WITH {fx.POINTS} SELECT frame_id, point_id, x, y, z, CASE WHEN r < 200 THEN label END AS label FROM points")
def paired_samples(spark, sf):
    """Points with the label file's values of the same place; labels may be missing."""
    p = fx.points(spark, sf)
    own = p.select("frame_id", "point_id", F.array("x", "y", "z").alias("v"))
    labels = p.where("r < 200").select("frame_id", "point_id", F.array("label").alias("v"))
    both = readers.paired(own, labels)
    return both.select("frame_id", "point_id", *[F.col("v")[i].alias(c) for i, c in enumerate("xyz")], F.col("label_v")[0].alias("label"))


@query("SELECT p_partkey, p_name FROM part")
def public_fields(spark, sf):
    p = fx.load(spark, sf, "part").select("p_partkey", "p_name", F.col("p_size").alias("_size"), F.col("p_type").alias("_type"))
    return frames.public_columns(p)


_PLACES = "f AS (SELECT event_type AS scene, event_id, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events)"


@query(f"WITH {_PLACES} SELECT place, scene, event_id, event_id * 3 AS n_points FROM f")
def zipped_manifest(spark, sf):
    """A frame list and a manifest side by side by place."""
    e = fx.load(spark, sf, "events").select(F.col("event_type").alias("scene"), "event_id", F.col("event_id").alias("place"))
    m = e.select("place", F.col("scene").alias("sequence"), (F.col("event_id") * 3).alias("n_points"))
    return frames.zip_by_place(e, m).select("place", "scene", "event_id", "n_points")


@query("WITH a AS (SELECT 'o' || o_orderkey AS frame_id, o_totalprice AS a FROM orders WHERE o_totalprice > 100000), b AS (SELECT 'o' || l_orderkey AS frame_id, max(l_extendedprice) AS b FROM lineitem GROUP BY ALL) SELECT frame_id, a, b FROM a JOIN b USING (frame_id)")
def common_reports(spark, sf):
    key = lambda c: F.concat(F.lit("o"), F.col(c).cast("string")).alias("frame_id")
    a = fx.load(spark, sf, "orders").where("o_totalprice > 100000").select(key("o_orderkey"), F.col("o_totalprice").alias("value"))
    b = fx.load(spark, sf, "lineitem").groupBy(key("l_orderkey")).agg(F.max("l_extendedprice").alias("value"))
    return frames.common_frames(a, b, "value")


@query(f"WITH {fx.POINTS} SELECT frame_id, label * 10 + g // 32 AS sp_id, count(*) AS n, {r6('avg(x)')} AS cx, {r6('avg(y)')} AS cy, {r6('avg(z)')} AS cz FROM points GROUP BY ALL")
def external_partition(spark, sf):
    """Descriptors of a partition that comes from elsewhere."""
    p = fx.points(spark, sf)
    other = p.select("frame_id", "point_id", (F.col("label") * 10 + F.floor(F.col("g") / 32)).alias("sp_id"))
    own = geometry.superpoint_geometry(geometry.external_partition(p, other))
    return rounded(own.select("frame_id", "sp_id", "n", "cx", "cy", "cz"), "cx", "cy", "cz")


@query("""WITH c AS (SELECT DISTINCT conv_id FROM conversations), t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY role, turn) - 1 AS i FROM conversations)
SELECT 'c' || conv_id AS key, (i + 1)::INTEGER AS caption_idx, coalesce(text, '') AS text FROM t UNION ALL SELECT 'c' || conv_id, 0, 'scene ' || conv_id FROM c""")
def flattened_captions(spark, sf):
    """Nested caption values as rows: the caption first, then the texts below other keys in their order."""
    c = fx.load(spark, sf, "conversations")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("role", "turn", F.coalesce("text", F.lit("")).alias("t")))), lambda s: s["t"])
    key = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    nested = c.groupBy("conv_id").agg(texts.alias("turns")).select(key.alias("key"), F.to_json(F.struct(F.struct("turns").alias("views"), F.concat(F.lit("scene "), F.col("conv_id").cast("string")).alias("caption"))).alias("value"))
    return readers.flattened(nested)


@query(f"WITH {fx.POINTS}, f AS (SELECT DISTINCT frame_id FROM points) SELECT frame_id, 'seen ' || reverse('img/' || frame_id || '.jpg') AS text FROM f")
def backend_captions(spark, sf):
    """Captions of a backend: a stand-in that reads nothing but the path."""
    images = fx.points(spark, sf).select("frame_id").distinct().withColumn("path", F.concat(F.lit("img/"), "frame_id", F.lit(".jpg")))
    return backends.caption_images(images, _Reversed(), mode="auto")


class _Reversed:
    """A stand-in for trained networks whose answers SQL can give as well."""

    def captions(self, paths: list[str]) -> list[str]:
        return [f"seen {p[::-1]}" for p in paths]

    def encode(self, items: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count("a")), float(t.count("e")) + 1.0] for t in items]

    def scores(self, path: str, prompts: list[str]) -> list:
        return [[[(len(path) + len(p) + i * 3 + j) % 7 / 8.0 for j in range(4)] for i in range(3)] for p in prompts]

    def classes(self, terms: list[str]) -> list[int]:
        return [len(t) % 5 for t in terms]


@query("""WITH f AS (SELECT DISTINCT event_type AS frame_id FROM events), p AS (SELECT DISTINCT p_type AS term, p_type || s AS prompt FROM part CROSS JOIN (SELECT unnest(['', ' roof']) AS s))
SELECT frame_id, term, prompt, i::INTEGER AS row, j::INTEGER AS col, (length('img/' || frame_id || '.jpg') + length(prompt) + i * 3 + j) % 7 / 8::DOUBLE AS semantic FROM f CROSS JOIN p CROSS JOIN (SELECT unnest(range(3)) AS i) CROSS JOIN (SELECT unnest(range(4)) AS j)""")
def backend_evidence(spark, sf):
    """Score maps of a built backend for every prompt."""
    images = fx.points(spark, sf).select("frame_id").distinct().withColumn("path", F.concat(F.lit("img/"), "frame_id", F.lit(".jpg")))
    prompts = fx.load(spark, sf, "part").select(F.col("p_type").alias("term"), F.explode(F.array("p_type", F.concat("p_type", F.lit(" roof")))).alias("prompt")).distinct()
    backends.BUILDERS.setdefault("stand-in", _Reversed)
    return backends.map_evidence(images, prompts, backends.build_evidence("stand-in"))


_ENC = "e AS (SELECT p_name || suffix AS prompt, p_name AS term, length(p_name || suffix)::DOUBLE AS a, length(p_name || suffix) - length(replace(p_name || suffix, 'a', '')) AS b, 1 + length(p_name || suffix) - length(replace(p_name || suffix, 'e', '')) AS c FROM (SELECT DISTINCT p_name FROM part) CROSS JOIN (SELECT unnest(['', ' seen from above', ' area']) AS suffix))"


@query(f"WITH {_ENC}, u AS (SELECT term, a / n AS a, b / n AS b, c / n AS c FROM (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM e)), m AS (SELECT term, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM u GROUP BY ALL), n AS (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM m) SELECT term, {r6('a / n')} AS a, {r6('b / n')} AS b, {r6('c / n')} AS c FROM n")
def prompt_vectors(spark, sf):
    """Encoded prompts of a term, normalised, averaged and normalised again."""
    names = fx.load(spark, sf, "part").select(F.col("p_name").alias("term")).distinct()
    prompts = names.select("term", F.explode(F.array(*[F.concat("term", F.lit(s)) for s in ("", " seen from above", " area")])).alias("prompt"))
    mean = backends.prompt_mean(backends.encode(prompts, "prompt", _Reversed()))
    return rounded(mean.select("term", *[F.col("v")[i].alias(c) for i, c in enumerate("abc")]), "a", "b", "c")


@query("SELECT term, CASE WHEN p > 0 THEN 9 ELSE length(term) % 5 END::INTEGER AS class_id FROM (SELECT p_name AS term, max((p_size > 40)::INTEGER) AS p FROM part GROUP BY ALL)")
def mapped_terms(spark, sf):
    """Known terms from the cache, only new ones from the backend."""
    p = fx.load(spark, sf, "part")
    known = p.where("p_size > 40").select(F.col("p_name").alias("term"), F.lit(9).alias("class_id")).distinct()
    return backends.map_terms(p.select(F.col("p_name").alias("term")), _Reversed(), known)


@query(f"""SELECT event_type AS scene, event_id, value, lag(value) OVER w AS lag, lead(value) OVER w AS lead, {r6('avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS moving, max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS highest
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def frame_windows(spark, sf):
    e = fx.load(spark, sf, "events").select(F.col("event_type").alias("scene"), "event_id", "value", "ts")
    return rounded(frames.frame_windows(e, "value", 3, order=("ts", "event_id")), "moving").drop("ts")


@query("""WITH r AS (SELECT user_id, ts, max(value) AS seen FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT l.event_id, l.user_id, r.seen FROM events l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts WHERE l.event_type <> 'click'""")
def asof_values(spark, sf):
    """The user's last click at or before each other event."""
    e = fx.load(spark, sf, "events")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", F.col("value").alias("seen"))
    return frames.asof_join(e.where("event_type <> 'click'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", ["seen"]).drop("ts")


_SPANS = "s AS (SELECT conv_id AS span_id, (conv_id * 7 % 2000) / 10::DOUBLE AS lo, (conv_id * 7 % 2000) / 10::DOUBLE + 1 + turn AS hi FROM conversations)"


@query(f"WITH {_SPANS} SELECT event_id, span_id, count(*) AS n FROM events JOIN s ON value >= lo AND value < hi GROUP BY ALL")
def interval_pairs(spark, sf):
    """Events whose value lies in a span, by bucketed equality, and how many rows of the span hold it."""
    c = fx.load(spark, sf, "conversations")
    lo = (F.col("conv_id") * 7 % 2000) / 10.0
    spans = c.select(F.col("conv_id").alias("span_id"), lo.alias("lo"), (lo + 1 + F.col("turn")).alias("hi"))
    return frames.interval_counts(fx.load(spark, sf, "events"), spans, "value", "lo", "hi", 4.0, "event_id", "span_id")


@query(f"SELECT event_type AS scene, method, {r6('avg(value)')} AS mean, count(value) AS n, grouping_id(event_type, method)::INTEGER AS level FROM (SELECT event_type, user_id % 3 AS method, value FROM events) GROUP BY CUBE (event_type, method)")
def report_cube(spark, sf):
    e = fx.load(spark, sf, "events").select(F.col("event_type").alias("scene"), (F.col("user_id") % 3).alias("method"), "value")
    return rounded(metrics.cube_means(e, ["scene", "method"], "value"), "mean")


@query(f"SELECT event_type AS scene, method, {r6('avg(value)')} AS mean, count(value) AS n FROM (SELECT event_type, user_id % 3 AS method, value FROM events) GROUP BY GROUPING SETS ((event_type, method), (method), ())")
def report_grouping_sets(spark, sf):
    e = fx.load(spark, sf, "events").select(F.col("event_type").alias("scene"), (F.col("user_id") % 3).alias("method"), "value")
    return rounded(metrics.grouping_means(e, [["scene", "method"], ["method"], []], "value"), "mean")


@query()
def approximate_report(spark, sf):
    """Approximate distinct users and medians: sketches, so tests compare them with the exact ones."""
    return metrics.approximate(fx.load(spark, sf, "events"), "event_type", "user_id", "value")


@query("""SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, quarter(o_orderdate)::INTEGER AS quarter, dayofyear(o_orderdate)::INTEGER AS day, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, strftime(o_orderdate + INTERVAL 45 DAY, '%Y-%m-%d') AS due,
date_diff('day', o_orderdate, TIMESTAMP '1999-01-01')::INTEGER AS age, strftime(o_orderdate + INTERVAL 3 MONTH, '%Y-%m-%d') AS next_quarter FROM orders""")
def date_parts(spark, sf):
    d = F.col("o_orderdate")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return fx.load(spark, sf, "orders").select(
        "o_orderkey", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.dayofyear(d).alias("day"), day(F.date_trunc("month", d)).alias("month"), day(F.date_add(d, 45)).alias("due"),
        F.datediff(F.to_date(F.lit("1999-01-01")), d).alias("age"), day(F.add_months(d, 3)).alias("next_quarter"),
    )


@query(f"WITH {fx.SP}, {fx.CAPTIONS} SELECT frame_id, sp_id, count(*) AS points, {r6('avg(intensity)')} AS intensity, max(z) AS top FROM sp GROUP BY ALL HAVING count(*) > 3 UNION ALL SELECT frame_id, -1, count(*), NULL, NULL FROM captions GROUP BY ALL")
def sql_views(spark, sf):
    """The engine's tables asked in SQL through temporary views."""
    views.register_views(spark, sf, "tf_", ("segments", "captions"))
    df = spark.sql("SELECT frame_id, sp_id, count(*) AS points, avg(intensity) AS intensity, max(z) AS top FROM tf_segments GROUP BY frame_id, sp_id HAVING count(*) > 3 UNION ALL SELECT frame_id, -1, count(*), NULL, NULL FROM tf_captions GROUP BY frame_id")
    return rounded(df, "intensity")


_FILES = "f AS (SELECT 'maps/' || event_type || '.npz' AS path, event_type, count(*) AS n FROM events GROUP BY ALL)"


@query(f"WITH {fx.POINTS}, {_FILES} SELECT p.frame_id, path, n AS n_values, count(*) AS points FROM points p JOIN f ON regexp_extract(path, '([^/]*)\\.npz$', 1) = p.frame_id GROUP BY ALL")
def evidence_files(spark, sf):
    """Evidence caches meet frames by file name."""
    e = fx.load(spark, sf, "events")
    cache = e.groupBy(F.concat(F.lit("maps/"), "event_type", F.lit(".npz")).alias("path")).agg(F.count(F.lit(1)).alias("n_values"))
    return frames.by_file_name(fx.points(spark, sf), cache).groupBy("frame_id", "path", "n_values").agg(F.count(F.lit(1)).alias("points"))


@query(f"WITH {fx.EVIDENCE} SELECT frame_id, sp_id, term_idx, {r6('score + 0.2 * (score * 0.5::DOUBLE)')} AS score FROM ev")
def calibrated_scores(spark, sf):
    from ..operators import segment

    ev = fx.evidence(spark, sf)
    return rounded(segment.calibrate(ev, ev.withColumn("prior", F.col("score") * 0.5), 0.2).select("frame_id", "sp_id", "term_idx", "score"), "score")


