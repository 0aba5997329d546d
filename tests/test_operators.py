"""Operators against plain restatements, and the edge cases that fixtures do not hold."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import numeric, text
from terrafold.operators import backends, frames, geometry, graph, lifting, metrics, procedural, project, segment, vocab


def points(spark, rows):
    return spark.createDataFrame([("f", i, float(x), float(y), float(z), 0.5, 1) for i, (x, y, z) in enumerate(rows)], "frame_id string, point_id bigint, x double, y double, z double, intensity double, label int")


def test_eigenvalues_match_numpy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(200):
        a = rng.normal(size=(3, int(rng.integers(1, 5)))) * 10 ** rng.uniform(-2, 2)
        m = a @ a.T
        rows.append((i, *map(float, (m[0, 0], m[1, 1], m[2, 2], m[0, 1], m[0, 2], m[1, 2])), *map(float, np.maximum(np.linalg.eigvalsh(m), 0))))
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, d double, e double, f double, l1 double, l2 double, l3 double")
    got = df.select("l1", "l2", "l3", *[v.alias(f"g{k}") for k, v in enumerate(numeric.eigenvalues3(*[F.col(x) for x in "abcdef"]))]).toPandas()
    scale = got.l3.to_numpy()
    for k in range(3):
        assert (np.abs(got[f"l{k + 1}"] - got[f"g{k}"]) <= 1e-6 * scale + 1e-12).all()


def test_geometry_of_single_points_and_empty_segments(spark):
    p = points(spark, [(0, 0, 0), (9, 9, 9)])
    p = geometry.voxel_partition(p, 1.0)
    g = geometry.superpoint_geometry(p).collect()
    assert len(g) == 2 and all(r["var_x"] == 0 and r["linearity"] == 0 for r in g)
    dense = geometry.segment_mean(p.where("sp_id = 0"), "intensity", p.select("frame_id", "sp_id")).collect()
    assert sorted((r["sp_id"], r["mean"]) for r in dense) == [(0, 0.5), (1, 0.0)]


def test_voxel_ids_match_numpy_unique(spark):
    rng = np.random.default_rng(2)
    xyz = rng.uniform(-5, 5, (300, 3))
    got = {r["point_id"]: r["sp_id"] for r in geometry.voxel_partition(points(spark, xyz), 1.7).collect()}
    cells = np.floor((xyz - xyz.min(axis=0)) / 1.7).astype(int)
    assert [got[i] for i in range(300)] == np.unique(cells, axis=0, return_inverse=True)[1].reshape(-1).tolist()


def test_neighbours_when_there_are_few(spark):
    nodes = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0), ("b", 0, 0.0, 0.0, 0.0), ("b", 1, 1.0, 0.0, 0.0), ("b", 2, 3.0, 0.0, 0.0)], "frame_id string, sp_id bigint, cx double, cy double, cz double")
    got = sorted((r["frame_id"], r["src"], r["dst"], r["dist"]) for r in geometry.knn_edges(nodes, 8).collect())
    assert [(s, d) for f, s, d, _ in got if f == "b"] == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)] and not [g for g in got if g[0] == "a"]
    assert geometry.knn_edges(nodes, 8, farthest=1.5).count() == 2


def test_nearest_within_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    p, s = rng.uniform(0, 10, (200, 3)), rng.uniform(0, 10, (60, 3))
    sites = points(spark, s).withColumnRenamed("point_id", "site_id")
    got = {r["point_id"]: (r["site_id"], r["dist"]) for r in geometry.nearest_within(points(spark, p), sites, 1.3).collect()}
    d = np.sqrt(((p[:, None] - s[None]) ** 2).sum(axis=2))
    want = {i: int(d[i].argmin()) for i in range(200) if d[i].min() <= 1.3}
    assert {i: v[0] for i, v in got.items()} == want


def test_majority_ties(spark):
    df = spark.createDataFrame([("f", 0, 5, 3), ("f", 0, 6, 1), ("f", 0, 7, 1), ("f", 0, 8, 3)], "frame_id string, sp_id bigint, point_id bigint, label int")
    assert geometry.majority(df).first()["label"] == 3 and geometry.majority(df, smallest=True).first()["label"] == 1


def test_ranks_and_softmax_invariants(spark):
    rows = [("f", s, f"t{t}", t, float((s * 7 + t * 3) % 5)) for s in range(6) for t in range(4)] + [("g", 0, "t0", 0, 1.0)]
    df = spark.createDataFrame(rows, "frame_id string, sp_id bigint, term string, term_idx int, score double")
    r = df.withColumn("rank", lifting.normalized_rank("score", ["frame_id", "sp_id"])).toPandas()
    assert r["rank"].between(0, 1).all() and r[r.frame_id == "g"]["rank"].tolist() == [1.0]
    s = segment.softmax_stats(df).toPandas()
    assert s.confidence.between(0, 1).all() and s.entropy.between(-1e-9, 1 + 1e-9).all()
    same = segment.softmax_stats(spark.createDataFrame([("f", 0, "a", 0, 2.0), ("f", 0, "b", 1, 2.0)], df.schema)).first()
    assert abs(same["margin"]) < 1e-12 and abs(same["entropy"] - 1) < 1e-9


def test_labels_of_invalid_segments_and_empty_vocabularies(spark):
    rows = [("f", s, t, i, v, s != 1) for s in range(2) for i, (t, v) in enumerate((("a", 0.1), ("b", 0.9)))]
    df = spark.createDataFrame(rows, "frame_id string, sp_id bigint, term string, term_idx int, score double, valid boolean")
    got = {r["sp_id"]: r["term"] for r in segment.assign_labels(df).collect()}
    assert got == {0: "b", 1: "a"}
    none = spark.createDataFrame([], "frame_id string, term string")
    assert {r["sp_id"]: r["term"] for r in segment.assign_labels(df, none).collect()} == got
    assert {r["sp_id"]: r["term"] for r in segment.assign_labels(df, spark.createDataFrame([("f", "a")], none.schema)).collect()} == {0: "a", 1: "a"}
    unmapped = segment.class_collapse(df, spark.createDataFrame([("zzz", 1)], "term string, class_id int"), [1, 2])
    assert {r["class_id"] for r in segment.class_argmax(unmapped, df.select("frame_id", "sp_id", "valid").distinct()).collect()} == {0}


def test_routing_leaves_hopeless_scenes_alone(spark):
    rows = [("f", 0, f"t{i}", i, float(i), False) for i in range(5)]
    df = spark.createDataFrame(rows, "frame_id string, sp_id bigint, term string, term_idx int, score double, valid boolean")
    assert sorted(r["score"] for r in segment.route(df, "top2").collect()) == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert sorted(r["score"] for r in segment.balance(df, "mean").collect()) == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_clean_terms_of_odd_texts(spark):
    df = spark.createDataFrame([(x,) for x in ("", "!!!", "the", "areas", "Glass", "berries", "a-b_c", "big trees", "ies")], "x string")
    got = {r["x"]: r["t"] for r in df.select("x", text.clean_open_term(F.col("x")).alias("t")).collect()}
    assert got == {"": "", "!!!": "", "the": "the", "areas": "", "Glass": "glass", "berries": "berry", "a-b_c": "a-b c", "big trees": "big tree", "ies": "ies"}
    phrases = spark.createDataFrame([("f", 0, "1. The red cars and a tree, image; one two three four five six")], "frame_id string, caption_idx int, text string")
    assert [r["term"] for r in vocab.caption_phrases(phrases).orderBy("pos").collect()] == ["red car", "tree"]


def test_assignment_matches_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        r, c = rng.integers(1, 6, 2)
        m = rng.integers(0, 20, (r, c)).astype(float)
        got = sum(m[i, j] for i, j in procedural.assign(m))
        if r <= c:
            best = max(sum(m[i, p[i]] for i in range(r)) for p in itertools.permutations(range(c), int(r)))
        else:
            best = max(sum(m[p[j], j] for j in range(c)) for p in itertools.permutations(range(r), int(c)))
        assert got == best


def test_matched_metrics_denominators(spark):
    rows = [("f", 0, 7)] * 6 + [("f", 1, 8)] * 3 + [("f", 2, 7)] * 1 + [("f", -1, 9)] * 5
    df = spark.createDataFrame(rows, "frame_id string, gt int, pred int")
    a, b = procedural.matched_metrics(df).first(), procedural.matched_metrics(df, denominator="gt").first()
    assert a["accuracy"] == pytest.approx(0.9) and a["miou"] == pytest.approx((6 / 7 + 1) / 2) and b["miou"] == pytest.approx((6 / 7 + 1) / 3)
    assert procedural.matched_metrics(df.where("gt < 0")).count() == 0


def test_agreement_of_identical_and_constant_labels(spark):
    df = spark.createDataFrame([("f", i % 3, i % 3 + 5) for i in range(30)] + [("g", 0, 0)] * 4, "frame_id string, gt int, pred int")
    got = {r["frame_id"]: r for r in metrics.agreement(df, ["frame_id"]).collect()}
    assert got["f"]["nmi"] == pytest.approx(1) and got["f"]["ari"] == pytest.approx(1) and got["g"]["nmi"] == 1.0


def test_propagation_as_joins_equals_the_grouped_pass(spark):
    nodes = spark.createDataFrame([("f", i, i % 3 if i % 4 else -1, i % 5 != 2) for i in range(20)], "frame_id string, sp_id bigint, index int, valid boolean")
    edges = spark.createDataFrame([("f", i, (i * 3 + 1) % 20, 0.1 + i % 4) for i in range(20)], "frame_id string, src bigint, dst bigint, w double")
    want = {r["sp_id"]: r["index"] for r in graph.label_propagation(nodes, edges, 3, steps=2).collect()}
    start = nodes.crossJoin(spark.range(3).select(F.col("id").cast("int").alias("term_idx")))
    ok = F.col("valid") & (F.col("index") >= 0)
    start = start.select("frame_id", "sp_id", "term_idx", F.when(ok, (F.col("index") == F.col("term_idx")).cast("double")).otherwise(1 / 3).alias("p"))
    now = start
    for _ in range(2):
        now = graph.propagation_step(start, now, edges)
    best = segment.argmax(now, "p", ("term_idx",)).collect()
    p = now.toPandas().pivot(index="sp_id", columns="term_idx", values="p").to_numpy()
    clear = {i for i in range(20) if np.sort(p[i])[-1] - np.sort(p[i])[-2] > 1e-9}
    assert all(want[r["sp_id"]] == r["term_idx"] for r in best if r["sp_id"] in clear) and len(clear) > 5


def test_refinement_masks_invalid_segments(spark):
    rows = [("f", s, t, float(s == t), float(s == t), s != 2) for s in range(3) for t in range(3)]
    scores = spark.createDataFrame(rows, "frame_id string, sp_id bigint, term_idx int, small double, large double, valid boolean")
    edges = spark.createDataFrame([("f", 0, 1, 0.5), ("f", 1, 0, 0.5), ("f", 1, 2, 0.9)], "frame_id string, src bigint, dst bigint, w double")
    got = graph.geometry_refine(scores, edges).toPandas()
    assert (got[got.sp_id == 2].score == -30).all() and np.isfinite(got.score).all()
    alone = graph.geometry_refine(scores, edges.where("src < 0")).toPandas()
    assert alone[(alone.sp_id == 0)].set_index("term_idx").score.idxmax() == 0


def test_merging_and_growing(spark):
    nodes = spark.createDataFrame([("f", i) for i in range(6)], "frame_id string, sp_id bigint")
    edges = spark.createDataFrame([("f", 0, 1, 0.9), ("f", 1, 2, 0.8), ("f", 3, 4, 0.7), ("f", 2, 3, 0.1), ("f", 4, 5, 0.2)], "frame_id string, src bigint, dst bigint, w double")
    grown = {r["sp_id"]: r["label"] for r in procedural.grow_regions(nodes, edges, 3).collect()}
    assert grown == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2}
    labels = spark.createDataFrame([("f", i, v) for i, v in grown.items()], "frame_id string, sp_id bigint, label bigint")
    assert {r["sp_id"]: r["label"] for r in procedural.merge_small(labels, edges, 2).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}


def test_sampling_positions(spark):
    df = spark.createDataFrame([("s", i) for i in range(10)] + [("t", i) for i in range(2)], "scene string, ts int")
    got = frames.sample_frames(df, 3, 0.1).collect()
    want = sorted({int(np.rint(x)) for x in np.linspace(np.rint(9 * 0.1), np.rint(9 * 0.9), 3)})
    assert sorted(r["ts"] for r in got if r["scene"] == "s") == want and sum(r["scene"] == "t" for r in got) == 2


def test_zip_and_map_errors(spark):
    f = spark.createDataFrame([(0, "a"), (1, "b")], "place int, scene string")
    with pytest.raises(Exception, match="differ in length"):
        frames.zip_by_place(f, spark.createDataFrame([(0, "a")], "place int, sequence string")).collect()
    assert frames.zip_by_place(f, spark.createDataFrame([(0, "a"), (1, "b")], "place int, sequence string")).count() == 2
    site = spark.createDataFrame([("interval5_HKairport_GNSS01",), ("interval5_AMtown02",)], "s string").select(frames.map_name(F.col("s")).alias("m"))
    assert [r["m"] for r in site.collect()] == ["HKairport_GNSS", "AMtown"]
    with pytest.raises(Exception, match="no map"):
        spark.createDataFrame([("x",)], "s string").select(frames.map_name(F.col("s"))).collect()
    with pytest.raises(RuntimeError):
        geometry.not_supported("graph partition")


def test_backends_and_fallbacks(spark):
    images = spark.createDataFrame([("a", "/x/river.jpg")], "frame_id string, path string")
    pixels = spark.createDataFrame([("a", 0.1, 0.9, 0.1)], "frame_id string, r double, g double, b double")

    class Fixed:
        def captions(self, paths):
            return ["said " + p for p in paths]

        def encode(self, items):
            return [[float(len(i)), 1.0] for i in items]

        def classes(self, terms):
            return [len(t) for t in terms]

    assert backends.caption_images(images, None, pixels).first()["text"] == "building, road, tree, vegetation, grass, farmland"
    assert backends.caption_images(images, Fixed()).first()["text"] == "said /x/river.jpg"
    with pytest.raises(RuntimeError):
        backends.caption_images(images, None, mode="model")
    terms = spark.createDataFrame([("ab",), ("abc",)], "term string")
    known = spark.createDataFrame([("ab", 9), ("zz", 1)], "term string, class_id int")
    assert sorted(tuple(r) for r in backends.map_terms(terms, Fixed(), known).collect()) == [("ab", 9), ("abc", 3)]
    v = backends.prompt_mean(backends.encode(terms, "term", Fixed())).collect()
    assert all(abs(sum(x * x for x in r["v"]) - 1) < 1e-9 for r in v)


def test_smoke_scene_is_mostly_visible(spark):
    from terrafold.sources.readers import synthetic_scene

    scene = synthetic_scene(spark)
    assert scene.count() == 4096
    centers = geometry.superpoint_geometry(scene).select("frame_id", "sp_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    seen = project.with_projection(centers, x_forward=False, k=[[90, 0, 64], [0, 90, 64], [0, 0, 1]], t=np.eye(4).tolist(), width=128, height=128)
    assert seen.where("valid").count() > 64


def test_harvested_tags_fall_back_and_fill_up(spark):
    frames_ = spark.createDataFrame([("a",), ("b",)], "frame_id string")
    tags = spark.createDataFrame([("a", 1, "Sedan"), ("a", 2, "gizmo"), ("a", 3, "sedan"), ("b", 1, "nothing")], "frame_id string, pos int, term string")
    got = vocab.harvest_tags(frames_, tags, 10).orderBy("frame_id", "rank").collect()
    assert [r["term"] for r in got if r["frame_id"] == "a"][:3] == ["sedan", "roof", "building"]
    b = [r["term"] for r in got if r["frame_id"] == "b"]
    assert b[:2] == ["building", "roof"] and len(b) == 10 == len(set(b))
