"""Operators over frames and their bounds, readers, sinks and the run surface, each against a plain restatement."""

import bisect
import json
import random
import zipfile
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

import terrafold
from terrafold.operators import frames, geometry, graph, metrics
from terrafold.operators.lineage import small
from terrafold.plans import views
from terrafold.sources import ply, readers, sinks

SF = "/root/testdata/sf0.001"


def segments(spark, n=90, seed=1):
    r = random.Random(seed)
    rows = [(f"f{i % 2}", i, r.random() * 5, r.random() * 5, float(r.randint(0, 3))) for i in range(n)]
    return spark.createDataFrame(rows, "frame_id string, sp_id bigint, cx double, cy double, cz double")


def test_neighbours_of_large_frames_are_those_of_one_task(spark):
    nodes = segments(spark)
    key = lambda df: sorted((r["frame_id"], r["src"], r["dst"], r["dist"]) for r in df.collect())
    assert key(geometry.knn_edges(nodes, 5, most=7)) == key(geometry.knn_edges(nodes, 5))
    assert geometry.knn_edges(nodes.limit(0), 5).count() == 0
    assert geometry.knn_edges(nodes.where("sp_id < 3"), 5).count() == 2


def test_propagation_by_joins_gives_the_labels_of_one_task(spark):
    nodes = segments(spark)
    edges = geometry.knn_edges(nodes, 4).select("frame_id", "src", "dst", (1 / (1 + F.col("dist"))).alias("w")).cache()
    labels = nodes.select("frame_id", "sp_id", (F.col("sp_id") * 7 % 4).cast("int").alias("index"), (F.col("sp_id") % 3 > 0).alias("valid"))
    key = lambda df: sorted((r["frame_id"], r["sp_id"], r["index"]) for r in df.collect())
    assert key(graph.label_propagation(labels, edges, 4, steps=3, most=10)) == key(graph.label_propagation(labels, edges, 4, steps=3))
    with pytest.raises(Exception, match="45 segments"):
        graph.bounded(labels.where("frame_id = 'f0'").toPandas(), 10)


def test_asof_join_takes_the_last_row_before(spark):
    r = random.Random(3)
    left = [(i, f"u{r.randint(0, 3)}", r.randint(0, 50)) for i in range(80)]
    right = sorted({(f"u{r.randint(0, 3)}", r.randint(0, 50), r.randint(0, 9)) for _ in range(60)})
    got = {x["i"]: x["v"] for x in frames.asof_join(spark.createDataFrame(left, "i int, u string, t int"), spark.createDataFrame(right, "u string, t int, v int"), "u", "t", ["v"]).collect()}
    for i, u, t in left:
        before = [(x[1], x[2]) for x in right if x[0] == u]
        at = bisect.bisect_right(before, (t, 99))
        assert got[i] == (before[at - 1][1] if at else None)


def test_interval_join_matches_all_pairs(spark):
    r = random.Random(4)
    points = [(i, r.uniform(-20, 20)) for i in range(60)]
    spans = [(j, a := r.uniform(-20, 20), a + r.choice([0, 0.5, 3, 11])) for j in range(40)]
    got = frames.interval_join(spark.createDataFrame(points, "i int, x double"), spark.createDataFrame(spans, "j int, a double, b double"), "x", "a", "b", 2.0)
    assert sorted((p["i"], p["j"]) for p in got.collect()) == sorted((i, j) for i, x in points for j, a, b in spans if a <= x < b)


def test_approximate_report_is_near_the_exact_one(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    got = {r["event_type"]: r for r in metrics.approximate(e, "event_type", "user_id", "value").collect()}
    exact = e.groupBy("event_type").agg(F.countDistinct("user_id").alias("keys"), F.median("value").alias("median"), F.max("value").alias("most")).collect()
    for r in exact:
        assert abs(got[r["event_type"]]["keys"] - r["keys"]) <= 0.1 * r["keys"] + 1
        assert abs(got[r["event_type"]]["median"] - r["median"]) <= 0.05 * r["most"]


def test_text_points_are_numbered_over_splits(spark, tmp_path):
    for name, n in (("a.txt", 500), ("b.txt", 3)):
        (tmp_path / name).write_text("\n".join(f"{i} {i * 2}.5  3" if i % 5 else f"\n{i} 0 0" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        got = sorted((r["path"][-5:], r["point_id"], r["v"][0]) for r in readers.points_text(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(name, i, float(i)) for name, n in (("a.txt", 500), ("b.txt", 3)) for i in range(n)]


def tensor_file(path, array, key=None):
    """A file as the tensor library's writer lays it out, by its own pickle opcodes."""
    import pickle
    import sys
    import types

    torch, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")
    rebuild = types.FunctionType((lambda *a: a).__code__, {}, "_rebuild_tensor_v2")
    rebuild.__module__, rebuild.__qualname__ = "torch._utils", "_rebuild_tensor_v2"
    utils._rebuild_tensor_v2 = rebuild
    storage = type("FloatStorage", (), {"__module__": "torch"})
    torch.FloatStorage = storage
    sys.modules.update({"torch": torch, "torch._utils": utils})
    try:
        class Ref:
            pass

        class Tensor:
            def __reduce__(self):
                return rebuild, (Ref(), 0, array.shape, tuple(s // array.itemsize for s in array.strides), False, OrderedDict())

        class Writer(pickle.Pickler):
            def persistent_id(self, obj):
                return ("storage", storage, "0", "cpu", array.size) if isinstance(obj, Ref) else None

        import io

        raw = io.BytesIO()
        Writer(raw, 2).dump({key: Tensor()} if key else Tensor())
    finally:
        del sys.modules["torch"], sys.modules["torch._utils"]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/data.pkl", raw.getvalue())
        z.writestr("archive/data/0", array.astype("<f4").tobytes())


def test_tensor_files_are_points(spark, tmp_path):
    m = np.arange(12, dtype=np.float32).reshape(3, 4)
    tensor_file(tmp_path / "a.pt", m)
    tensor_file(tmp_path / "b.pth", m + 1, "points")
    got = sorted((r["path"][-5:], r["point_id"], r["v"]) for r in readers.points_binary(spark, str(tmp_path)).collect())
    assert [x[2] for x in got] == m.tolist() + (m + 1).tolist()
    import pickle

    from terrafold.sources.tensors import read_tensor

    with zipfile.ZipFile(tmp_path / "c.pt", "w") as z:
        z.writestr("archive/data.pkl", pickle.dumps(json.JSONDecoder))
    with pytest.raises(ValueError, match="not a plain tensor file"):
        read_tensor((tmp_path / "c.pt").read_bytes())


def test_predictions_and_samples_round_trip(spark, tmp_path):
    scene = readers.synthetic_scene(spark, 8, 5)
    files = sinks.save_npy(scene, f"file://{tmp_path}/npy").collect()
    want = [r["label"] for r in scene.orderBy("point_id").collect()]
    assert [(f["frame"], f["rows"]) for f in files] == [("synthetic", 40)] and np.load(f"{tmp_path}/npy/synthetic.npy").tolist() == want
    scene.write.parquet(f"{tmp_path}/scene")
    assert sorted(readers.synthetic_sample(spark, f"{tmp_path}/scene").collect()) == sorted(scene.collect())
    with pytest.raises(ValueError, match="lacks z"):
        scene.drop("z").write.parquet(f"{tmp_path}/other")
        readers.synthetic_sample(spark, f"{tmp_path}/other")


def test_cropped_samples_repeat(spark):
    points = spark.range(5000).select(F.col("id").alias("point_id"), *[(F.col("id") % 100 / 10).alias(a) for a in "xyz"])
    low, high = (0.0,) * 3, (8.0,) * 3
    got = [sorted(r["point_id"] for r in ply.cropped(p, low, high, 200).collect()) for p in (points, points.repartition(7))]
    assert got[0] == got[1] and len(got[0]) == 200 and all(i % 100 <= 80 for i in got[0])
    assert ply.cropped(points, low, high, 10_000).count() == 81 * 50


def test_run_follows_its_configuration(spark, tmp_path):
    from terrafold.plans import fixtures as fx
    from terrafold.plans import protocol_queries as pq

    points = fx.points(spark, SF).withColumn("gt", F.col("label") % 5 + 1)
    maps, terms = fx.raster(spark, SF), fx.raster_terms(spark, SF)
    tables = {"points": points, "raster": maps, "terms": terms, "priors": pq._priors(points, maps, terms), "mappers": terms.select(F.lit("rule").alias("mapper"), "term", (F.col("term_idx") + 1).alias("class_id"))}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
    config = {
        "name": "small", "tables": {n: f"{tmp_path}/{n}" for n in tables}, "camera": fx.CAMERA, "superpoints": {"backend": "voxel", "target_superpoints": 60},
        "lifting": {"variants": ["center", "max", "equal_rank"]}, "evaluation": {"classes": [1, 2, 3, 4, 5], "mappers": ["rule"]}, "output": {"path": f"{tmp_path}/report", "format": "json"},
    }
    (tmp_path / "config.json").write_text(json.dumps(config))
    got = terrafold.run(spark, str(tmp_path / "config.json")).collect()
    assert sorted(r["variant"] for r in got) == ["center", "equal_rank", "top"] and all(0 <= r["oa"] <= 100 for r in got)
    assert spark.read.json(f"{tmp_path}/report").count() == 3
    for wrong in ({**config, "extra": 1}, {**config, "lifting": {"variants": ["best"]}}, {k: v for k, v in config.items() if k != "camera"}, {**config, "superpoints": {"backend": "learned"}}):
        with pytest.raises(ValueError):
            terrafold.run(spark, wrong)


def test_exports_views_and_hints(spark):
    assert all(callable(getattr(terrafold, n)) for n in terrafold.__all__)
    with pytest.raises(AttributeError):
        terrafold.nothing
    assert views.register_views(spark, SF, "t_", ("points",)) == ["t_points"]
    assert spark.sql("SELECT count(*) AS n FROM t_points").first()["n"] == 1000
    rows = spark.range(50)
    assert "broadcast" in small(rows, 50)._jdf.queryExecution().logical().toString().lower() and "broadcast" not in small(rows, 49)._jdf.queryExecution().logical().toString().lower()
