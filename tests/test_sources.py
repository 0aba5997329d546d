import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import metrics
from terrafold.sources import las, ply, readers, sinks
from terrafold.streaming import frames as streaming


def test_point_files(spark, tmp_path):
    m = np.arange(12, dtype="<f4").reshape(3, 4)
    m.tofile(tmp_path / "a.bin")
    np.save(tmp_path / "b.npy", m)
    got = readers.points_binary(spark, str(tmp_path)).collect()
    assert len(got) == 6 and all(r["v"] == m[r["point_id"]].tolist() for r in got)
    (tmp_path / "x").mkdir()
    for name, message in (("c.pt", "not a tensor file"), ("d.xyz", "not a point file")):
        (tmp_path / "x" / name).write_bytes(b"1234")
        with pytest.raises(Exception, match=message):
            readers.points_binary(spark, str(tmp_path / "x" / name)).collect()
    (tmp_path / "t").mkdir()
    (tmp_path / "t/l.txt").write_text("1 2  3\n4\t5 6\n\n")
    assert [r["v"] for r in readers.points_text(spark, str(tmp_path / "t")).orderBy("point_id").collect()] == [[1, 2, 3], [4, 5, 6]]
    kinds = {(r["kind"], r["path"].rsplit("/", 1)[1]) for r in readers.discover(spark, str(tmp_path)).collect()}
    assert ("point", "a.bin") in kinds and ("point", "b.npy") in kinds


def test_calibration_and_frames(spark, tmp_path):
    (tmp_path / "sampleinfos.json").write_text(json.dumps([{"P3x3": [[1, 0, 2], [0, 1, 2], [0, 0, 1]], "OriginalImageName": "170.jpg"}, {"P3x3": [[3, 0, 2], [0, 3, 2], [0, 0, 1]], "OriginalImageName": "171.jpg"}]))
    infos = readers.intrinsics(spark, str(tmp_path / "sampleinfos.json"))
    files = spark.createDataFrame([("/d/image171_lidar_b.txt", "image171_lidar_b.txt"), ("/d/image171_lidar_a.txt", "image171_lidar_a.txt"), ("/d/image171_lidar_label.txt", "image171_lidar_label.txt")], "path string, name string")
    got = readers.frame_at(infos, files, 1).first()
    assert got["lidar"] == "/d/image171_lidar_a.txt" and got["label"] == "/d/image171_lidar_label.txt"
    (tmp_path / "bad.json").write_text(json.dumps([{"Width": 3}]))
    with pytest.raises(Exception, match="no P3x3"):
        readers.intrinsics(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "frames.txt").write_text("a:1\n# no\n\n  b:2 \n")
    assert [r["value"] for r in readers.frame_list(spark, str(tmp_path / "frames.txt")).collect()] == ["a:1", "b:2"]


def test_mapping_manifest_and_captions(spark, tmp_path):
    mapping = spark.createDataFrame([("roof", 1), ("road", 3)], "term string, class_id int")
    sinks.save_mapping(mapping, str(tmp_path / "m"), "rule")
    assert sorted(tuple(r) for r in readers.mapping(spark, str(tmp_path / "m")).collect()) == [("road", 3), ("roof", 1)]
    rows = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2")], "sequence string, lidar_filename string, extra string")
    sinks.save_manifest(rows, rows.where("extra = '2'"), str(tmp_path / "tsv"))
    assert [tuple(r) for r in readers.manifest(spark, str(tmp_path / "tsv")).collect()] == [("s", "b", "2")]
    (tmp_path / "c.json").write_text(json.dumps({"f1": {"image": "x.jpg", "caption": "a", "tags": ["b", ["c"]]}, "f2": ["d", None, 3]}))
    got = sorted((r["key"], r["caption_idx"], r["text"]) for r in readers.captions(spark, str(tmp_path / "c.json")).collect())
    assert got == [("f1", 0, "a"), ("f1", 1, "b"), ("f1", 2, "c"), ("f1", 3, "x.jpg"), ("f2", 0, "d"), ("f2", 1, "3")]


def test_caches_replace_their_frames_alone(spark, tmp_path):
    path = str(tmp_path / "cache")
    df = lambda rows: spark.createDataFrame(rows, "frame_id string, v int")
    sinks.save_cache(df([("a", 1), ("b", 2)]), path)
    sinks.save_cache(df([("b", 3)]), path)
    assert sorted((r["frame_id"], r["v"]) for r in sinks.load_cache(spark, path).collect()) == [("a", 1), ("b", 3)]
    todo = sinks.pending(df([("a", 0), ("c", 0)]), sinks.load_cache(spark, path))
    assert [r["frame_id"] for r in todo.collect()] == ["c"]
    report = spark.createDataFrame([("x", "m", 0.5), ("y", "m", 0.7)], "name string, mapper string, miou double")
    assert "| y | m | 0.7000 |" in sinks.markdown(sinks.leaderboard(report, "miou", 1))
    assert sinks.best_per(report, "mapper", "miou", "name").first()["name"] == "y"


def test_ply_source_pushes_boxes(spark, tmp_path):
    v = np.zeros(5000, dtype=ply.VERTEX)
    v["x"], v["y"], v["red"] = np.arange(5000) / 10, 1.5, 200
    path = tmp_path / "map.ply"
    path.write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex 5000\nproperty float x\nend_header\n" + v.tobytes())
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ply.PlySource)
    df = spark.read.format("ply").option("path", path.as_uri()).option("rowsPerPartition", "2000").load()
    assert df.count() == 5000
    box = df.where("x > 10.0 AND x <= 20.0")
    assert box.count() == 100 and box.agg(F.max("r")).first()[0] == 200
    assert ply.cropped(df, (0, 0, -1), (400, 2, 1), 50).count() == 50


def test_las_source(spark, tmp_path):
    n, length, offset = 10, 26, 227
    head = bytearray(offset)
    head[:4] = b"LASF"
    head[24:26] = bytes([1, 2])
    head[104] = 2
    struct.pack_into("<I", head, 96, offset)
    struct.pack_into("<H", head, 105, length)
    struct.pack_into("<I", head, 107, n)
    struct.pack_into("<3d", head, 131, 0.5, 0.5, 0.5)
    struct.pack_into("<3d", head, 155, 100.0, 0.0, 0.0)
    body = b"".join(struct.pack("<iiiHBBbBH3H", i, 2 * i, 3, 77, 0, 5, 0, 0, 0, 65535, 256 * i, 0) for i in range(n))
    path = tmp_path / "t.las"
    path.write_bytes(bytes(head) + body)
    spark.dataSource.register(las.LasSource)
    got = spark.read.format("las").option("path", path.as_uri()).load().orderBy("point_id").collect()
    assert len(got) == n and got[3]["x"] == 101.5 and got[3]["y"] == 3.0 and got[3]["g"] == 3 and got[3]["r"] == 255 and got[3]["label"] == 5
    assert las.resolve(["b/test.las", "a/train.laz", "c/val.las"]) == ["c/val.las", "a/train.laz", "b/test.las"]


def test_frames_stream_to_a_cache(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(f"f{i % 3}", i % 4, (i + i % 2) % 4) for i in range(40)]
    spark.createDataFrame(rows, "frame_id string, gt int, pred int").repartition(4).write.parquet(source)
    stream = streaming.arriving(spark, source, "frame_id string, gt int, pred int")
    q = streaming.process_frames(stream, lambda b: b.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    assert sinks.load_cache(spark, str(tmp_path / "out")).count() == 3
    hist = streaming.running_histogram(streaming.arriving(spark, source, "frame_id string, gt int, pred int"), [0, 1, 2, 3])
    q = hist.writeStream.format("memory").queryName("hist").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check2")).start()
    q.awaitTermination()
    want = metrics.confusion(spark.createDataFrame(rows, "frame_id string, gt int, pred int"), [0, 1, 2, 3])
    assert sorted(map(tuple, spark.table("hist").collect())) == sorted(map(tuple, want.collect()))
