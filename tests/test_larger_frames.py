"""Frames and tables beyond what one task, one broadcast or an integer should hold, each against a plain restatement."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import frames, geometry, graph, procedural, project


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_join_broadcasts_no_exploded_points(spark):
    spot = lambda n, m, k: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)) / n).alias("xyz"[k])
    points = spark.range(400).select(F.lit("f").alias("frame_id"), F.col("id").alias("point_id"), *[spot(50.0, 200, k) for k in range(3)])
    sites = spark.range(60).select(F.lit("f").alias("frame_id"), F.col("id").alias("site_id"), *[spot(50.0, 200, k) for k in range(3)])
    df = geometry.nearest_within(points, sites, 1.0)
    assert "BroadcastHashJoin" not in plan(df)
    at = [(r["site_id"], np.array([r["x"], r["y"], r["z"]])) for r in sites.collect()]
    want = {}
    for r in points.collect():
        d = sorted((float(np.sqrt(((np.array([r["x"], r["y"], r["z"]]) - s) ** 2).sum())), i) for i, s in at)
        if d[0][0] <= 1.0:
            want[r["point_id"]] = (d[0][1], round(d[0][0], 9))
    assert want and {r["point_id"]: (r["site_id"], round(r["dist"], 9)) for r in df.collect()} == want


def test_bilinear_samples_ignore_pixels_beyond_integers(spark):
    rows = [("f", 1, 0.5, 0.25, True), ("f", 2, -4e11, 7e12, False), ("f", 3, 1.0, 1.0, None), ("f", 1, 5e15, 0.0, False)]
    points = spark.createDataFrame(rows, "frame_id string, point_id int, u double, v double, valid boolean")
    raster = spark.createDataFrame([(0, 0, 4.0), (0, 1, 8.0), (1, 0, 2.0)], "row int, col int, score double")
    got = {r["point_id"]: r["score"] for r in project.bilinear(points, raster, []).collect()}
    assert got == {1: 0.75 * (0.5 * 4 + 0.5 * 8) + 0.25 * 0.5 * 2, 2: 0.0, 3: 0.0}


@pytest.mark.parametrize("few", [True, False])
def test_interval_counts_group_only_shared_ids(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(frames, "small", lambda df: df)
    r = random.Random(5)
    points = [(r.choice([None, 900, 901, *range(30)]) if i < 40 else i, r.choice([None, r.uniform(-20, 20)])) for i in range(120)]
    spans = [(r.choice([None, *range(9)]), a := r.choice([None, r.uniform(-20, 20)]), None if a is None else a + r.choice([0, 0.5, 3, 11])) for _ in range(50)] * 2
    df = frames.interval_counts(spark.createDataFrame(points, "i int, x double"), spark.createDataFrame(spans, "j int, a double, b double"), "x", "a", "b", 2.0, "i", "j")
    want = {}
    for i, x in points:
        for j, a, b in spans:
            if x is not None and a is not None and a <= x < b:
                want[i, j] = want.get((i, j), 0) + 1
    rows = [tuple(p) for p in df.collect()]
    assert len(rows) == len(want) and {(i, j): n for i, j, n in rows} == want


def test_interval_pairs_of_single_ids_are_not_shuffled(spark):
    e = spark.range(4000).select("id", (F.col("id") % 200).cast("double").alias("x"))
    s = spark.range(300).select(F.col("id").alias("j"), (F.col("id") % 190).cast("double").alias("a"), (F.col("id") % 190 + 9).cast("double").alias("b"))
    df = frames.interval_counts(e, s, "x", "a", "b", 4.0, "id", "j")
    assert df.count() > 40_000
    top, _, rest = plan(df).partition("Union")
    assert "Exchange" not in top and rest


def test_neighbours_are_exact_and_meet_few_positions(monkeypatch):
    r = np.random.default_rng(2)
    for at in (r.random((500, 3)) * [40, 5, 3], np.floor(r.random((500, 3)) * [9, 3, 2]), np.zeros((300, 3))):
        ids = r.permutation(2 * len(at))[: len(at)]
        at[3] = np.nan
        d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
        d[np.eye(len(at), dtype=bool)] = np.inf
        want = [(i, int(ids[j])) for i in range(len(at)) for j in np.lexsort((ids, d[i]))[:8] if np.isfinite(d[i, j])]
        row, dst, _ = geometry.nearest(ids, at, ids, at, 8)
        assert list(zip(row.tolist(), dst.tolist(), strict=True)) == want
    met, distances, per_segment = [], geometry._distances, []
    monkeypatch.setattr(geometry, "_distances", lambda a, b: met.append(len(a) * len(b)) or distances(a, b))
    for n in (5_000, 20_000):
        at, ids = r.random((n, 3)) * [3, n / 100, 3], np.arange(n)
        met.clear()
        assert len(geometry.nearest(ids, at, ids, at, 8)[0]) == 8 * n
        per_segment.append(sum(met) / n)
    assert per_segment[1] < min(3000, 1.5 * per_segment[0])


def test_neighbours_by_slabs_are_those_of_one_task(spark):
    r = random.Random(6)
    rows = [(f"f{i % 2}", i, float(r.randint(0, 40)), float(r.randint(0, 3)), r.choice([0.0, 0.0, 1.5])) for i in range(400)] + [("g", i, 1.0, 1.0, float(i % 2)) for i in range(30)] + [("h", 0, 0.0, 0.0, 0.0)]
    nodes = spark.createDataFrame(rows, "frame_id string, sp_id bigint, cx double, cy double, cz double")
    key = lambda df: sorted(tuple(x) for x in df.collect())
    assert key(geometry.knn_edges(nodes, 5, most=20)) == key(geometry.knn_edges(nodes, 5))


def test_silhouettes_by_shares_are_those_of_all_pairs(spark):
    r = np.random.default_rng(8)
    x = r.random((90, 2))
    own = {0: r.integers(0, 3, 90), 1: np.zeros(90, dtype=int), 2: np.r_[5, r.integers(6, 9, 89)]}
    labels = spark.createDataFrame([("f", i, c, int(own[c][i])) for c in own for i in range(90) if c != 2 or i < 70], "frame_id string, sp_id bigint, candidate int, label bigint")
    nodes = spark.createDataFrame([("f", i, float(a), float(b)) for i, (a, b) in enumerate(x)], "frame_id string, sp_id bigint, x double, y double")

    def plain(n, lab):
        d = np.sqrt(((x[:n, None] - x[None, :n]) ** 2).sum(axis=2))
        out = []
        for i in range(n):
            same = (lab == lab[i]) & (np.arange(n) != i)
            a, b = d[i, same].mean() if same.any() else 0, min(d[i, lab == c].mean() for c in set(lab) - {lab[i]})
            out.append((b - a) / max(a, b) if same.any() else 0)
        return np.mean(out)

    want = {0: plain(90, own[0]), 1: -1.0, 2: plain(70, own[2][:70])}
    for share in (8192, 25):
        got = {x["candidate"]: x["silhouette"] for x in procedural.silhouettes(labels, nodes, ["x", "y"], share).collect()}
        assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)


def test_silhouettes_take_frames_beyond_a_dense_matrix(spark):
    n = procedural.MOST_DENSE + 500
    nodes = spark.range(n).select(F.lit("f").alias("frame_id"), F.col("id").alias("sp_id"), (F.col("id") % 2 * 100 + F.col("id") % 7).cast("double").alias("x"))
    labels = nodes.select("frame_id", "sp_id", F.lit(0).alias("candidate"), (F.col("sp_id") % 2).alias("label"))
    assert procedural.silhouettes(labels, nodes, ["x"]).first()["silhouette"] > 0.9


def spectrum(n, src, dst, w):
    m = np.zeros((n, n))
    np.maximum.at(m, (src, dst), w)
    m = np.maximum(m, m.T)
    np.fill_diagonal(m, np.where(m.sum(axis=1) <= 1e-8, 1e-3, 0))
    scale = 1 / np.sqrt(m.sum(axis=1))
    return np.linalg.eigh(np.eye(n) - scale[:, None] * m * scale[None, :])


@pytest.mark.parametrize("apart", [0, 50])
def test_sparse_spectra_are_those_of_the_dense_matrix(apart):
    from terrafold.operators import spectra

    n, r = 1200, np.random.default_rng(9)
    at = r.random((n, 3)) * [60, 8, 3]
    at[:500, 0] += np.where(np.arange(500) < 300, apart * 10, apart * 30)
    row, dst, dist = geometry.nearest(np.arange(n), at, np.arange(n), at, 6)
    keep = (row != 7) & (dst != 7)
    row, dst, w = row[keep], dst[keep], np.exp(-dist[keep])
    values, vectors = spectra.smallest_eigenpairs(n, row, dst, w, 6)
    want, all_vectors = spectrum(n, row, dst, w)
    assert np.abs(values - want[:6]).max() < 1e-9
    # equal eigenvalues have no basis of their own: the spans are compared, null vectors with the whole null space
    basis = all_vectors[:, want < want[5] + 1e-9]
    assert np.abs(np.linalg.norm(basis.T @ vectors, axis=0) - 1).max() < 1e-6 and np.abs(vectors.T @ vectors - np.eye(6)).max() < 1e-6


def test_cleaning_replaces_no_single_spaces(spark):
    import re

    from terrafold.functions import text

    texts = ["", "  ", "a_b-c", "-x -", "Flies\n", "A B\tc  d\r\n e/f,;", "__--__", "long terms of some  words", " a b", "The Roofs_", "- - ies", "glass; 3 cars"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.clean_open_term(F.col("t")).alias("open"), text.clean_text(F.col("t")).alias("clean"))
    assert "regexp_extract" not in plan(df) and "\\s+" not in plan(df)
    for r in df.collect():
        assert r["clean"] == re.sub(r"\s+", " ", re.sub("[^a-z0-9 /,;]+", " ", re.sub("[_-]", " ", r["t"].strip(" ").lower()))).strip(" ")
        low = re.sub(r"\s+", " ", re.sub("[^a-z0-9 -]+", " ", r["t"].lower().replace("_", " "))).strip(" -")
        last = low.rpartition(" ")[2]
        one = low[:-3] + "y" if last.endswith("ies") and len(last) > 4 else low[:-1] if last.endswith("s") and not last.endswith("ss") and len(last) > 3 else low
        assert r["open"] in (one, "")


def ring(spark, n):
    nodes = spark.range(n).select(F.lit("f").alias("frame_id"), F.col("id").alias("sp_id"), (F.col("id") % 97 / 50).alias("a"), (F.col("id") % 31 / 20).alias("b"))
    edges = nodes.select("frame_id", F.col("sp_id").alias("src"), ((F.col("sp_id") + 1) % n).alias("dst"), (1 + F.col("sp_id") % 1000 / 1000).alias("w"))
    return nodes, edges


def test_region_procedures_take_frames_beyond_the_bound(spark):
    nodes, edges = ring(spark, n := graph.MOST_SEGMENTS + 1000)
    grown = procedural.grow_regions(nodes, edges, 5)
    sizes = [r["count"] for r in grown.groupBy("label").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == n
    labels = nodes.select("frame_id", "sp_id", F.floor(F.col("sp_id") / 3).alias("label"))
    assert procedural.merge_small(labels, edges, 4).groupBy("label").count().agg(F.min("count"), F.sum("count")).first()[1] == n


def test_attention_takes_frames_beyond_the_bound(spark):
    nodes, edges = ring(spark, graph.MOST_SEGMENTS + 1000)
    eye = np.eye(2)
    w = {k: eye for k in "qkvo"} | {"g1": np.zeros((2, 3)), "b1": np.zeros(3), "g2": np.zeros((3, 2)), "b2": np.zeros(2)}
    df = procedural.graph_attention(nodes, edges, w, ["a", "b"], ["a", "b"], 2)
    rows = {r["sp_id"]: r["fused"] for r in df.where("sp_id IN (5, 8191, 66000)").collect()}  # one neighbour each: its values
    assert {k: [round(x, 9) for x in v] for k, v in rows.items()} == {i: [round((i + 1) % 97 / 50, 9), round((i + 1) % 31 / 20, 9)] for i in (5, 8191, 66000)}


def test_merging_small_clusters_is_that_of_the_plain_procedure():
    import pandas as pd

    for seed in range(6):
        r = np.random.default_rng(seed)
        n = 80
        links = pd.DataFrame({"src": r.integers(0, n, 120), "dst": r.integers(0, n, 120), "w": r.integers(1, 40, 120) / 8})
        own, ids, least = np.unique(r.integers(0, 45, n), return_inverse=True)[1], np.arange(n), 4
        got = procedural.merged_small(own.copy(), *procedural._rows(links, ids), least)
        near = procedural._near(links, ids)
        while True:
            moved = False
            for k, size in enumerate(np.bincount(own).tolist()):
                members = np.flatnonzero(own == k)
                if size >= least or not 0 < len(members) < len(own):
                    continue
                pull = {}
                for i in members.tolist():
                    for j, w in near[i].items():
                        if own[j] != k:
                            pull[int(own[j])] = pull.get(int(own[j]), 0) + w
                if pull:
                    own[members], moved = min(pull, key=lambda c: (-pull[c], c)), True
            own = np.unique(own, return_inverse=True)[1]
            if not moved:
                break
        assert (got == own).all()
