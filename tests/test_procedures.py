"""Procedures without SQL against plain restatements."""

import itertools
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import geometry, graph, metrics, procedural

GATE = geometry.GATE


def nodes_of(spark, n=40, seed=0):
    rng = np.random.default_rng(seed)
    rows = [("f", i, int(rng.integers(1, 60)), *map(float, rng.normal(size=3) * 4), *map(float, np.abs(rng.normal(size=8))), *map(float, rng.uniform(0, 255, 3)), *map(float, rng.uniform(0, 90, 3)), float(rng.uniform())) for i in range(n)]
    names = ["cx", "cy", "cz", *GATE, "mean_r", "mean_g", "mean_b", "var_r", "var_g", "var_b", "rgb_share"]
    return spark.createDataFrame(rows, "frame_id string, sp_id bigint, n bigint, " + ", ".join(f"{c} double" for c in names))


@pytest.mark.parametrize("n", [2, 40])
def test_local_global_features_from_their_formulas(spark, n):
    df = nodes_of(spark, n)
    f = df.toPandas().sort_values("sp_id")
    std = lambda m: (m - m.mean(0)) / np.maximum(m.std(0), 1e-6)

    def unit(m):
        low, high = np.quantile(m, 0.02, axis=0), np.quantile(m, 0.98, axis=0)
        return np.clip((m - low) / np.maximum(high - low, 1e-6), 0, 1)

    xyz, gate, rgb = f[["cx", "cy", "cz"]].to_numpy(), f[GATE].to_numpy(), f[["mean_r", "mean_g", "mean_b", "var_r", "var_g", "var_b", "rgb_share"]].to_numpy()
    logs = np.hstack([np.log1p(np.clip(gate[:, :5], 0, None)), gate[:, 5:]])
    radius = np.hypot(*(xyz[:, :2] - xyz[:, :2].mean(0)).T)[:, None]
    anchors = np.zeros((n, 1))
    if n > 2:
        own = procedural.kmeans(std(xyz), 5)
        mid = np.array([std(xyz)[own == k].mean(0) for k in range(5)])
        anchors = std(np.sqrt(((std(xyz)[:, None] - mid) ** 2).sum(2)))
    want = np.hstack([0.85 * std(xyz), 0.55 * unit(xyz), 1.15 * std(logs), 0.45 * unit(radius), 0.75 * unit(xyz[:, 2:]), 0.35 * std(np.log1p(f[["n"]].to_numpy(float))), 0.5 * anchors])
    want = np.hstack([want, 1.25 * std(rgb[:, :3] / 255), 0.45 * std(np.log1p(rgb[:, 3:6])), 0.25 * rgb[:, 6:]])
    got = procedural.local_global_features(df, rgb=True).orderBy("sp_id").collect()
    assert np.allclose([r["features"] for r in got], want, atol=1e-7)
    assert len(procedural.local_global_features(df).first()["features"]) == want.shape[1] - 7


def cliques(spark, sizes, weight=0.9, between=0.01):
    label = [k for k, n in enumerate(sizes) for _ in range(n)]
    edges = [("f", i, j, weight if label[i] == label[j] else between) for i, j in itertools.combinations(range(len(label)), 2)]
    rng = np.random.default_rng(1)
    nodes = [("f", i, float(10 * k + rng.normal()), float(rng.normal())) for i, k in enumerate(label)]
    return label, spark.createDataFrame(nodes, "frame_id string, sp_id bigint, x double, y double"), spark.createDataFrame(edges, "frame_id string, src bigint, dst bigint, w double")


def test_spectral_clusters_find_cliques_and_scores_follow_their_formula(spark):
    label, nodes, edges = cliques(spark, [6, 5, 7])
    got = [r["label"] for r in procedural.spectral_clusters(nodes, edges, ["x", "y"], 2, 6).orderBy("sp_id").collect()]
    assert len(set(zip(got, label))) == 3
    found = procedural.spectral_candidates(nodes, edges, 2, 6).cache()
    scores = {r["candidate"]: r["score"] for r in procedural.clustering_scores(found, nodes, ["x", "y"]).collect()}
    rows = found.toPandas().sort_values("sp_id")
    at = nodes.toPandas().sort_values("sp_id")[["x", "y"]].to_numpy()
    gaps = rows.groupby("candidate").gap.first()
    assert set(scores) == {2, 3, 4, 5, 6}
    for k, part in rows.groupby("candidate"):
        own = part.label.to_numpy()
        n = np.unique(own, return_counts=True)[1]
        sil = []
        for i in range(len(own)):
            d = np.sqrt(((at - at[i]) ** 2).sum(1))
            same = [d[j] for j in range(len(own)) if own[j] == own[i] and j != i]
            other = min(np.mean(d[own == c]) for c in set(own.tolist()) - {own[i]})
            sil.append((other - np.mean(same)) / max(other, np.mean(same)) if same else 0.0)
        part_score = np.mean(sil) if n.min() > 1 else -1.0
        want = 0.42 * gaps[k] / max(gaps.max(), 1e-6) + 0.38 * part_score + 0.12 * (1 - min(n.std() / n.mean(), 1)) + 0.08 * np.log1p(k) / np.log1p(6)
        assert scores[k] == pytest.approx(want, abs=1e-9)
    assert procedural.spectral_clusters(nodes.where("sp_id < 2"), edges, ["x", "y"]).select("label").distinct().count() == 1


def test_the_best_clustering_has_the_best_sum(spark):
    label, nodes, edges = cliques(spark, [6, 6])
    both = [("f", i, c, label[i] if c == 0 else i % 2) for i in range(12) for c in (0, 1)]
    labels = spark.createDataFrame(both, "frame_id string, sp_id bigint, candidate int, label bigint")
    s = procedural.silhouettes(labels, nodes, ["x", "y"])
    table = metrics.cut_objective(labels, edges, s)
    best = metrics.best_candidate(table).collect()
    assert [r["candidate"] for r in best] == [0]


def test_corrupted_boundaries_are_the_first_edges_by_key(spark):
    r = random.Random(2)
    labels = [("f", i, r.randint(0, 3), r.random() < 0.8) for i in range(30)]
    edges = list({("f", r.randrange(30), r.randrange(30), 1.0) for _ in range(120)})
    e = spark.createDataFrame(edges, "frame_id string, src bigint, dst bigint, w double")
    got = {x["sp_id"]: (x["label"], x["valid"]) for x in graph.corrupt_boundaries(spark.createDataFrame(labels, "frame_id string, sp_id bigint, label int, valid boolean"), e, 0.25, 3).collect()}
    keyed = sorted((x["h"], x["src"], x["dst"]) for x in e.withColumn("h", F.xxhash64(F.lit(3), "src", "dst")).collect())
    own = {i: (v, ok) for _, i, v, ok in labels}
    want, take = dict(own), max(1, int(30 * 0.25))
    chosen = [(s, d) for _, s, d in keyed if own[s][1] and 0 not in (own[s][0], own[d][0]) and own[s][0] != own[d][0]][:take]
    for s, d in chosen:
        want[d] = (own[s][0], True)
    assert got == want and got != own


def test_kmeans_baseline_and_entities(spark):
    rng = np.random.default_rng(5)
    mids = np.eye(4) * 8
    rows = [(i, [float(x) for x in mids[i % 4] + rng.normal(size=4) * 0.3]) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, v array<double>").select("*", *[F.col("v")[i].alias(f"e{i}") for i in range(4)])
    names = [f"e{i}" for i in range(4)]
    got = procedural.kmeans_baseline(df, names, 4).toPandas()
    at = got[names].to_numpy()
    means = np.stack([at[got.label == k].mean(0) for k in range(4)])
    assert (((at[:, None] - means) ** 2).sum(2).argmin(1) == got.label).all() and got.groupby("label").id.nunique().tolist() == [20] * 4
    texts = spark.createDataFrame([(t, [float(x) for x in mids[t] + 0.5]) for t in range(4)], "term_idx int, text_v array<double>")
    out = procedural.entity_vocabulary(df, texts, names, 4).collect()
    assert sorted(r["term_idx"] for r in out) == [0, 1, 2, 3] and all(r["similarity"] > 0.9 for r in out)


def test_the_gate_learns_which_edges_stay_within(spark):
    rng = np.random.default_rng(6)
    rows = [("f", i, i + 1, [float(x) for x in np.abs(rng.normal(size=12)) * (0.2 if i % 4 else 2.0)], bool(i % 4)) for i in range(400)]
    edges = spark.createDataFrame(rows, "frame_id string, src bigint, dst bigint, features array<double>, same boolean")
    _, out = procedural.edge_gate(edges)
    got = out.toPandas()
    assert ((got.w > 0.5) == got.same).mean() > 0.95 and got.w.between(0, 1).all()
    model, flat = procedural.edge_gate(edges.where("same"))
    assert model is None and {r["w"] for r in flat.collect()} == {0.5}


def test_attention_row_by_row(spark):
    rng = np.random.default_rng(7)
    n, d, g, heads, h = 9, 6, 3, 2, 5
    x, gate = rng.normal(size=(n, d)), rng.normal(size=(n, g))
    w = {k: rng.normal(size=(d, d)) for k in "qkvo"} | {"g1": rng.normal(size=(g, h)), "b1": rng.normal(size=h), "g2": rng.normal(size=(h, heads)), "b2": rng.normal(size=heads)}
    pairs = [(i, j) for i in range(n - 1) for j in rng.choice([k for k in range(n) if k != i], 3, replace=False).tolist()]
    nodes = spark.createDataFrame([("f", i, *map(float, x[i]), *map(float, gate[i])) for i in range(n)], "frame_id string, sp_id bigint, " + ", ".join(f"x{i} double" for i in range(d)) + ", " + ", ".join(f"g{i} double" for i in range(g)))
    edges = spark.createDataFrame([("f", i, j) for i, j in pairs], "frame_id string, src bigint, dst bigint")
    got = procedural.graph_attention(nodes, edges, w, [f"x{i}" for i in range(d)], [f"g{i}" for i in range(g)], heads).orderBy("sp_id").collect()
    size = d // heads
    for i in range(n):
        near = [j for a, j in pairs if a == i]
        out = []
        for k in range(heads):
            part = slice(k * size, (k + 1) * size)
            if not near:
                out.append((x[i] @ w["v"])[part])
                continue
            score = np.array([(x[i] @ w["q"])[part] @ (x[j] @ w["k"])[part] / np.sqrt(size) for j in near])
            soft = np.exp(score - score.max())
            open_ = np.array([1 / (1 + np.exp(-(np.maximum(np.abs(gate[i] - gate[j]) @ w["g1"] + w["b1"], 0) @ w["g2"] + w["b2"])[k])) for j in near])
            share = soft * open_ / (soft * open_).sum()
            out.append(sum(s * (x[j] @ w["v"])[part] for s, j in zip(share, near)))
        assert np.allclose(got[i]["fused"], np.concatenate(out) @ w["o"])


def test_fuzzy_similarity_term_by_term(spark):
    sides = {"a": (["car", "roof"], ["cars", "tree"]), "b": (["x"], []), "c": ([], ["y"])}
    rows = lambda k: spark.createDataFrame([(f, t) for f, s in sides.items() for t in s[k]], "frame_id string, term string")
    got = {r["frame_id"]: r["similarity"] for r in procedural.fuzzy_similarity(rows(0), rows(1)).collect()}
    best = lambda p, g: max(SequenceMatcher(None, p, x).ratio() for x in g)
    assert got == {"a": pytest.approx(np.mean([best(p, sides["a"][1]) for p in sides["a"][0]])), "b": 0.0, "c": 0.0}


def test_matched_metrics_with_coverage_by_permutations(spark):
    r = random.Random(8)
    rows = [(f"f{i % 3}", r.randint(0, 3), r.randint(0, 4), r.random() < 0.7) for i in range(240)]
    got = {x["frame_id"]: x for x in procedural.matched_with_coverage(spark.createDataFrame(rows, "frame_id string, gt int, pred int, valid boolean")).collect()}
    for f in ("f0", "f1", "f2"):
        own = [x for x in rows if x[0] == f]
        seen = [x for x in own if x[3]]
        m = np.zeros((4, 5))
        for _, g, p, ok in seen:
            m[g, p] += 1
        best = max(itertools.permutations(range(5), 4), key=lambda p: sum(m[i, p[i]] for i in range(4)))
        hit = sum(m[i, best[i]] for i in range(4))
        assert got[f]["coverage"] == pytest.approx(len(seen) / len(own)) and got[f]["accuracy"] == pytest.approx(hit / m.sum())


def test_grown_regions_by_hand(spark):
    r = random.Random(9)
    edges = [("f", i, j, round(r.random(), 3)) for i, j in itertools.combinations(range(14), 2) if r.random() < 0.4]
    nodes = spark.createDataFrame([("f", i) for i in range(14)], "frame_id string, sp_id bigint")
    got = [x["label"] for x in procedural.grow_regions(nodes, spark.createDataFrame(edges, "frame_id string, src bigint, dst bigint, w double"), 4).orderBy("sp_id").collect()]
    group = {i: {i} for i in range(14)}
    for _, s, d, _ in sorted(edges, key=lambda e: (-e[3], e[1], e[2])):
        if len({id(g) for g in group.values()}) <= 4:
            break
        if group[s] is not group[d]:
            joined = group[s] | group[d]
            for i in joined:
                group[i] = joined
    assert all((got[i] == got[j]) == (group[i] is group[j]) for i, j in itertools.combinations(range(14), 2))
