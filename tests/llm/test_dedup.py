import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from terrafold.llm import neardup, substring
from terrafold.llm._graph import components
from terrafold.llm._words import words_of

from .cases import DOCS, clashing, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, percent):
    sets = {r[0]: shingles(r[1]) for r in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            a, b = sets[x], sets[y]
            if x < y and a and b and 100 * len(a & b) >= percent * len(a | b):
                i, j = sorted((root(x), root(y)))
                up[j] = i
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_match_brute_force(spark, percent):
    rows = documents()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(clashing(spark, rows), percent).collect()}
    assert got == brute_components(rows, percent)


def test_a_large_family_of_near_copies_keeps_every_link(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(500):
        w = list(base)
        for at in rng.integers(0, 90, rng.integers(0, 5)):
            w[at] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(w), "en", "s", 1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_components(rows, 85)


def test_near_duplicates_of_odd_tables(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c d e f", "", "", 1), (None, "a b c d e f", "", "", 1), (4, "a b c d e f", "", "", 1), (4, "a b c d e f", "", "", 1), (9, None, "", "", 1)]
    got = sorted(neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect(), key=str)
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(4, 4), (4, 4), (9, 9)]
    assert len(got) == 5


def test_densified_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for n in (12, 200, 2000):
        a, b = np.unique(pool[:n]), np.unique(pool[n // 10 : n + n // 10])
        s = neardup.sketches([a, b])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.15


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 150)}


def brute_removal(rows, size=20):
    seen, marks = {}, defaultdict(set)
    for i, t in sorted((r[0], r[1]) for r in rows):
        w = WORD.findall(t or "")
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            if key in seen:
                marks[i].update(range(s, s + size))
            seen.setdefault(key, (i, s))
    out = {}
    for r in rows:
        w = WORD.findall(r[1] or "")
        kept = [x for i, x in enumerate(w) if i not in marks[r[0]]]
        out[r[0]] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_repeats_match_brute_force(spark):
    rows = documents() + [(5000, "la " * 300, "", "", 1), (5001, "x y " + "la " * 25 + "z", "", "", 1), (5002, "q " * 19, "", "", 1)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(clashing(spark, rows).repartition(5), digest=True).collect()}
    assert got == brute_removal(rows)
    # a sketch far too small lets everything through and changes nothing
    again = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(clashing(spark, rows), digest=True, most_cells=1 << 15).collect()}
    assert again == got


def test_repeats_of_odd_tables(spark):
    assert substring.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long, "", "", 1), (None, long, "", "", 1), (3, long, "", "", 1), (3, long, "", "", 1), (8, long, "", "", 1)]
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substring.remove_repeats(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [("3", 0), ("3", 0), ("8", 40), ("None", 0), ("None", 0)]


def test_words_agree_with_the_pattern():
    texts = [r[1] for r in documents()] + ["\x00a\x0bb\x1cc d", "é\x85è"]
    w = words_of(texts)
    for i, t in enumerate(texts):
        own = [w.buffer[a:b].decode() for a, b in zip(w.start[w.doc == i], w.end[w.doc == i])]
        assert own == WORD.findall(t or "")


def thue_morse(n, swap=False):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_words_that_polynomial_hashes_confuse_stay_apart(spark):
    a, b = thue_morse(1024), thue_morse(1024, True)
    rows = [(1, a, "", "", 1), (2, b, "", "", 1), (3, " ".join([a] + ["q"] * 19), "", "", 1), (4, " ".join([b] + ["q"] * 19), "", "", 1), (5, " ".join(thue_morse(64)), "", "", 1), (6, " ".join(thue_morse(64, True)), "", "", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_components(rows, 85)
    out = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(docs, digest=True).collect()}
    assert out == brute_removal(rows)


def test_partial_sketches_merge_in_a_tree(spark, monkeypatch):
    rows = documents(600)
    want = brute_removal(rows)
    levels = []
    real = substring._merge
    monkeypatch.setattr(substring, "_FAN", 1)
    monkeypatch.setattr(substring, "_merge", lambda log, last: levels.append(last) or real(log, last))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(16), digest=True).collect()}
    assert got == want and levels == [False, True]
