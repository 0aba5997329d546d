import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrafold.llm import bpe, fingerprint, pii, toxicity

from .cases import DOCS, clashing, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_bpe_equals_the_library(spark):
    rows = documents() + [(7000, "abc<|endoftext|>de <|endoftext|>", "", "", 1), (7001, "ab" * 6000 + "<|endoftext|>" + "  " * 5000 + "zq" * 5000 + "!?" * 4100, "", "", 1)]
    t = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r for r in bpe.encode_digests(clashing(spark, rows), PATH, public_tokenizers.PATTERN).collect()}
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        assert got[r[0]]["n_tokens"] == len(ids)
        assert got[r[0]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r[0]]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(spark.createDataFrame([], DOCS), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("leaf", [5, 17, 64])
def test_tree_concatenation_is_exact(leaf):
    c = bpe.codec(PATH, public_tokenizers.PATTERN)
    r = random.Random(leaf)
    for alphabet in ("ab", "abcdefghijklmnop", "aé日😀", "ingtheraon"):
        for n in (1, 7, 300, 2000):
            piece = "".join(r.choice(alphabet) for _ in range(n))
            assert c.tree(piece, leaf, workers=1) == c._merge(piece)
            assert c.tree(piece, leaf, workers=3) == c._merge(piece)


BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+".replace(r"[\x20-]", "[ -]")), lambda s: 12 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(d)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def brute_spans(text):
    found = [(m.start(), i, m.end()) for i, (_, p, ok) in enumerate(BASE) for m in p.finditer(text) if ok(m[0])]
    return [(s, BASE[i][0], e) for s, i, e in sorted(found)]


def test_base_spans_match_the_patterns():
    r = random.Random(5)
    cards = ["4111 1111 1111 1111", "4539578763621486", "5500-0000-0000-0004", "12 3456"]
    bits = [*cards, "a@b.c@d.e", "x.y+z@mail.example.com", "@", "1.2.3.4.5.6.7.8", "300.1.1.1", "01.002.3.255", "+1 (017) 555-7713", "+44.20-7946 0958", "+12", "é", "a", " ", "-", ".", "9" * 25, "user@host", "%_@-.-"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randint(1, 9)))
        assert pii.base_spans(t) == brute_spans(t), t
    for t in (random.Random(i) for i in range(3000)):
        s = "".join(t.choice("0123 +-.()@ab") for _ in range(40))
        assert pii.base_spans(s) == brute_spans(s), s


def test_personal_data_adds_secrets_and_keeps_base(spark):
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    rows = documents() + [(8000 + i, f'hello é token = "{key[i:] + key[:i]}" mail a{i}@b.example', "", "", 1) for i in range(20)] + [(8100 + i, f"see commit {key[i:] + key[:i]} now", "", "", 1) for i in range(4)]
    got = {r["doc_id"]: r for r in pii.span_digests(clashing(spark, rows)).collect()}
    for i, t, *_ in rows:
        base = ",".join(f"{k}:{s}:{e}" for s, k, e in brute_spans(t or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert all(re.search(r"secret:15:55,email:", got[8000 + i]["spans"].replace("secret:16:56", "secret:15:55").replace("secret:17:57", "secret:15:55")) for i in range(20)), got[8000]["spans"]
    assert got[8100]["spans"] == ""
    assert pii.span_digests(spark.createDataFrame([], DOCS)).count() == 0
    out = {r["doc_id"]: r for r in pii.mask(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[8000]["text"] == 'hello é token = "<SECRET>" mail <EMAIL>' and out[8000]["n_chars"] == len(out[8000]["text"])
    assert out[1000]["text"] is None and out[0]["text"] == rows[0][1]


def edited_texts(rows):
    rows = sorted(rows, key=lambda r: r[0])
    out = {}
    for i, r in enumerate(rows):
        t, after = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out[r[0]] = t[: len(t) - half] + after[:half]
    return out


def test_edited_texts_follow_doc_id(spark):
    rows = documents(40)
    want = edited_texts(rows)
    for group in (1, 4, 512):
        df = fingerprint.with_next(clashing(spark, rows).repartition(3), rows_per_group=group)
        after = {r["doc_id"]: r["next_text"] for r in df.collect()}
        ordered = sorted(rows, key=lambda r: r[0])
        assert after == {r[0]: ordered[(i + 1) % len(rows)][1] for i, r in enumerate(ordered)}
    got = {r["doc_id"]: r["edited"] for r in fingerprint.fingerprint_pairs(clashing(spark, rows)).select("doc_id", "edited").collect()}
    assert got == want


def units(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(fingerprint.UNIT, low)


def test_winnowing_matches_its_definition(spark):
    rows = documents()
    df = fingerprint.with_fingerprint(clashing(spark, rows), "text", "own")
    got = {r["doc_id"]: r["p"] for r in df.select("doc_id", fingerprint.positions(F.col("own")).alias("p")).collect()}
    entries = {r["doc_id"]: r["own"] for r in df.select("doc_id", "own").collect()}
    for i, t, *_ in rows:
        n = len(units(t)) - fingerprint.K + 1
        if len(units(t)) == 0:
            assert got[i] == []
        elif n < fingerprint.W:
            assert len(got[i]) == 1
        else:
            p = sorted(got[i])
            assert p[0] < fingerprint.W and n - 1 - p[-1] < fingerprint.W and all(b - a <= fingerprint.W for a, b in zip(p, p[1:]))
    same = {}
    for i, t, *_ in rows:
        assert same.setdefault(t or "", entries[i]) == entries[i]


def test_rightmost_minimum_and_match_guarantee(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4))) for _ in range(60)]
    shared = " ".join(r.choice(words) for _ in range(fingerprint.W + fingerprint.K - 1))
    rows = [(i, " ".join([*(r.choice(words) for _ in range(20)), shared, *(r.choice(words) for _ in range(20))]), "", "", 1) for i in range(20)] + [(99, "z " * 60, "", "", 1)]
    df = fingerprint.with_fingerprint(spark.createDataFrame(rows, DOCS), "text", "own")
    got = {x["doc_id"]: set(x["h"]) for x in df.select("doc_id", fingerprint.hashes(F.col("own")).alias("h")).collect()}
    assert all(got[0] & got[i] for i in range(20))
    tied = df.where("doc_id = 99").select(fingerprint.positions(F.col("own")).alias("p")).first()["p"]
    assert sorted(tied) == list(range(fingerprint.W - 1, 56))


def test_fingerprints_of_odd_tables(spark):
    assert fingerprint.fingerprint_pairs(spark.createDataFrame([], DOCS)).count() == 0
    one = fingerprint.fingerprint_pairs(spark.createDataFrame([(5, "abcd", "", "", 1)], DOCS)).first()
    assert one["edited"] == "abab"
    rows = [(None, "n1", "", "", 1), (None, "n2", "", "", 1), (4, "x", "", "", 1), (4, "y", "", "", 1)]
    assert fingerprint.fingerprint_pairs(spark.createDataFrame(rows, DOCS)).count() == 4


def brute_segments(w):
    """Maximal segments by their definition: best subsegments, recursively left and right."""
    out = []

    def walk(lo, hi):
        best, at = 0.0, None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += w[j]
                if total > best + 1e-12:
                    best, at = total, (i, j)
        if at:
            walk(lo, at[0])
            out.append((round(best, 6), *at))
            walk(at[1] + 1, hi)

    walk(0, len(w))
    return out


def test_segments_match_brute_force():
    r = random.Random(9)
    for _ in range(300):
        w = [-1.0 if r.random() < 0.5 else r.uniform(-3, 3) for _ in range(25)]
        hits = [i for i, x in enumerate(w) if x != -1.0]
        got = [(round(s, 6), a, b) for s, a, b in toxicity.segments([w[i] for i in hits], hits, len(w), -1.0)]
        assert got == brute_segments(w)


def test_segment_search_is_linear():
    import time

    def seconds(n, gap):
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            found = toxicity.segments([1.0 - (i % 3) * 0.1 for i in range(n)], list(range(0, gap * n, gap)), gap * n, -0.7)
            best = min(best, time.perf_counter() - began)
        assert found
        return best

    # falling sums (every hit a segment of its own) and rising ones (all join)
    for gap in (4, 1):
        assert seconds(160_000, gap) < 10 * seconds(40_000, gap) < 20


def test_toxicity_learns_from_labels_alone(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(words) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for at in r.sample(range(60), 3):
                w[at] = r.choice(["scumzzz", "scumling", "vilest"])
        rows.append((i, " ".join(w), "en", "s", 1))
        if i % 2 == 0 or bad:
            labels.append((i, 1, int(bad)))
    rows += [(900, None, None, None, None), (901, "", "", "", 0)]
    table = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score_documents(clashing(spark, rows), table).collect()}
    wrong = [i for i in range(400) if got[i]["predicted"] != int(i % 5 == 0)]
    assert len(wrong) <= 4
    assert all(0 <= x["score"] <= 1 for x in got.values()) and got[900]["predicted"] == 0
    import zlib

    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items())
    kept = {x["doc_id"] for x in toxicity.keep_clean(spark.createDataFrame(rows, DOCS), table).collect()}
    assert kept == {i for i, x in got.items() if x["predicted"] == 0}
    none = toxicity.score_documents(spark.createDataFrame(rows, DOCS), table.limit(0)).collect()
    assert all(x["score"] < 1e-6 for x in none)
    assert toxicity.score_documents(spark.createDataFrame([], DOCS), table).count() == 0
