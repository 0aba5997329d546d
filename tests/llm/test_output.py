import base64
import hashlib
import struct

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrafold.llm import covertree, mixing, order, warc
from terrafold.llm._store import scratch_path
from terrafold.llm.permute import feistel

from .cases import DOCS, clashing, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 65537])
def test_feistel_is_a_permutation(n):
    out = feistel(np.arange(n), n, 42)
    assert sorted(out.tolist()) == list(range(n))
    if n > 100:
        assert (out != feistel(np.arange(n), n, 43)).mean() > 0.9 and (out != np.arange(n)).mean() > 0.9


def test_training_order_round_trip(spark):
    rows = documents()
    root = scratch_path(spark, "shards")
    source = f"{scratch_path(spark, 'docs')}"
    clashing(spark, rows).repartition(3).write.parquet(source)
    run = lambda: order.materialise(spark.read.parquet(source), root, PATH, public_tokenizers.PATTERN, seq_len=16, per_shard=100).collect()
    got = sorted(run(), key=lambda r: r["slot"])
    assert [r["slot"] for r in got] == list(range(len(got)))
    t = Tokenizer.from_file(PATH)
    read = list(order.read_slots(root, 0, len(got), 16))
    assert len(read) == len(got)
    by_doc = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["part"])):
        assert hashlib.sha256(read[r["slot"]].tobytes()).hexdigest() == r["record_sha256"]
        by_doc.setdefault(r["doc_id"], []).append(read[r["slot"]])
    for i, text, *_ in rows:
        ids = t.encode(text or "").ids
        flat = np.concatenate(by_doc[i]).tolist() if text else []
        assert flat[: len(ids)] == ids and set(flat[len(ids) :]) <= {t.token_to_id(order.END)} and (not text or len(flat) > len(ids))
    # neighbours in training order come from all over
    docs = [r["doc_id"] for r in got]
    assert sum(a == b for a, b in zip(docs, docs[1:])) < 0.6 * len(docs)
    # resumable: a lost shard comes back alike, the others stay
    middle = [x.tolist() for x in order.read_slots(root, 30, 90, 16)]
    assert middle == [x.tolist() for x in read[30:90]]
    store, base = pafs.FileSystem.from_uri(root)
    files = sorted(f.path for f in store.get_file_info(pafs.FileSelector(base)))
    shards = [f for f in files if f.endswith(".bin")]
    assert len(shards) > 3 and len(files) == len(shards) + 1
    store.delete_file(shards[1])
    assert sorted(run(), key=lambda r: r["slot"]) == got
    assert [x.tolist() for x in order.read_slots(root, 0, len(got), 16)] == [x.tolist() for x in read]
    assert order.materialise(spark.createDataFrame([], DOCS), scratch_path(spark, "none"), PATH, public_tokenizers.PATTERN).count() == 0


def brute_targets(sizes, weights):
    """Water filling by bisection on the common level."""
    total = float(sum(sizes))
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        if sum(min(3.0 * s, mid * w) for s, w in zip(sizes, weights)) < total:
            lo = mid
        else:
            hi = mid
    return [min(3.0 * s, lo * w) for s, w in zip(sizes, weights)]


def test_targets_share_the_excess():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = [int(x) for x in rng.choice([0, 1, 10, 500, 20000], 7)]
        weights = [[5.0, 2.0, 1.0][i % 3] for i in range(7)]
        got = mixing.targets(sizes, weights)
        assert np.allclose(got, brute_targets(sizes, weights), rtol=1e-6, atol=1e-3)


def test_splitting_tree_keeps_quotas():
    quotas = np.array([1000, 0, 37, 5])
    pools = np.array([1500, 9, 37, 6])
    out, room = mixing.split_quotas(quotas, pools, 7, 1)
    assert (out.sum(axis=0) == quotas).all() and (out >= 0).all() and np.ptp(out.sum(axis=1)) <= 2
    assert (room.sum(axis=0) == pools).all() and (room >= out).all()
    assert all((a == b).all() for a, b in zip((out, room), mixing.split_quotas(quotas, pools, 7, 1)))


def test_last_pass_order_is_a_permutation_with_drawn_blocks_first():
    blocks, passes, last = np.array([50, 1, 0, 9]), np.array([1, 2, 0, 0]), np.array([20, 0, 0, 9])
    draw = mixing.Draw(blocks, passes, last, 5, 3)
    for s, n in enumerate(blocks.tolist()):
        shard, turn = draw.last_pass(s, np.arange(n))
        assert sorted(turn.tolist()) == list(range(n))
        first = shard[turn < last[s]]
        assert np.bincount(first, minlength=5).tolist() == np.diff(draw.drawn[s]).tolist()
    slots = np.concatenate([draw.whole_pass(1, np.arange(1), t) for t in range(2)])
    assert np.bincount(slots, minlength=5).tolist() == np.diff(draw.full[1]).tolist()


def test_the_tree_decides_what_is_taken_and_repeated_rows_keep_their_own_copies(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(5 + i % 7)), "en", "ab"[i % 4 == 0], 1) for i in range(200)]
    taken = lambda **o: {r["doc_id"]: r["taken"] for r in mixing.mix_plan(spark.createDataFrame(rows, DOCS), block_words=20, **o).collect()}
    two, eight, other = taken(shards=2), taken(shards=8), taken(shards=8, seed=9)
    assert two != eight and eight != other and sum(two.values()) == sum(eight.values()) == sum(other.values())
    again = [(1, "a b c", "en", "s", 1), (1, " ".join(["z"] * 40), "en", "s", 1), (1, "a b c", "en", "s", 1), (2**53 + 1, "d e", "en", None, 1), (None, "f", "en", "s", 1)]
    docs = clashing(spark, again).withColumns({c: F.lit(9) for c in ("words", "shard", "place", "mix_source", "row", "doc", "new_text", "slice")})
    plan, mixed = mixing.mix_plan(docs).toPandas(), mixing.mix_documents(docs)
    out = mixed.collect()
    assert mixed.columns == docs.columns and sum(len(r["text"].split()) for r in out) == plan.taken.sum()
    assert len(out) == sum(len(c) for c in plan.copies) and {r["doc_id"] for r in out} <= {1, 2**53 + 1, None}


def test_mix_meets_targets_to_the_word(spark):
    rows = documents(120)
    plan = mixing.mix_plan(clashing(spark, rows).repartition(5), shards=4, block_words=50)
    got = plan.toPandas()
    again = mixing.mix_plan(clashing(spark, rows), shards=4, block_words=50).toPandas()
    key = ["doc_id"]
    assert got.sort_values(key).taken.tolist() == again.sort_values(key).taken.tolist()
    words = {r[0]: len([w for w in (r[1] or "").replace("\n", " ").replace("\t", " ").split(" ") if w]) for r in rows}
    assert {i: s for i, s in zip(got.doc_id, got["size"])} == words
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(words[r[0]] for r in rows if r[3] == s) for s in names]
    want = brute_targets(sizes, [[5.0, 2.0, 1.0][i % 3] for i in range(len(names))])
    for s, n, t in zip(names, sizes, want):
        own = got[got.source.isna()] if s is None else got[got.source == s]
        assert (own.source_size == n).all() and np.allclose(own.target, t, rtol=1e-6, atol=1e-3)
        assert abs(own.taken.sum() - t) <= 1
    assert (got.taken <= 3 * got["size"]).all()
    pieces = plan.select("doc_id", F.explode("copies").alias("c")).select("doc_id", "c.*").toPandas()
    assert pieces.groupby("doc_id").words.sum().to_dict() == {i: t for i, t in zip(got.doc_id, got.taken) if t}
    assert pieces.shard.between(0, 3).all()
    mixed = mixing.mix_documents(spark.createDataFrame(rows, DOCS), shards=4, block_words=50)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out = mixed.toPandas()
    assert len(out) == len(pieces)
    assert sum(len(t.split()) for t in out.text) == got.taken.sum()
    assert mixing.mix_plan(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.mix_plan(spark.createDataFrame(rows[-5:-2], DOCS)).agg(F.sum("taken")).first()[0] == 0


PAGES = "page_id bigint, url string, html string"


def test_archives_round_trip(spark):
    rows = [(i, f"http://x/{i}", "<html>" + "ab c" * (i % 9) + "é</html>") for i in range(60)] + [(100, None, None), (101, "u\r\nv", ""), (102, "u", "once"), (None, "u", "nobody")]
    root = scratch_path(spark, "warc")
    df = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit(1)).withColumn("last", F.lit(2))
    got = {r["page_id"]: r for r in warc.read_archives(spark, root, warc.write_archives(df.repartition(3), root)).collect()}
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", -1))
    for i, _, h in rows:
        body = (h or "").encode()
        r = got[i]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        if i is None or last[h or ""] == i:
            assert (r["record_type"], r["refers_to"]) == ("response", None)
        else:
            assert (r["record_type"], r["refers_to"]) == ("revisit", last[h or ""])
    store, base = pafs.FileSystem.from_uri(root)
    files = [f.path for f in store.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".warc.zst")]
    with store.open_input_stream(files[0], compression=None) as f:
        assert struct.unpack("<I", f.read(4))[0] == warc.MAGIC
    least = scratch_path(spark, "warc")
    got = warc.read_archives(spark, least, warc.write_archives(df, least, least=10**6)).collect()
    assert {r["record_type"] for r in got} == {"response"}
    none = scratch_path(spark, "warc")
    assert warc.read_archives(spark, none, warc.write_archives(spark.createDataFrame([], PAGES), none)).count() == 0


def test_dual_tree_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    v = centers[rng.integers(0, 12, 700)] + rng.normal(scale=0.1, size=(700, 16))
    v[100:160] = v[99]
    rows = [(i, [float(np.float32(x)) for x in v[i]], 0) for i in range(700)]
    rows += [(800, None, 0), (900, [1.0, None] + [0.0] * 14, 0), (901, [float("nan")] * 16, 0), (902, [], 0), (1000, [0.5, 0.25], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("v", F.lit(1)).withColumn("score", F.lit(1))
    got = covertree.top_products(df.repartition(3)).toPandas()
    whole = {i: [int(np.floor(1024 * float(x))) for x in e] for i, e, _ in rows if e and all(x is not None and np.isfinite(x) for x in e)}
    want = []
    for q in [i for i in whole if i % 100 == 0]:
        s = sorted(((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q))[:10]
        want += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want)
    assert sorted(covertree.top_products(df, query_bytes=256).collect()) == sorted(got.itertuples(index=False, name=None))
    few = covertree.top_products(df.where("vec_id in (0, 5, 7)")).toPandas()
    assert len(few) == 2
    assert covertree.top_products(df.limit(0)).count() == 0


def test_dual_tree_prunes_clusters():
    rng = np.random.default_rng(0)
    c = rng.integers(-300, 300, (30, 64))
    p = (c[rng.integers(0, 30, 3000)] + rng.integers(-20, 20, (3000, 64))).astype(float)
    q, ids = p[::100], np.arange(3000)
    best = covertree.Best(len(q), 10)
    pairs = covertree.dual_search(q, ids[::100], covertree.cover_tree(p), p, ids, covertree.cover_tree(q, 4), best)
    assert pairs < 0.2 * len(q) * len(p)


def test_queries_and_pipeline_at_small_scale(spark):
    import corpus_pipeline
    from terrafold.llm import neardup, pii, toxicity
    from terrafold.llm.queries import queries

    assert [n.split("_")[0] for n in list(queries())[:10]] == [f"op{i}" for i in range(1, 11)] and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "pii", "mixing", "bpe"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = toxicity.keep_clean(docs, labels)
    kept = {r["doc_id"] for r in neardup.near_duplicates(clean, 80).where("kept").collect()}
    one = corpus_pipeline.near_duplicates(spark, corpus_pipeline.toxic(spark, docs, sf), sf)
    assert {r["doc_id"] for r in one.collect()} == kept and one.columns == docs.columns
    masked = corpus_pipeline.personal_data(spark, one, sf)
    assert masked.columns == docs.columns and masked.count() == len(kept)
    assert not any(pii.base_spans(r["text"]) for r in masked.collect())
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and {r["doc_id"] for r in out.select("doc_id").collect()} <= kept
