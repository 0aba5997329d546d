"""Null keys, null texts, repeated rows and large ids through every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from terrafold.llm import bpe, covertree, fingerprint, mixing, neardup, order, pii, substring, toxicity, warc
from terrafold.llm._store import scratch_path

from .cases import DOCS

#: Not a float64.
BIG = 2**53 + 1
PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [
    (None, "alpha beta gamma delta epsilon mail a@b.example", None, None, None),
    (None, None, "en", "s", 1),
    (5, "alpha beta gamma delta epsilon zeta", "en", "s", 1),
    (5, "alpha beta gamma delta epsilon zeta", "en", "s", 1),
    (BIG, "call +1 (017) 555-7713 now", None, None, 3),
    (7, None, None, "t", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).withColumn("text_hash", F.lit(None).cast("string"))


def ids(df):
    return sorted((str(r["doc_id"]) for r in df.select("doc_id").collect()))


EVERY = sorted(str(r[0]) for r in ROWS)


def test_fingerprints(docs):
    assert ids(fingerprint.fingerprint_pairs(docs)) == EVERY


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(5, 1, 1), (7, 1, 0), (None, None, None)], "doc_id bigint, quality int, toxic int")
    out = toxicity.score_documents(docs, labels)
    assert ids(out) == EVERY and out.where("held_out IS NULL OR score IS NULL").count() == 0


def test_order(spark, docs):
    source = scratch_path(spark, "docs")
    docs.write.parquet(source)
    out = order.materialise(spark.read.parquet(source), scratch_path(spark, "shards"), PATH, public_tokenizers.PATTERN, seq_len=8)
    assert set(ids(out)) == {"None", "5", str(BIG)}


def test_mixing(docs):
    out = mixing.mix_plan(docs)
    assert ids(out) == EVERY and out.where("taken > 3 * size OR taken IS NULL").count() == 0


def test_personal_data(docs):
    out = {str(r["doc_id"]): r for r in pii.span_digests(docs).collect()}
    assert out[str(BIG)]["n_phone"] == 1 and len(out) == 4


def test_near_duplicates(docs):
    out = neardup.near_duplicates(docs)
    assert ids(out) == EVERY and {r["component_id"] for r in out.where("doc_id IS NOT NULL").collect()} == {5, 7, BIG}


def test_archives_keep_large_ids(spark):
    rows = [(BIG, "u", "x"), (None, "u", "y"), (BIG + 1, "v", "x"), (3, None, None)]
    root = scratch_path(spark, "warc")
    out = {str(r["page_id"]): r for r in warc.read_archives(spark, root, warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(1), root)).collect()}
    assert set(out) == {str(BIG), str(BIG + 1), "3", "None"} and out[str(BIG)]["refers_to"] == BIG + 1


def test_search_keeps_large_ids(spark):
    df = spark.createDataFrame([(BIG, [1.0, 0.0]), (None, [1.0, 1.0]), (100 * (2**53 // 100 + 1), [1.0, 0.5])], "vec_id bigint, embedding array<float>")
    assert [r["vec_id"] for r in covertree.top_products(df).collect()] == [BIG]


def stages_of(spark, docs, labels):
    """The pipeline's stages, each over what the one before gave."""
    clean = toxicity.keep_clean(docs, labels)
    one = neardup.keep_one(clean)
    masked = pii.mask(one)
    return {"toxicity": clean, "neardup": one, "pii": masked, "mixing": mixing.mix_documents(masked)}


def test_stages_keep_ids_extra_columns_and_one_row_of_copies(spark, docs):
    names = ("size", "words", "shard", "place", "mix_source", "row", "doc", "kept_id", "t", "m", "new_text", "slice", "label", "ask")
    odd = docs.withColumns({n: F.when(F.col("doc_id") == BIG, F.lit(BIG)) for n in names})
    labels = spark.createDataFrame([(5, 0), (7, 0)], "doc_id bigint, toxic int")
    for name, out in stages_of(spark, odd, labels).items():
        assert out.columns == odd.columns and out.schema["n_chars"].dataType == odd.schema["n_chars"].dataType
        rows = out.collect()
        big = [r for r in rows if r["size"] is not None]
        assert big and all(r["doc_id"] == BIG and all(r[n] == BIG for n in names) for r in big)
        want = EVERY if name == "toxicity" else sorted({*EVERY, "None "} - {"None "}) + ["None"]
        if name != "mixing":
            assert sorted(str(r["doc_id"]) for r in rows) == sorted(want)
        assert {str(r["doc_id"]) for r in rows} <= set(EVERY)
    empty = stages_of(spark, odd.limit(0), labels)
    assert all(x.count() == 0 and x.columns == odd.columns for x in empty.values())


def test_one_row_of_equal_ones_stays(spark):
    rows = [(1, "a b c d e f", "", "", 1), (1, "a b c d e f", "", "", 1), (2, "A b c d e f", "", "", 1), (1, "other words here", "", "", 1)]
    got = sorted((r["doc_id"], r["text"]) for r in neardup.keep_one(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(1, "a b c d e f"), (1, "other words here")]


def test_bpe(docs):
    assert ids(bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN)) == EVERY


def test_repeats(docs):
    assert ids(substring.remove_repeats(docs)) == EVERY
