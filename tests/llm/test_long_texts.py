"""One text of megabytes, one word of a megabyte, through the operators that take texts whole."""

import random
import time

import public_tokenizers
import pytest

from terrafold.llm import bpe, mixing, neardup, pii, substring, toxicity

from .cases import DOCS
from .test_dedup import brute_components, brute_removal

R = random.Random(12)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 8))) for _ in range(3000)]
LONG = " ".join(R.choice(WORDS) for _ in range(250_000))
ROWS = [(1, LONG, "", "", 1), (2, LONG + " more", "", "", 1), (3, "x" * 1_000_000, "", "", 1), (4, "a few words only", "", "", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(2)


def test_near_duplicates_of_long_texts(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_components(ROWS, 85)


def test_repeats_in_long_texts(docs):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(docs, digest=True).collect()}
    assert got == brute_removal(ROWS)


def test_toxic_segments_of_a_long_text():
    model = toxicity.Model({w: 1.5 for w in WORDS[:1500]}, -0.8)
    began = time.perf_counter()
    assert 0 <= model.score(LONG) <= 1 and model.passages(LONG)
    assert time.perf_counter() - began < 30


def test_mixing_masking_and_encoding_of_long_texts(docs):
    plan = {r["doc_id"]: r for r in mixing.mix_plan(docs).collect()}
    assert plan[1]["size"] == 250_000 and plan[3]["size"] == 1 and sum(r["taken"] for r in plan.values()) == 500_006
    assert {r["doc_id"]: len(r["text"]) for r in pii.mask(docs).collect()} == {r[0]: len(r[1]) for r in ROWS}
    c = bpe.codec(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    for _, text, *_ in ROWS[2:]:
        assert c.decode(c.encode(text)) == text
