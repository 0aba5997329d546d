"""Winnowing in text without spaces: a shared passage aligns at any offset."""

import random
import re

import pytest
from pyspark.sql import functions as F

from terrafold.llm import fingerprint

from .cases import DOCS

ALPHABETS = {"thai": "".join(map(chr, range(0x0E01, 0x0E2F))), "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "emoji": "".join(map(chr, range(0x1F600, 0x1F640)))}


def kept(spark, texts):
    df = fingerprint.with_fingerprint(spark.createDataFrame([(i, t, "", "", 1) for i, t in enumerate(texts)], DOCS), "text", "own")
    return {r["doc_id"]: set(r["h"]) for r in df.select("doc_id", fingerprint.hashes(F.col("own")).alias("h")).collect()}


@pytest.mark.parametrize("name", sorted(ALPHABETS))
def test_shifted_copies_share_their_hashes(spark, name):
    r = random.Random(1)
    text = "".join(r.choice(ALPHABETS[name]) for _ in range(3000))
    passage = text[1000 : 1000 + 32]
    other = lambda n: "".join(r.choice(ALPHABETS[name]) for _ in range(n))
    got = kept(spark, [text, *(other(n) + text for n in (1, 2, 3)), *(other(n) + passage + other(7) for n in (0, 5, 6, 7, 500)), passage, other(3000)])
    for i in (1, 2, 3):
        assert len(got[0] & got[i]) >= 0.98 * len(got[0] | got[i])
    assert all(got[0] & got[i] for i in range(4, 10))
    assert len(got[0] & got[10]) <= 0.01 * len(got[0])


def test_units_of_runs_of_every_length(spark):
    # the units as UNIT itself gives them, whatever way they are found
    texts = [f"ab {c * n}日{'xyz' * n} end" for n in range(0, 70) for c in ("q", "😀")]
    df = spark.createDataFrame([(i, t, "", "", 1) for i, t in enumerate(texts)], DOCS)
    rows = fingerprint.with_fingerprint(df, "text", "own", k=1, w=1).select("doc_id", F.size("own").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {i: len(re.findall(fingerprint.UNIT, t)) for i, t in enumerate(texts)}
    short = "abcdefghij " * 3
    assert re.findall(fingerprint.UNIT, short) == ["abcd", "efgh", "ij"] * 3
