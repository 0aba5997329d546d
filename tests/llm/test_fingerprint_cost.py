"""The class of a run's code points as ranges, and the bounds of with_next as few constants."""

import re

from pyspark.sql import functions as F

from terrafold.llm import fingerprint

from .cases import DOCS


def test_run_class_over_all_code_points(spark):
    negated = rf"[^\x20\x09-\x0D{fingerprint._ALONE}]"
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    ours, theirs = re.compile(fingerprint._RUN), re.compile(negated)
    assert [c for c in every if bool(ours.match(c)) != bool(theirs.match(c))] == []
    df = spark.createDataFrame([("".join(every[i : i + 4096]),) for i in range(0, len(every), 4096)], "t string")
    found = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    assert df.where(found(fingerprint._RUN) != found(negated)).count() == 0


def test_bounds_of_ranges_are_few_constants(spark, monkeypatch):
    rows = [(i, str(i), "", "", 1) for i in range(400)]
    made, lit = [], F.lit
    monkeypatch.setattr(fingerprint.F, "lit", lambda x: made.append(x) or lit(x))
    df = fingerprint.with_next(spark.createDataFrame(rows, DOCS), rows_per_group=1)
    assert len(made) < 40
    assert {r["doc_id"]: r["next_text"] for r in df.collect()} == {i: str((i + 1) % 400) for i in range(400)}
