"""A corpus from documents: clean, deduplicated, masked, mixed and encoded, stage by stage.

Each stage reads what the one before wrote. ``run`` applies all of them to ``documents``.
Null texts pass as they are until encoding, where they have no tokens. Columns beside those of ``documents``,
whatever their names, pass through all stages but the last. What ties and repeated rows give is said at each stage.
An empty table goes through as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import bpe, mixing, neardup, pii, toxicity
from terrafold.llm._store import stored, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.5; equal texts share their fate, null and empty ones stay."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group whose shingle sets are 0.8 alike or more.

    Of rows that repeat its id and text one stays; rows without an id or without words stay.
    """
    return neardup.keep_one(docs, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span of personal data masked; equal texts are masked alike."""
    return pii.mask(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes of a document, in shuffled shards; rows that repeat an id are documents of their own."""
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row's text; a null text has none."""
    ids = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxic), ("minhash_near_dedup", near_duplicates), ("pii", personal_data), ("mixing", mixed), ("bpe", encoded)]

#: Fitted models, sketches and merges are not SQL; tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
