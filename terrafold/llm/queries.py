"""One query per operator, over its whole table; SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, covertree, fingerprint, mixing, neardup, order, pii, substring, toxicity, warc
from ._store import scratch_path, stored, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fingerprint.fingerprint_pairs(table(spark, sf_dir, "documents"))
    own, edited = fingerprint.hashes(F.col("kept")), fingerprint.hashes(F.col("edited_kept"))
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.digest(F.col("kept")).alias("fingerprint"),
        fingerprint.digest(F.col("edited_kept")).alias("edited_fingerprint"),
        fingerprint.likeness(own, edited).alias("near_edited"),
        fingerprint.likeness(own, fingerprint.hashes(F.col("next_kept"))).alias("near_next"),
        F.size("kept").cast("bigint").alias("n_kept"),
    )


def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.materialise(table(spark, sf_dir, "documents"), scratch_path(spark, "shards"), TOKENIZER, public_tokenizers.PATTERN)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(table(spark, sf_dir, "documents"))


def op6_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_products(table(spark, sf_dir, "embeddings"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "warc")
    # all archives are complete before the first is read, and no task holds a writer and a reader
    files, _ = stored(warc.write_archives(table(spark, sf_dir, "pages"), root), "archives")
    return warc.read_archives(spark, root, files.repartition(max(1, min(files.count(), 10_000)), "path"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), TOKENIZER, public_tokenizers.PATTERN)


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return out.withColumnRenamed("kept", "kept_sha256")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op1_winnowing`` fingerprints, without fingerprints, as SQL says it too."""
    df = fingerprint.edited_texts(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of ``op4_mixing``, and whether each source's words meet its target to the word."""
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    met = F.abs(F.sum("taken").over(Window.partitionBy("source")) - F.col("target")) <= 0.5
    return plan.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), met.alias("met"), (F.col("taken") <= 3 * F.col("size")).alias("bounded"))


def base_span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of ``op5_personal_data``."""
    return pii.base_counts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_winnowing, op2_toxic_segments, op3_training_order, op4_mixing, op5_personal_data, op6_dual_tree_search, op7_near_duplicates, op8_warc, op9_bpe, op10_repeated_passages, edited_texts, mix_targets, base_span_counts)}


_OP6_SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_OP7_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s
    FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)
), reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
    d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

_OP10_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS t
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS s FROM words)
), later AS (
    SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY md5(t) ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later
), marked AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
kept AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, w, gone FROM words LEFT JOIN marked USING (doc_id)
), flat AS (
    SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words) ANTI JOIN gone USING (doc_id, i)
), text AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM flat GROUP BY doc_id)
SELECT doc_id, n_words, n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM kept LEFT JOIN text USING (doc_id)
"""


_OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY md5(coalesce(html, ''))) AS last FROM pages),
h AS (SELECT *, sha1(html) AS d FROM p),
bits AS (
    SELECT page_id, html, last, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + list_reduce(list_transform(range(5 * i, 5 * i + 5), lambda b: ((position(substr(d, 1 + b // 4, 1) IN '0123456789abcdef') - 1) >> (3 - b % 4)) & 1), lambda x, y: 2 * x + y)::INTEGER, 1)), '') AS digest
    FROM h
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, digest AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM bits
"""


_EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) // 2 AS half, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS after FROM d)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(left(t, length(t) - half) || left(after, half)) AS edited_sha256 FROM n
"""

_TARGET_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1) % 3 + 1]::DOUBLE AS w FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY 3 * n / w, source) AS i, sum(n) OVER () AS total FROM w),
l AS (SELECT *, (total - coalesce(sum(3 * n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT arg_min(level, i) AS level FROM l WHERE 3 * n / w >= level)
SELECT doc_id, size, n AS source_size, round(least(3 * n, w * f.level), 3) AS target, true AS met, true AS bounded FROM d JOIN l ON l.source IS NOT DISTINCT FROM d.source CROSS JOIN f
"""

_COUNT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (
    SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
        list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone
    FROM d
)
SELECT doc_id, len(email)::BIGINT AS n_email, len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0))::BIGINT AS n_ip,
    len(list_filter(card, lambda x: length(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN (length(x) - i) % 2 = 0 THEN x[i]::INTEGER WHEN x[i]::INTEGER > 4 THEN 2 * x[i]::INTEGER - 9 ELSE 2 * x[i]::INTEGER END)) % 10 = 0))::BIGINT AS n_card,
    len(list_filter(phone, lambda x: length(x) BETWEEN 9 AND 15))::BIGINT AS n_phone
FROM m
"""


def oracle_sql() -> dict[str, str]:
    return {"edited_texts": _EDITED_SQL, "mix_targets": _TARGET_SQL, "base_span_counts": _COUNT_SQL, "op6_dual_tree_search": _OP6_SQL, "op7_near_duplicates": _OP7_SQL, "op8_warc": _OP8_SQL, "op10_repeated_passages": _OP10_SQL}
