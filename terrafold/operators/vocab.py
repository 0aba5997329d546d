"""Vocabulary from captions and evidence: terms, frequencies, scores, verification, mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import CORE_TAGS, FALLBACK_TAGS, GT_EXPANSION, PROMPT_GROUPS, TERM_CLASSES
from ..functions.numeric import EPS
from ..functions.text import normalize_term, phrase_candidates, prompts_for, rs_tags, simple_clean
from .lineage import small


def caption_phrases(captions: DataFrame, max_words: int = 5) -> DataFrame:
    """(frame_id, caption_idx, pos, term): every phrase candidate."""
    return captions.select("frame_id", "caption_idx", F.posexplode(phrase_candidates(F.col("text"), max_words)).alias("pos", "term"))


def term_frequency(captions: DataFrame, max_tags: int = 24, max_words: int = 5, min_frequency: int = 1) -> DataFrame:
    """(frame_id, term, freq, rank): terms by how often they occur, then by first appearance; beyond ``max_tags`` rank is null."""
    return _ranked(caption_phrases(captions, max_words), max_tags, min_frequency)


def _ranked(phrases: DataFrame, max_tags: int, min_frequency: int = 1) -> DataFrame:
    place = F.struct("caption_idx", "pos")
    counts = phrases.groupBy("frame_id", "term").agg(F.count(F.lit(1)).alias("freq"), F.min(place).alias("first"))
    w = Window.partitionBy("frame_id").orderBy((F.col("freq") >= min_frequency).desc(), F.col("freq").desc(), "first")
    rank = F.row_number().over(w)
    return counts.withColumn("rank", rank).withColumn("rank", F.when((F.col("rank") <= max_tags) & (F.col("freq") >= min_frequency), F.col("rank"))).select("frame_id", "term", "freq", "rank")


def caption_records(captions: DataFrame) -> DataFrame:
    """One record per frame: captions, raw terms, normalised terms in rank order, and the frequency map."""
    raw = captions.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("caption_idx", "text"))).alias("c"))
    raw = raw.select("frame_id", F.transform("c", lambda s: s["text"]).alias("captions"), F.flatten(F.transform("c", lambda s: phrase_candidates(s["text"]))).alias("raw_terms"))
    terms = term_frequency(captions).groupBy("frame_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "term")))), lambda s: s["term"]).alias("normalized_terms"),
        F.map_from_entries(F.collect_list(F.struct("term", "freq"))).alias("term_frequency"),
    )
    return raw.join(terms, "frame_id", "left")


def rs_tag_ranking(captions: DataFrame, max_tags: int = 12, keep_roof: bool = False, allow_open: bool = True) -> DataFrame:
    """(frame_id, term, freq, rank): remote-sensing tags by the number of captions that hold them, then first appearance."""
    tags = captions.select("frame_id", "caption_idx", F.posexplode(rs_tags(F.col("text"), keep_roof, allow_open)).alias("pos", "term"))
    return _ranked(tags, max_tags).where("rank IS NOT NULL")


def normalize_list(terms: DataFrame, keep_roof: bool = False) -> DataFrame:
    """(frame_id, term, pos): normal forms, each once at its first place."""
    norm = terms.select("frame_id", "pos", normalize_term(F.col("term"), keep_roof).alias("term")).where("term IS NOT NULL")
    return norm.groupBy("frame_id", "term").agg(F.min("pos").alias("pos"))


def build_prompts(terms: DataFrame) -> DataFrame:
    """(term, prompts) for every distinct term."""
    return terms.select("term").distinct().select("term", prompts_for(F.col("term")).alias("prompts"))


def candidate_groups(lines: DataFrame, max_terms: int = 0) -> DataFrame:
    """(name, prompts, place): one group per taxonomy line ``(line_no, line)``; the first name of a line names it, the first line of a name counts."""
    parts = F.filter(F.transform(F.split(F.col("line"), "[,;]"), simple_clean), lambda p: p != "")
    groups = lines.select("line_no", F.array_distinct(parts).alias("prompts")).where(F.size("prompts") > 0).withColumn("name", F.col("prompts")[0])
    first = groups.groupBy("name").agg(F.min_by("prompts", "line_no").alias("prompts"), F.min("line_no").alias("place"))
    # the place among names: a taxonomy is a configuration of a few hundred lines
    return first.orderBy("place").limit(max_terms) if max_terms > 0 else first


def caption_matches(captions: DataFrame, names: DataFrame) -> DataFrame:
    """(frame_id, name): candidate names that stand as whole words in a frame's joined captions."""
    text = captions.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("caption_idx", "text"))).alias("c")).select("frame_id", F.lower(F.array_join(F.transform("c", lambda s: s["text"]), " ")).alias("text"))
    # names: a configuration of a few hundred rows
    return text.crossJoin(small(names.select("name"))).where(F.expr(r"text rlike concat('\\b', name, '\\b')")).select("frame_id", "name")


def merge_terms(first: DataFrame, second: DataFrame) -> DataFrame:
    """(frame_id, term, pos): the ordered union of two term lists, by term and never by position."""
    both = first.select("frame_id", "term", F.struct(F.lit(0), "pos").alias("p")).unionByName(second.select("frame_id", "term", F.struct(F.lit(1), "pos").alias("p")))
    low = both.groupBy("frame_id", "term").agg(F.min("p").alias("p"))
    return low.select("frame_id", "term", (F.row_number().over(Window.partitionBy("frame_id").orderBy("p")) - 1).alias("pos"))


def harvest_tags(frames: DataFrame, tags: DataFrame, max_tags: int) -> DataFrame:
    """(frame_id, term, prompts, rank): a frame's usable tags by ``pos``, or the fallback ones, then the core tags, each once.

    ``tags`` is (frame_id, pos, term); a tag is usable if it has a class or prompts.
    """
    known = sorted({*TERM_CLASSES, *PROMPT_GROUPS})
    own = tags.select("frame_id", simple_clean(F.col("term")).alias("term"), F.struct(F.lit(0).alias("list"), "pos").alias("p")).where(F.col("term").isin(known))
    kind = tags.schema["pos"].dataType.simpleString()
    listed = lambda names, place: F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.struct(F.lit(place).alias("list"), F.lit(i).cast(kind).alias("pos")).alias("p")) for i, t in enumerate(names)])).alias("t")
    spare = frames.select("frame_id").join(own.select("frame_id").distinct(), "frame_id", "left_anti").select("frame_id", listed(FALLBACK_TAGS, 1)).select("frame_id", "t.*")
    core = frames.select("frame_id", listed([t for t in CORE_TAGS if t in known], 2)).select("frame_id", "t.*")
    first = own.unionByName(spare).unionByName(core).groupBy("frame_id", "term").agg(F.min("p").alias("p"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("frame_id").orderBy("p"))).where(F.col("rank") <= max_tags)
    table = F.create_map(*[x for k, v in PROMPT_GROUPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return ranked.select("frame_id", "term", F.coalesce(table[F.col("term")], F.array("term")).alias("prompts"), "rank")


def caption_frequency(terms: DataFrame, candidates: DataFrame) -> DataFrame:
    """(frame_id, term, caption_freq): each candidate's share of the frame's term occurrences, 0 if unseen."""
    counts = terms.groupBy("frame_id", "term").agg(F.count(F.lit(1)).alias("n"))
    total = terms.groupBy("frame_id").agg(F.count(F.lit(1)).alias("total"))
    return candidates.join(counts, ["frame_id", "term"], "left").join(total, "frame_id", "left").withColumn("caption_freq", F.coalesce("n", F.lit(0)) / F.greatest(F.coalesce("total", F.lit(0)), F.lit(1))).drop("n", "total")


def score_terms(evidence: DataFrame, terms: DataFrame, value: str = "score") -> DataFrame:
    """Term scores of a frame: 0.30 caption + 0.25 presence + 0.35 top quantile + 0.10 area, each min-max scaled over the frame's terms.

    ``evidence`` has a ``valid`` flag; ``terms`` is (frame_id, term, term_idx, presence, caption_freq).
    """
    v = F.col(value)
    seen = evidence.where("valid").groupBy("frame_id", "term").agg(F.percentile(v, F.lit(0.9)).alias("topp"), F.avg(F.when(v > 0.20, 1.0).otherwise(0.0)).alias("area"))
    rows = terms.join(seen, ["frame_id", "term"], "left").fillna(0.0, ["topp", "area"])
    w = Window.partitionBy("frame_id")
    unit = lambda c: (F.col(c) - F.min(c).over(w)) / F.greatest(F.max(c).over(w) - F.min(c).over(w), F.lit(EPS))
    score = 0.30 * unit("caption_freq") + 0.25 * unit("presence") + 0.35 * unit("topp") + 0.10 * unit("area")
    return rows.withColumn("score", score)


def verify_terms(scored: DataFrame, top_k: int = 8, least: float = 0.05) -> DataFrame:
    """Add ``rank`` and ``verified``: the first ``top_k`` terms by score with at least ``least``, ties to the smaller term_idx."""
    w = Window.partitionBy("frame_id").orderBy(F.col("score").desc(), "term_idx")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked.withColumn("verified", (F.col("score") >= least) & (F.col("rank") <= top_k))


def vocabulary_prf(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall (may exceed 1: hits count the expanded truth) and F1 of normalised term sets per frame."""
    norm = lambda df: df.select("frame_id", normalize_term(F.col("term")).alias("term")).where("term IS NOT NULL").distinct()
    pred, gt = norm(predicted), norm(truth)
    table = F.create_map(*[x for k, v in GT_EXPANSION.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    wide = gt.select("frame_id", F.explode(F.concat(F.array("term"), F.coalesce(table[F.col("term")], F.array().cast("array<string>")))).alias("term")).distinct()
    frames = predicted.select("frame_id").unionByName(truth.select("frame_id")).distinct()
    n = lambda df, name: df.groupBy("frame_id").agg(F.count(F.lit(1)).alias(name))
    out = frames.join(n(pred, "n_pred"), "frame_id", "left").join(n(gt, "n_gt"), "frame_id", "left").join(n(pred.join(wide, ["frame_id", "term"]), "tp"), "frame_id", "left").fillna(0)
    return out.withColumns(prf(F.col("tp"), F.col("n_pred"), F.col("n_gt")))


def prf(tp: Column, n_pred: Column, n_gt: Column) -> dict[str, Column]:
    """Precision, recall and F1 columns from counts."""
    p, r = tp / F.greatest(n_pred, F.lit(1)), tp / F.greatest(n_gt, F.lit(1))
    return {"precision": p, "recall": r, "f1": 2 * p * r / F.greatest(p + r, F.lit(1e-12))}


def nearest_label(items: DataFrame, labels: DataFrame, vector: str, threshold: float = 0.35) -> DataFrame:
    """(id, class_id, similarity): the label of highest cosine, ties to the smaller place; class 0 below ``threshold``.

    ``labels`` (place, class_id, v) is a class list: a few hundred rows.
    """
    from ..functions.numeric import cosine

    pairs = items.crossJoin(small(labels.select("place", "class_id", F.col("v").alias("label_v"))))
    scored = pairs.withColumn("similarity", cosine(F.col(vector), F.col("label_v")))
    best = scored.groupBy("id").agg(F.max_by(F.struct("class_id", "similarity"), F.struct("similarity", -F.col("place"))).alias("b"))
    return best.select("id", F.when(F.col("b.similarity") >= threshold, F.col("b.class_id")).otherwise(0).alias("class_id"), F.col("b.similarity").alias("similarity"))
