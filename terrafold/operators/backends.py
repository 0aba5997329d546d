"""Where trained networks plug in, and the deterministic fallbacks that stand in for them.

A backend is any object with the method its protocol names; it is sent to the workers once per task. Weights are not part of
this engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import MOST_ROWS


class Captioner(Protocol):
    def captions(self, paths: list[str]) -> list[str]: ...


class Encoder(Protocol):
    def encode(self, items: list[str]) -> list[list[float]]: ...


class TermMapper(Protocol):
    def classes(self, terms: list[str]) -> list[int]: ...


class Evidence(Protocol):
    def scores(self, path: str, prompts: list[str]) -> list: ...


#: Evidence backends by name: a function that gives an ``Evidence`` from its options.
BUILDERS: dict[str, Callable[..., Evidence]] = {}


def build_evidence(name: str, **options) -> Evidence | None:
    """The named evidence backend; ``color`` has none, as ``color_evidence`` stands in for it; unknown names are an error."""
    if name == "color":
        return None
    if name not in BUILDERS:
        raise ValueError(f"unknown evidence backend: {name}")
    return BUILDERS[name](**options)


def map_evidence(images: DataFrame, prompts: DataFrame, backend: Evidence) -> DataFrame:
    """(frame_id, term, prompt, row, col, semantic): the backend's maps of every prompt; an image's maps are one task's.

    ``prompts`` (term, prompt) is a vocabulary and goes to the workers.
    """
    asked = [tuple(r) for r in prompts.select("term", "prompt").distinct().orderBy("term", "prompt").limit(MOST_ROWS + 1).collect()]
    if len(asked) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} prompts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for frame, path in b.itertuples(index=False, name=None):
                for (term, prompt), m in zip(asked, backend.scores(path, [p for _, p in asked]), strict=True):
                    m = np.asarray(m, dtype=float)
                    row, col = np.indices(m.shape)
                    yield pd.DataFrame({"frame_id": frame, "term": term, "prompt": prompt, "row": row.ravel(), "col": col.ravel(), "semantic": m.ravel()})

    return images.select("frame_id", "path").mapInPandas(run, "frame_id string, term string, prompt string, row int, col int, semantic double")


def caption_images(images: DataFrame, backend: Captioner | None, pixels: DataFrame | None = None, mode: str = "auto") -> DataFrame:
    """(frame_id, text). Mode ``model`` fails without a backend, ``heuristic`` never uses one, ``auto`` uses it if there."""
    if mode == "model" and backend is None:
        raise RuntimeError("no captioner is configured")
    if backend is not None and mode != "heuristic":

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"frame_id": b["frame_id"], "text": backend.captions(b["path"].tolist())})

        return images.select("frame_id", "path").mapInPandas(run, "frame_id string, text string")
    return heuristic_captions(images, pixels)


def heuristic_captions(images: DataFrame, pixels: DataFrame) -> DataFrame:
    """Tag lists from colour shares of ``pixels`` (frame_id, r, g, b in 0..1) and words in the file name."""
    r, g, b = (F.col(c) for c in "rgb")
    bright, spread = (r + g + b) / 3, F.greatest(r, g, b) - F.least(r, g, b)
    share = lambda c: F.avg(c.cast("double"))
    s = pixels.groupBy("frame_id").agg(share(g > r * 1.08).alias("green"), share(b > g * 1.10).alias("blue"), share((bright > 0.45) & (spread < 0.13)).alias("gray"))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    tags = lambda cond, *t: F.when(cond, F.array(*map(F.lit, t))).otherwise(F.array().cast("array<string>"))
    # Thresholds and tags.
    every = F.concat(
        F.array(*map(F.lit, ("building", "road", "tree", "vegetation"))),
        tags(F.col("green") > 0.18, "grass", "farmland"),
        tags(F.col("blue") > 0.10, "water"),
        tags(F.col("gray") > 0.16, "roof", "parking lot"),
        tags(name.rlike("airport|runway"), "runway"),
        tags(name.rlike("harbor|ship"), "harbor", "ship"),
        tags(name.rlike("valley|field|farm"), "terrain", "farmland", "bare ground"),
    )
    return images.join(s, "frame_id").select("frame_id", F.array_join(F.array_distinct(every), ", ").alias("text"))


def color_prior(term: Column, r: Column, g: Column, b: Column) -> Column:
    """A term's score at a pixel from colour alone, 0..1."""
    bright = (r + g + b) / 3
    gray = 1 - F.sqrt(((r - bright) * (r - bright) + (g - bright) * (g - bright) + (b - bright) * (b - bright)) / 2)
    up = lambda c: F.greatest(c, F.lit(0.0))
    green, blue, brown = up(g - 0.5 * (r + b)), up(b - 0.5 * (r + g)), up(0.55 * r + 0.35 * g - 0.45 * b)
    name = F.lower(term)
    # Keywords and weights.
    score = (
        F.when(name.rlike("tree|vegetation|grass|farm"), 1.4 * green + 0.2 * bright)
        .when(name.rlike("water|harbor|ship"), 1.2 * blue + 0.15 * (1 - bright))
        .when(name.rlike("road|parking|runway"), 0.9 * gray + 0.35 * bright - 0.25 * green)
        .when(name.rlike("building|roof|wall|fence"), 0.7 * gray + 0.35 * bright)
        .when(name.rlike("bare|terrain"), 0.9 * brown + 0.2 * bright)
        .otherwise(bright)
    )
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def color_evidence(pixels: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fallback evidence: (score map, presence); presence is the 95th percentile of a term's map."""
    rows = pixels.crossJoin(F.broadcast(terms)).withColumn("score", color_prior(F.col("term"), F.col("r"), F.col("g"), F.col("b")))
    presence = rows.groupBy("frame_id", "term", "term_idx").agg(F.percentile("score", F.lit(0.95)).alias("presence"))
    return rows.select("frame_id", "term", "term_idx", "row", "col", "score"), presence


def encode(items: DataFrame, column: str, backend: Encoder) -> DataFrame:
    """Add ``v``: the backend's vectors of a text or path column, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(v=backend.encode(b[column].tolist()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return items.mapInPandas(run, f"{fields}, v array<double>")


def prompt_mean(vectors: DataFrame) -> DataFrame:
    """(term, v): the normalised mean of a term's normalised prompt vectors."""
    from ..functions.numeric import dot

    unit = vectors.withColumn("v", F.transform("v", lambda x: x / F.greatest(F.sqrt(dot(F.col("v"), F.col("v"))), F.lit(1e-12))))
    parts = unit.select("term", F.posexplode("v").alias("i", "x")).groupBy("term", "i").agg(F.avg("x").alias("x"))
    mean = parts.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return mean.select("term", F.transform("v", lambda x: x / F.greatest(F.sqrt(dot(F.col("v"), F.col("v"))), F.lit(1e-12))).alias("v"))


def map_terms(terms: DataFrame, backend: TermMapper, known: DataFrame | None = None) -> DataFrame:
    """(term, class_id): known terms from the table, only new ones from the backend."""
    new = terms.select("term").distinct()
    if known is not None:
        new = new.join(known, "term", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"term": b["term"], "class_id": backend.classes(b["term"].tolist())})

    out = new.mapInPandas(run, "term string, class_id int")
    return out if known is None else out.unionByName(known.select("term", "class_id").join(terms.select("term").distinct(), "term", "left_semi"))
