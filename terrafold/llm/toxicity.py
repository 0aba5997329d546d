"""Toxic passages: maximum-scoring segments over token log-odds.

*Weights.* Entries are words and their prefixes (``PREFIXES`` code points, so inflected and
compound forms share their stem). Document counts of toxic and clean training texts, with an
informative Dirichlet prior (the pooled corpus) give every entry a log-odds. Of training texts
with one label and the same set of shingles (copies up to case, spacing and repeats) one counts,
and near copies within one label weigh together: a text counts 1/m where m texts of its label share
its least shingle hash, so a template that fills the sample is one voice. Entries whose likelihood ratio is beyond
what the most extreme of so many entries reaches by chance form the lexicon; a token weighs what
its strongest entry weighs, all others share the negative weight of the rest of the vocabulary.

*Segments.* A linear-time scan (Ruzzo and Tompa) over the whole text yields every maximal
scoring segment. Runs of ordinary tokens are one step, so the scan's cost follows the lexicon hits.
Each segment keeps a link to the nearest earlier one with a smaller left sum, so a search
skips all between, and every link is walked once.

*Calibration.* On clean training documents the best segment's score, less the logarithm
of the text's length, follows an extreme-value law; its location and scale
are fitted by moments. A document's evidence is the sum of its significant segments'
tail surprisals; a logistic link on that evidence, fitted on training labels, gives the score.

The lexicon is as large as the sample's vocabulary makes it. The fit uses at most about ``MOST_DOCS`` labelled documents (by hash of doc_id, so
the same ones in every run); scoring covers every whole text.

Defined results: null or wordless texts have no segments and get the score of no
evidence. Unlabelled and null-labelled rows do not train. A training set without both
classes, or without a telling entry, scores every text 0.0. Rows that repeat a ``doc_id`` are scored each. Labels,
lang, source and doc_id never enter a score; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import filter_texts, map_batches
from ._store import stored
from ._words import mix64
from .neardup import shingle_sets

MOST_DOCS = 40_000
PREFIXES = (4, 5, 6)
#: A lexicon entry's likelihood ratio exceeds 2 ln(entries) + MARGIN.
MARGIN = 6.0
PRIOR = 1000.0
_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def entries(token: str) -> list[str]:
    """A token and its prefixes, as lexicon entries."""
    return [token, *("^" + token[:n] for n in PREFIXES if len(token) >= n)]


def segments(weights: list[float], positions: list[int], n: int, rest: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first position, last position), left to right.

    ``weights`` at ``positions`` (ascending) of ``n`` tokens; every other token weighs ``rest`` < 0.
    """
    total, at = 0.0, -1
    out: list[tuple[float, int, int]] = []
    # the open segments: (sum before, sum after, first, last, place of the nearest one before with a smaller sum before)
    held: list[tuple[float, float, int, int, int]] = []
    for w, p in zip(weights, positions, strict=True):
        total += rest * (p - at - 1)
        at = p
        before, total = total, total + w
        if w <= 0:
            continue
        lo, begin = before, p
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][0] >= lo:
                j = held[j][4]
            if j < 0:
                # nothing later joins what came before
                out += [(x[1] - x[0], x[2], x[3]) for x in held]
                held = [(lo, total, begin, p, -1)]
                break
            if held[j][1] >= total:
                held.append((lo, total, begin, p, j))
                break
            lo, _, begin, _, back = held[j]
            del held[j:]
            j = back
    return out + [(x[1] - x[0], x[2], x[3]) for x in held]


class Model:
    """Lexicon, extreme-value law of clean documents, logistic link."""

    def __init__(self, lexicon: dict[str, float], rest: float) -> None:
        self.lexicon, self.rest = lexicon, rest
        self.heads = {e.lstrip("^")[: PREFIXES[0]] for e in lexicon}
        self.location, self.scale, self.link = 0.0, 1.0, (-30.0, 0.0)

    def found(self, text: str | None) -> tuple[list[tuple[float, int, int]], int]:
        words = tokens(text)
        heads, size = self.heads, PREFIXES[0]
        hits = [(w, i) for i, t in enumerate(words) if t[:size] in heads and (w := self.weight(t)) is not None]
        return segments([w for w, _ in hits], [i for _, i in hits], len(words), self.rest), len(words)

    def weight(self, token: str) -> float | None:
        """The weight of the entry of ``token`` that says most."""
        known = [w for e in entries(token) if (w := self.lexicon.get(e)) is not None]
        return max(known, key=abs) if known else None

    def surprisal(self, score: float, n: int) -> float:
        """-ln of the chance that a clean text of ``n`` tokens has a segment this good."""
        x = (score - np.log(max(n, 2)) - self.location) / self.scale
        tail = np.exp(-np.clip(x, -30, 700))
        return float(x if tail < 1e-9 else -np.log(-np.expm1(-tail)))

    def evidence(self, text: str | None) -> float:
        """Surprisal of the best segment plus that of each further one beyond chance."""
        found, n = self.found(text)
        s = sorted((self.surprisal(x, n) for x, _, _ in found), reverse=True)
        return sum(x for i, x in enumerate(s) if i == 0 or x > 3.0)

    def score(self, text: str | None) -> float:
        if not self.lexicon:
            return 0.0
        a, b = self.link
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(self.evidence(text)), -30, 30))))

    def passages(self, text: str | None, surprise: float = 3.0) -> list[dict]:
        """Significant passages: token positions (end exclusive) and surprisal."""
        found, n = self.found(text)
        return [{"first": a, "end": b + 1, "surprisal": x} for s, a, b in found if (x := self.surprisal(s, n)) >= surprise]


def _training(docs: DataFrame, labels: DataFrame, most_docs: int) -> DataFrame:
    """(toxic, text, family) of at most about ``most_docs`` labelled rows outside the held-out fifth."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    n = known.count()
    if n > most_docs:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most_docs / n))
    # most_docs rows of two numbers: broadcast below a fixed size
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


#: Least shingle hashes that make a family: 0.9 alike texts share all with a chance of 0.7, texts with 0.4 with one of 0.06.
_FAMILY = 3


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        sets = shingle_sets(b.column("text").to_pylist())
        yield {"doc_id": b.column("doc_id"), "toxic": b.column("toxic"), "text": b.column("text"), "family": [int(mix64(s[:_FAMILY]).sum()) >> 1 if len(s) else -1 for s in sets]}


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    seen = (Counter(), Counter())

    def flush() -> Iterator[dict]:
        for toxic in (0, 1):
            items = list(seen[toxic].items())
            seen[toxic].clear()
            for lo in range(0, len(items), 50_000):
                part = items[lo : lo + 50_000]
                yield {"token": [t for t, _ in part], "toxic": [toxic] * len(part), "n": [n for _, n in part]}

    for b in batches:
        for t, toxic, weight in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "weight")), strict=True):
            own = seen[int(toxic)]
            for e in {e for w in set(tokens(t)) for e in entries(w)}:
                own[e] += weight
            if len(seen[0]) + len(seen[1]) > 250_000:
                yield from flush()
    yield from flush()


def fit(docs: DataFrame, labels: DataFrame, most_docs: int = MOST_DOCS) -> Model:
    rows, _ = stored(map_batches(_training(docs, labels, most_docs), _families, "doc_id bigint, toxic int, text string, family bigint"), "labelled")
    # at most a row for each of about most_docs texts
    weights = rows.groupBy("family", "toxic").agg((1 / F.count(F.lit(1))).alias("weight"))
    train = rows.join(F.broadcast(weights), ["family", "toxic"]).select("doc_id", "toxic", "text", "weight")
    by = lambda toxic: F.sum(F.when(F.col("toxic") == toxic, F.col("n")).otherwise(0.0))
    # rounded, so that the order of sums does not show
    counts = map_batches(train, _counts, "token string, toxic int, n double").groupBy("token").agg(F.round(by(1), 6).alias("t"), F.round(by(0), 6).alias("c"))
    counts, _ = stored(counts, "tokens")
    nt, nc, v = counts.agg(F.round(F.sum("t"), 3), F.round(F.sum("c"), 3), F.count(F.lit(1))).first()
    if not nt or not nc:
        return Model({}, -0.1)
    prior = (F.col("t") + F.col("c")) * (PRIOR / (nt + nc))
    a, b = F.col("t") + prior, F.col("c") + prior
    odds = F.log(a / (nt + PRIOR - a)) - F.log(b / (nc + PRIOR - b))
    share = F.lit(nt / (nt + nc))
    both = F.col("t") + F.col("c")
    term = lambda n, p: F.when(n > 0, n * F.log(n / (both * p))).otherwise(0.0)
    scored = counts.withColumn("w", odds).withColumn("g", 2 * (term(F.col("t"), share) + term(F.col("c"), 1 - share)))
    # a bounded sample has a bounded vocabulary; its telling entries come here
    lexicon = scored.where(F.col("g") > 2 * float(np.log(v)) + MARGIN).orderBy(F.col("g").desc(), "token").collect()
    rt, rc = nt - sum(r["t"] for r in lexicon), nc - sum(r["c"] for r in lexicon)
    model = Model({r["token"]: r["w"] for r in lexicon}, min(-0.02, float(np.log((rt + 1) / (nt + 1)) - np.log((rc + 1) / (nc + 1)))))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            found = [model.found(t) for t in b.column("text").to_pylist()]
            yield {"doc_id": b.column("doc_id"), "toxic": b.column("toxic"), "weight": b.column("weight"), "scores": [[s for s, _, _ in f] for f, _ in found], "n": [n for _, n in found]}

    sample = sorted(map_batches(train, best, "doc_id bigint, toxic int, weight double, scores array<double>, n bigint").collect())
    clean = np.array([max(r["scores"], default=0.0) - np.log(max(r["n"], 2)) for r in sample if r["toxic"] == 0])
    # moments of the extreme-value law; the scale has a floor where clean texts have no segments at all
    model.scale = max(0.25, float(clean.std() * np.sqrt(6) / np.pi))
    model.location = float(clean.mean() - 0.5772156649 * model.scale)

    def evidence(r) -> float:
        s = sorted((model.surprisal(x, r["n"]) for x in r["scores"]), reverse=True)
        return sum(x for i, x in enumerate(s) if i == 0 or x > 3.0)

    x = np.log1p(np.array([evidence(r) for r in sample]))
    model.link = _logistic(x, np.array([float(r["toxic"]) for r in sample]))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not negative) by Newton's method with a small ridge."""
    design = np.stack([np.ones_like(x), x], axis=1)
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        h = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-2 * np.eye(2)
        move = np.linalg.solve(h, design.T @ (y - p) - 1e-2 * beta)
        beta += np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-9:
            break
    return float(beta[0]), max(0.0, float(beta[1]))


def score_documents(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``; a null doc_id is not held out."""
    model = model or fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b.column("doc_id"), "score": [model.score(t) for t in b.column("text").to_pylist()]}

    out = map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, all columns as they are."""
    model = fit(docs, labels)
    return filter_texts(docs, "text", lambda texts: [model.score(t) < 0.5 for t in texts])
