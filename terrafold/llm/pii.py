"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base spans (email, ip, card, phone) follow their exact rules and always stay. Further
candidates get votes (+1, -1 or 0) from five labelers, each with a source of its own:

* regex: the candidate's own form (character mix, check sum, equal separators, initials);
* gazetteers: lists of issuers' key heads, account lengths by country, area codes, given names and surnames (``_gazetteers``);
* cue words of the kind close before it ("token", "iban", "phone", "Mr"), or of harmless ones ("commit", "isbn", "order");
* context before (assignment, quotes, brackets against path, digits, articles);
* context after (closing quote, extension, e-mail against units, further capitals).

The corpus is read once; every candidate's votes and features go to a table. The counts of votes over *all*
candidates (3**5 patterns a kind at most) feed an expectation-maximisation of a two-class model with a
reliability per labeler. Its posteriors, summed by features (4**9 patterns a kind at most: length, shares of digits
and capitals, entropy, character classes on both sides, listed words, form and cue), train the span
classifier, a logistic model over feature levels whose verdict adds the span. Candidate kinds: ``secret``
(keys and tokens), ``iban``, ``local`` (phone numbers without a country code) and ``name``
(two capitalised words, an initial between them allowed, with a listed name among them or a cue before them).

Defined results: null text counts as empty; a text without matches has zero counts and
empty span strings; repeated rows repeat their results; other columns are not read.
Candidates of all kinds vote even where
they overlap; of accepted ones that do, the earlier start stays, of equal starts an IBAN
whose check sum holds, else the kind listed first. Added spans never overlap a base span
or each other. Offsets are code points.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import map_batches, map_texts
from ._gazetteers import GIVEN, IBAN_LENGTH, KEY_HEADS, NOT_NAMES, SURNAMES, TITLES, area_code
from ._store import stored

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "iban", "local", "name")
KINDS = BASE + ADDED
_EMAIL_SIDE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")

_SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}(?![A-Za-z0-9_/+-])", re.ASCII)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z-])")
_CAPITAL = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
_RUN = re.compile(rf"(?<!\w){_CAPITAL}\.?(?: (?:[A-Z]\.|{_CAPITAL}))+(?!\w)")
_PART = re.compile(r"\S+")
_CUE = {
    "secret": re.compile(r"(?:token|secret|passw|pwd|api|key|bearer|auth|credential)", re.IGNORECASE),
    "iban": re.compile(r"(?:iban|account|konto|compte|cuenta|bank)", re.IGNORECASE),
    "local": re.compile(r"(?:phone|tel|call|mobile|fax|cell)", re.IGNORECASE),
    "name": re.compile(r"\b(?:name|nom|nombre|contact|attn|regards|author|signed|by|from|dear|" + "|".join(sorted(TITLES)) + r")\b[.:,]? ?$", re.IGNORECASE),
}
_HARMLESS = {
    "secret": re.compile(r"(?:https?|www|href|src|sha256|md5|commit|uuid|isbn|doi|checksum|digest|build)", re.IGNORECASE),
    "iban": re.compile(r"(?:serial|model|part|order|sku|vin|invoice)", re.IGNORECASE),
    "local": re.compile(r"(?:isbn|issn|order|part|serial|model|ref|no\.|version|invoice)", re.IGNORECASE),
    "name": re.compile(r"\b(?:the|of|in|at|to|near|at the|of the|in the) $", re.IGNORECASE),
}
_BEFORE = {  # (speaks for, speaks against)
    "secret": (re.compile(r"""[=:]\s*["']?$"""), re.compile(r"""[/\\.]$""")),
    "iban": (re.compile(r"""[:=(]\s*$"""), re.compile(r"[A-Z0-9][ -]$")),
    "local": (re.compile(r"[(:]\s*$"), re.compile(r"[#$€£0-9][ -]?$")),
    "name": (re.compile(r"[,:(]\s*$"), re.compile(r"[A-Za-z] - $|[A-Z]{2,} $")),
}
_AFTER = {
    "secret": (re.compile(r"""["']"""), re.compile(r"[./=\\]\w")),
    "iban": (re.compile(r"[,;.)]?\s*(?:BIC|SWIFT|\))", re.IGNORECASE), re.compile(r"[-_/]")),
    "local": (re.compile(r"\s*(?:x|ext|extension)\.? ?[0-9]", re.IGNORECASE), re.compile(r"\s*(?:%|kg|km|mm|usd|eur|[0-9])", re.IGNORECASE)),
    "name": (re.compile(r"(?:,? (?:said|says|wrote|writes|born|Jr|Sr|PhD|MD)\b|,? ?[<(]?[\w.+-]+@)"), re.compile(r" (?:Inc|Ltd|GmbH|LLC|Corp|SA|AG|" + "|".join(sorted(NOT_NAMES)) + r")\b")),
}
LABELERS = 5
FEATURES = 9


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of base spans, by start, then kind as listed."""
    found = []
    end = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _EMAIL_SIDE:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            end = m.end()
            found.append((begin, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def _form(kind: str, s: str) -> int:
    """What the candidate's own characters say."""
    if kind == "secret":
        digits, letters = sum(c.isdigit() for c in s), sum(c.isalpha() for c in s)
        return 1 if digits >= 4 and letters >= 4 and _entropy(s) >= 3.0 else -1 if min(digits, letters) == 0 or _entropy(s) < 2.5 else 0
    if kind == "iban":
        return 1 if _iban_sum(s) else -1
    if kind == "local":
        gaps = [c for c in s if c in " .-"]
        return 1 if s[0] == "(" and ")" in s or len(gaps) == 2 and gaps[0] == gaps[1] else -1 if len(gaps) > 1 and gaps[0] != gaps[1] else 0
    return 1 if ". " in s else -1 if max(map(len, s.split())) > 12 else 0


def _listed_words(kind: str, s: str) -> int:
    """How many of a candidate's parts the kind's gazetteer lists; negative for parts on a list of others."""
    if kind == "secret":
        return 1 if s.startswith(KEY_HEADS) else 0
    if kind == "iban":
        return 1 if IBAN_LENGTH.get(s[:2]) == len(s.replace(" ", "")) else -1
    if kind == "local":
        return 1 if area_code("".join(c for c in s if c.isdigit())) else -1
    words = s.split()
    if any(w in NOT_NAMES for w in words):
        return -1
    return (words[0] in GIVEN) + (words[-1] in SURNAMES)


def _sides(pair: tuple[re.Pattern, re.Pattern], text: str, match: bool) -> int:
    found = [bool(p.match(text) if match else p.search(text)) for p in pair]
    return found[0] - found[1]


def _class(c: str) -> int:
    """0: none or white space, 1: quote or bracket, 2: assignment, 3: any other."""
    return 0 if not c or c.isspace() else 1 if c in "\"'`()[]<>{}" else 2 if c in "=:" else 3


def _votes(kind: str, text: str, start: int, end: int) -> tuple[list[int], list[int]]:
    """The labelers' votes on a candidate, and its features: measures of 0 to 3."""
    s, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 24]
    listed = _listed_words(kind, s)
    votes = [
        _form(kind, s),
        max(-1, min(1, listed)),
        bool(_CUE[kind].search(before)) - bool(_HARMLESS[kind].search(before)),
        _sides(_BEFORE[kind], before, False),
        _sides(_AFTER[kind], after, True),
    ]
    share = lambda n: min(3, 4 * n // len(s))
    features = [min(3, len(s) // 12), share(sum(c.isdigit() for c in s)), share(sum(c.isupper() for c in s)), min(3, int(_entropy(s))), _class(before[-1:]), _class(after[:1]), listed + 1, votes[0] + 1, votes[2] + 1]
    return votes, features


def _iban_sum(s: str) -> bool:
    s = s.replace(" ", "")
    try:
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    except ValueError:
        return False


def _names(text: str, run: re.Match) -> Iterator[tuple[int, int]]:
    """Pairs of a run of capitalised words (an initial may stand between) with a listed name, or a cue before them."""
    parts = [(run.start() + m.start(), run.start() + m.end()) for m in _PART.finditer(run[0])]
    i = 0
    while i + 1 < len(parts):
        first = text[parts[i][0] : parts[i][1]]
        j = i + 1
        if text[parts[j][1] - 1] == "." and j + 1 < len(parts):
            j += 1
        last = text[parts[j][0] : parts[j][1]]
        if not first.endswith(".") and not last.endswith(".") and first not in TITLES and (first in GIVEN or last in SURNAMES or _CUE["name"].search(text, max(0, parts[i][0] - 24), parts[i][0])):
            yield parts[i][0], parts[j][1]
            i = j
        i += 1


def candidates(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int, list[int], list[int]]]:
    """Candidates of the added kinds that overlap no base span; they may overlap each other until they are classified."""
    taken = sorted((s, e) for s, _, e in base)
    raw = [(m.start(), 0, "secret", m.end()) for m in _SECRET.finditer(text) if any(c.isdigit() for c in m[0])]
    raw += [(m.start(), 1, "iban", m.end()) for m in _IBAN.finditer(text)]
    raw += [(m.start(), 2, "local", m.end()) for m in _LOCAL_PHONE.finditer(text)]
    raw += [(a, 3, "name", b) for m in _RUN.finditer(text) for a, b in _names(text, m)]
    out, i = [], 0
    for s, _, kind, e in sorted(raw):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if not (i < len(taken) and taken[i][0] < e):
            out.append((s, kind, e, *_votes(kind, text, s, e)))
    return out


def _preferred(start: int, kind: str, end: int, votes: str) -> tuple[int, int, int]:
    """Order among accepted spans: the earlier start, then an IBAN whose check sum holds, then kinds as listed."""
    return start, -1 if kind == "iban" and votes.startswith("1") else KINDS.index(kind), end


def resolved(spans: list[tuple[int, str, int, str]]) -> list[tuple[int, str, int]]:
    """Of accepted (start, kind, end, votes), those that overlap no preferred one."""
    out, end = [], 0
    for s, k, e, _ in sorted(spans, key=lambda x: _preferred(*x)):
        if s >= end:
            out.append((s, k, e))
            end = e
    return out


_SPAN = "kind:string,start:int,end:int"
_ROWS = f"doc_id bigint, base array<struct<{_SPAN}>>, more array<struct<{_SPAN},votes:string,features:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        base, more = [], []
        for t in b.column("text").to_pylist():
            t = "" if t is None else t
            spans = base_spans(t)
            base.append([{"kind": k, "start": s, "end": e} for s, k, e in spans])
            more.append([{"kind": k, "start": s, "end": e, "votes": ",".join(map(str, v)), "features": ",".join(map(str, f))} for s, k, e, v, f in candidates(t, spans)])
        yield {"doc_id": b.column("doc_id"), "base": base, "more": more}


#: The share of personal candidates that a kind starts from, and may reach: what no labeler speaks for is not taken for personal.
_PRIOR = (0.02, 0.2)
#: What a labeler's reliability is held near, and by how many pseudo-votes a candidate.
_SURE, _HELD = 0.8, 1.0


def fit_labelers(patterns: list[tuple[str, str, int]], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Posterior of "personal" for every (kind, votes) pattern, from counts, by EM.

    A labeler that does not abstain is right with its reliability, which lies between 0.55 and 0.99 and is held near
    0.8 by as many pseudo-votes as there are candidates, so a vote against is never evidence for. Starts from the majority of votes, ties against.
    """
    out = {}
    for kind in sorted({k for k, _, _ in patterns}):
        own = [(v, n) for k, v, n in patterns if k == kind]
        votes = np.array([[int(x) for x in v.split(",")] for v, _ in own])
        n = np.array([c for _, c in own], dtype=float)
        q = 1 / (1 + np.exp(-(votes.sum(axis=1) - 0.5)))
        held = 10 + _HELD * n.sum()
        for _ in range(rounds):
            prior = np.clip((n * q).sum() / n.sum(), *_PRIOR)
            yes, no = (n * q) @ (votes == 1), (n * q) @ (votes == -1)
            yes_0, no_0 = (n * (1 - q)) @ (votes == 1), (n * (1 - q)) @ (votes == -1)
            right = np.clip((yes + no_0 + _SURE * held) / (yes + no + yes_0 + no_0 + held), 0.55, 0.99)
            odds = np.log(prior / (1 - prior)) + votes @ np.log(right / (1 - right))
            q = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        out |= {(kind, v): float(p) for (v, _), p in zip(own, q, strict=True)}
    return out


def fit_classifier(rows: list[tuple[str, str, float, int]], steps: int = 200) -> dict[tuple[str, str], bool]:
    """Verdict for every (kind, features) pattern, given its posterior's sum and its count: a logistic model per kind over feature levels."""
    out = {}
    for kind in sorted({k for k, _, _, _ in rows}):
        own = [(f, q, n) for k, f, q, n in rows if k == kind]
        levels = np.array([[int(v) for v in f.split(",")] for f, _, _ in own])
        x = np.concatenate([np.ones((len(own), 1)), *[(levels == v).astype(float) for v in range(4)]], axis=1)
        n = np.array([c for _, _, c in own], dtype=float)
        y = np.array([q for _, q, _ in own]) / n
        n /= n.sum()
        beta = np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            h = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-4 * np.eye(len(beta))
            move = np.linalg.solve(h, x.T @ (n * (y - p)) - 1e-4 * beta)
            beta += np.clip(move, -2, 2)
            if np.abs(move).max() < 1e-8:
                break
        out |= {(kind, f): bool(v @ beta > 0) for (f, _, _), v in zip(own, x, strict=True)}
    return out


def _accepted(scanned: DataFrame) -> list[str]:
    """The ``kind|features`` patterns that the fitted classifier accepts; at most 3**LABELERS and 4**FEATURES rows a kind come here."""
    spark = scanned.sparkSession
    counts, _ = stored(scanned.select(F.explode("more").alias("m")).groupBy("m.kind", "m.votes", "m.features").agg(F.count(F.lit(1)).alias("n")), "votes")
    votes = [tuple(r) for r in counts.groupBy("kind", "votes").agg(F.sum("n")).collect()]
    if not votes:
        return []
    posterior = fit_labelers(sorted(votes))
    learnt = spark.createDataFrame([(k, v, round(q, 9)) for (k, v), q in sorted(posterior.items())], "kind string, votes string, q double")
    # 3**LABELERS rows a kind at most
    rows = counts.join(F.broadcast(learnt), ["kind", "votes"]).groupBy("kind", "features").agg(F.round(F.sum(F.col("q") * F.col("n")), 4), F.sum("n")).collect()
    verdicts = fit_classifier(sorted(tuple(r) for r in rows))
    return [f"{k}|{f}" for (k, f), yes in sorted(verdicts.items()) if yes]


def _scanned(docs: DataFrame) -> DataFrame:
    return stored(map_batches(docs.select("doc_id", "text"), _scan, _ROWS), "spans")[0]


def find_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, more)``: the base spans and the added ones the classifier accepts."""
    scanned = _scanned(docs)
    accepted = _accepted(scanned)
    ok = F.array(*[F.lit(a) for a in accepted]) if accepted else F.array().cast("array<string>")
    more = F.filter("more", lambda m: F.array_contains(ok, F.concat_ws("|", m["kind"], m["features"])))
    summed = lambda m: (m["kind"] == "iban") & m["votes"].startswith("1")
    place = lambda m: F.when(summed(m), -1).otherwise(F.array_position(F.array(*[F.lit(k) for k in KINDS]), m["kind"]).cast("int") - 1)
    keyed = F.array_sort(F.transform(more, lambda m: F.struct(m["start"].alias("start"), place(m).alias("place"), m["end"].alias("end"), m["kind"].alias("kind"))))
    span = lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    # as in resolved(): a span that starts before the last kept one's end gives way
    free = lambda kept, m: (F.size(kept) == 0) | (m["start"] >= F.element_at(kept, F.greatest(F.size(kept), F.lit(1)))["end"])
    kept = F.aggregate(keyed, F.array().cast(f"array<struct<{_SPAN}>>"), lambda kept, m: F.when(free(kept, m), F.concat(kept, F.array(span(m)))).otherwise(kept))
    return scanned.withColumn("more", kept)


def base_counts(docs: DataFrame) -> DataFrame:
    """Counts of base spans alone, per document; nothing is fitted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            kinds = [[k for _, k, _ in base_spans(t or "")] for t in b.column("text").to_pylist()]
            yield {"doc_id": b.column("doc_id")} | {f"n_{k}": [x.count(k) for x in kinds] for k in BASE}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in BASE))


def _listed(spans) -> F.Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """Counts of base spans, the digest of their list, and the list of all spans, per document."""
    found = find_spans(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "more")).alias("spans"))


def masked(text: str | None, accepted: frozenset[str]) -> str | None:
    """``text`` with ``<KIND>`` for every span; overlapping spans share the first one's mask."""
    if text is None:
        return None
    base = base_spans(text)
    more = [(s, k, e, ",".join(map(str, v))) for s, k, e, v, f in candidates(text, base) if f"{k}|{','.join(map(str, f))}" in accepted]
    first = set(resolved(more))
    # what gives way to a preferred span is masked too, where it goes on beyond it
    spans = sorted([*((s, False, k, e) for s, k, e in base), *((s, (s, k, e) not in first, k, e) for s, k, e, _ in more)])
    out, at = [], 0
    for s, _, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind, and ``n_chars``, if there, counted anew."""
    accepted = frozenset(_accepted(_scanned(docs)))

    out = map_texts(docs, "text", lambda texts: [masked(t, accepted) for t in texts])
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
