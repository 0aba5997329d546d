"""Caption and vocabulary expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import CANONICAL, CLEAN_STOP, PLURALS, RULE_ALIASES, STOP, SYNONYMS


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _squeezed(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"\s+", " "))


def simple_clean(c: Column) -> Column:
    """Lower case, ``_`` and ``-`` to spaces, single spaces."""
    return _squeezed(F.regexp_replace(F.lower(c), "[_-]", " "))


def _kept(c: Column, bad: str) -> Column:
    """Runs of ``bad`` characters and of spaces as one space, where all white space but the space is bad: most words are parted by one
    space already and need no replacement."""
    return F.regexp_replace(F.regexp_replace(c, f"{bad}+", " "), " {2,}", " ")


def clean_text(c: Column) -> Column:
    """As ``simple_clean``, keeping only ``a-z0-9 /,;``."""
    return F.btrim(_kept(F.lower(F.btrim(c)), "[^a-z0-9 /,;]"))


def _stages(items: Column, *steps) -> Column:
    """Array elements through ``steps``. What a step binds is computed once an element, however often the next one names it."""
    for step in steps:
        items = F.transform(items, step)
    return items


def _single(value: Column, *steps) -> Column:
    return _stages(F.array(value), *steps)[0]


def _with_last(term: Column) -> Column:
    return F.struct(term.alias("term"), F.substring_index(term, " ", -1).alias("last"))


def _singular(s: Column) -> Column:
    term, last = s["term"], s["last"]
    n = F.length(last)
    return (
        F.when(last.endswith("ies") & (n > 4), F.concat(F.substring(term, F.lit(1), F.length(term) - 3), F.lit("y")))
        .when(last.endswith("s") & ~last.endswith("ss") & (n > 3), F.substring(term, F.lit(1), F.length(term) - 1))
        .otherwise(term)
    )


def singular(term: Column) -> Column:
    """The last word's plural ending dropped: -ies to -y beyond four letters, -s unless -ss beyond three."""
    return _single(term, _with_last, _singular)


def _open_steps() -> list:
    return [lambda c: F.btrim(_kept(F.lower(c), "[^a-z0-9 -]"), F.lit(" -")), _with_last, _singular, lambda t: F.when(t.isin(*CLEAN_STOP), "").otherwise(t)]


def clean_open_term(c: Column) -> Column:
    """An open-vocabulary term in normal form; stop terms become the empty string."""
    return _single(c, *_open_steps())


def _normal_steps(keep_roof: bool) -> list:
    def usable(s: Column) -> Column:
        clean, mapped = s["clean"], s["mapped"]
        return F.when((clean == "") | clean.isin(*STOP) | mapped.isin(*STOP) | (F.length(mapped) < 3), None).otherwise(mapped)

    named = lambda clean, mapped: F.struct(clean.alias("clean"), mapped.alias("mapped"))
    steps = [clean_text, lambda c: named(c, F.coalesce(_map(PLURALS)[c], c)), lambda s: named(s["clean"], F.coalesce(_map(SYNONYMS)[s["mapped"]], s["mapped"]))]
    if not keep_roof:
        steps.append(lambda s: named(s["clean"], F.when(s["mapped"] == "roof", "building").otherwise(s["mapped"])))
    return [*steps, usable]


def normalize_term(c: Column, keep_roof: bool = False) -> Column:
    """A remote-sensing term through the plural and synonym tables; null if nothing usable is left."""
    return _single(c, *_normal_steps(keep_roof))


def phrase_parts(caption: Column) -> Column:
    """Clean phrase candidates of a caption, in order: array<string>, empty ones included as ''."""
    head = F.regexp_replace(F.lower(caption), r"^[\s\-*\d.)]+", "")
    parts = F.split(head, r"[,;/\n]|\band\b|\bwith\b|\bplus\b")
    bare = F.transform(parts, lambda p: F.regexp_replace(p, r"\b(a|an|the|some|several|multiple|visible)\b", " "))
    return _stages(bare, *_open_steps())


def phrase_candidates(caption: Column, max_words: int = 5) -> Column:
    """The candidates of 1 to ``max_words`` words, in order, repeats kept."""
    return F.filter(phrase_parts(caption), lambda t: (t != "") & (F.size(F.split(t, " ")) <= max_words))


def rs_candidates(caption: Column) -> Column:
    """Remote-sensing candidates: canonical terms found, split parts of 2 to 4 words, greedy chunks of 1 to 3 words."""
    words = lambda t: F.size(F.split(t, " +"))
    listed = lambda items, low, high: F.filter(F.transform(items, lambda t: F.btrim(t)), lambda t: (t != "") & words(t).between(low, high))

    def found(clean: Column) -> Column:
        canonical = F.filter(F.array(*[F.when(clean.rlike(rf"\b{t}s?\b"), F.lit(t)) for t in CANONICAL]), lambda t: t.isNotNull())
        return F.concat(canonical, listed(F.split(clean, r"[,;/\n]| and | with | plus "), 2, 4), listed(F.regexp_extract_all(clean, F.lit(r"[a-z][a-z ]{2,32}"), F.lit(0)), 1, 3))

    return _single(caption, clean_text, found)


def rs_tags(caption: Column, keep_roof: bool = False, allow_open: bool = True) -> Column:
    """Normalised candidates of one caption, each once, in order of first appearance."""
    tags = F.filter(_stages(F.array_distinct(rs_candidates(caption)), *_normal_steps(keep_roof)), lambda t: t.isNotNull())
    if not allow_open:
        tags = F.filter(tags, lambda t: t.isin(*CANONICAL))
    return F.array_distinct(tags)


def prompts_for(term: Column) -> Column:
    """A term, every synonym that maps to it and the extra prompts of its family, each once."""
    norm = F.coalesce(normalize_term(term, keep_roof=True), clean_text(term))
    by_target: dict[str, list[str]] = {}
    for raw, mapped in SYNONYMS.items():
        by_target.setdefault(mapped, []).append(raw)
    extra = {"building": ["building", "roof", "house"], "vehicle": ["vehicle", "car", "truck"], "road": ["road", "asphalt road", "street", "pavement"]}
    known = {k: by_target.get(k, []) + extra.get(k, []) for k in {**by_target, **extra}}
    table = F.create_map(*[x for k, v in sorted(known.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.concat(F.array(norm), F.coalesce(table[norm], F.array().cast("array<string>"))))


def rule_class(term: Column) -> Column:
    """The first class whose aliases hold the normalised term, else 0."""
    clean = clean_open_term(term)
    name = F.when(clean != "", clean).otherwise(F.lower(F.btrim(term)))
    first: dict[str, int] = {}
    for k, aliases in RULE_ALIASES.items():
        for a in aliases:
            first.setdefault(a, k)
    table = F.create_map(*[x for a, k in first.items() for x in (F.lit(a), F.lit(k))])
    return F.coalesce(table[name], F.lit(0))


def answer_class(text: Column, allowed: list[int]) -> Column:
    """The first allowed id that stands alone in a model's answer, else 0."""
    ids = "|".join(map(str, sorted(allowed, reverse=True)))
    return F.coalesce(F.regexp_extract(text, rf"\b({ids})\b", 1).try_cast("int"), F.lit(0))


def frame_key(path: Column) -> Column:
    """``scene:frame``: the first part that starts with ``interval`` and is no camera folder, else the parent; the last digits of the stem, else the stem."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    scenes = F.filter(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.startswith("interval") & ~p.contains("CAM"))
    scene = F.coalesce(F.try_element_at(scenes, F.lit(1)), F.try_element_at(parts, F.lit(-2)), F.lit(""))
    digits = F.regexp_extract_all(stem, F.lit(r"(\d+)"), F.lit(1))
    return F.concat_ws(":", scene, F.coalesce(F.try_element_at(digits, F.lit(-1)), stem))
