"""Document fingerprints by winnowing, in DataFrame functions only.

A text is lower-cased (A-Z) and cut into *units*: each CJK character alone, every
other run of non-space characters in pieces of at most four, counted from the start
of the run. In long runs units roll: a code point with ``REACH`` others of its run
before it or behind it starts a unit of the four code points from it on. Every ``k``
consecutive units are hashed (rolling: pairs, then fours, from the hashes of single
units); every window of ``w`` consecutive k-gram hashes
gives its minimum, of equal minima the rightmost, with its position. Consecutive
windows mostly share their minimum, so about 2/(w+1) of the positions are kept.

Match guarantee: two texts that share a run of at least ``w + k - 1`` units share a
kept hash, and the kept positions say where. A passage starts on a unit boundary
wherever a word starts, and at any offset in text without spaces: of a run that
two texts share in part, any ``2 * REACH`` code points give the same units in both.

Defined results: null text counts as empty; an empty text, or one without units, has
no kept hashes; fewer than ``k`` units are one gram of all of them; fewer than ``w``
grams are one window. Two empty fingerprints are alike (1.0), an empty and a full one
are not (0.0). Ties between equal documents keep the order of ``doc_id``, then text.
Columns other than the named ones are ignored and may have any names. Documents
whose ``doc_id`` is null come first, by text, and the first of the other documents
follows the last one.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ALONE = "぀-ヿ㐀-䶿一-鿿가-힯"
#: A code point of a run: neither white space nor alone. As ranges, the commonest first, for Java tries a negated class range by range at each code point.
_RUN = "[!-\u303F\u3100-\u33FF\u4DC0-\u4DFF\uA000-\uABFF\uD7B0-\U0010FFFF\\x00-\\x08\\x0E-\\x1F]"
#: A code point with so many of its run before or behind it starts a unit of its own.
REACH = 16
#: Group 1 is the unit, the match how far to go. The last branch never matches; it makes Java's look-behind count code points.
UNIT = rf"(?=([{_ALONE}]|{_RUN}{{1,4}}))(?:[{_ALONE}]|{_RUN}(?:(?={_RUN}{{{REACH}}})|(?<={_RUN}{{{REACH + 1}}}))|{_RUN}{{1,4}}|\U0010FFFF)".replace(r"\U0010FFFF", "\U0010FFFF")
#: Runs of more than REACH code points whole (over 16 bytes, as no other piece is), the units of all else.
_PIECE = rf"{_RUN}{{1,4}}+(?:{_RUN}{{{REACH - 3},}}+)?|[{_ALONE}]"
K, W = 5, 8
_POSITION_BITS = 31
_POSITION_MASK = (1 << _POSITION_BITS) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _pairwise(a: Column, ahead: int, f) -> Column:
    """f(a[i], a[i + ahead]) for every i that has both."""
    n = F.greatest(F.size(a) - ahead, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + ahead), n), f)


def _spread(have: int, want: int) -> list[int]:
    """Steps that widen a span of ``have`` entries to ``want`` by joining overlapping spans."""
    steps = []
    while have < want:
        steps.append(min(have, want - have))
        have += steps[-1]
    return steps


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """Add ``out``: array<bigint> of kept entries ``hash << 31 | (2**31 - 1 - position)``, in order of the text."""
    units = f"{out}__units"
    steps = [(units, F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), F.lit(_PIECE), F.lit(0)))]
    # a piece's own units are those of the text: UNIT never looks beyond a run
    long = lambda p: F.octet_length(p) > 16
    rolled = F.flatten(F.transform(F.col(units), lambda p: F.when(long(p), F.regexp_extract_all(p, F.lit(UNIT), F.lit(1))).otherwise(F.array(p))))
    steps.append((units, F.when(F.exists(F.col(units), long), rolled).otherwise(F.col(units))))
    steps.append((f"{out}__grams", F.transform(F.col(f"{out}__units"), lambda u: F.xxhash64(u))))
    drop = [f"{out}__units", f"{out}__grams"]
    short = F.size(f"{out}__units") < k
    whole = F.array(F.xxhash64(F.array_join(f"{out}__units", " ")))
    for ahead in _spread(1, k):
        steps.append((f"{out}__grams", _pairwise(F.col(f"{out}__grams"), ahead, lambda x, y: F.xxhash64(x, y))))
    tagged = F.transform(
        F.when(short, F.when(F.size(f"{out}__units") > 0, whole).otherwise(F.array().cast("array<bigint>"))).otherwise(F.col(f"{out}__grams")),
        lambda h, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(h), 32), _POSITION_BITS) + (F.lit(_POSITION_MASK) - i),
    )
    steps.append((f"{out}__grams", tagged))
    for name, value in steps:
        df = df.withColumn(name, value)
    few = F.size(f"{out}__grams") < w
    least = F.col(f"{out}__grams")
    df = df.withColumn(f"{out}__least", least)
    for ahead in _spread(1, w):
        df = df.withColumn(f"{out}__least", _pairwise(F.col(f"{out}__least"), ahead, lambda x, y: F.least(x, y)))
    kept = F.when(few, F.when(F.size(f"{out}__grams") > 0, F.array(F.array_min(f"{out}__grams"))).otherwise(F.array().cast("array<bigint>"))).otherwise(F.array_distinct(f"{out}__least"))
    return df.withColumn(out, kept).drop(*drop, f"{out}__least")


def hashes(kept: Column) -> Column:
    """The distinct hashes of kept entries, without positions."""
    return F.array_distinct(F.transform(kept, lambda v: F.shiftrightunsigned(v, _POSITION_BITS)))


def positions(kept: Column) -> Column:
    """The unit positions of kept entries."""
    return F.transform(kept, lambda v: (F.lit(_POSITION_MASK) - v.bitwiseAND(F.lit(_POSITION_MASK))).cast("int"))


def digest(kept: Column) -> Column:
    """One string for a fingerprint: the SHA-256 of its entries in order of the text."""
    return F.sha2(F.array_join(F.transform(kept, lambda v: v.cast("string")), ","), 256)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1.0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def _constants(values: list, kind: str) -> Column:
    """One constant array of numbers: a literal for each would be a call to the JVM and a node of the plan apiece."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def with_next(docs: DataFrame, carry: tuple[str, ...] = ("text",), rows_per_group: int = 512, most_groups: int = 65536) -> DataFrame:
    """Add ``next_<column>`` of the next document by ``doc_id`` (after the last: the first) for every column of ``carry``.

    ``doc_id`` is cut into ranges at approximate quantiles (at most ``most_groups``
    numbers on the driver), each range is one window group, and the first document of a range
    also stands, marked, at the end of the range before. Texts move in one shuffle.
    """
    docs = docs.select("doc_id", *carry)
    n, low = docs.agg(F.count("doc_id"), F.min("doc_id")).first()
    groups = max(1, min(most_groups, n // rows_per_group))
    bounds = [low]
    if groups > 1:
        at = _constants([i / groups for i in range(1, groups)], "double")
        found = docs.agg(F.percentile_approx("doc_id", at, min(10_000_000, 20 * groups))).first()[0]
        bounds = sorted({low, *found})
    if n == 0:
        bounds = [0]
    width = ceil(sqrt(len(bounds)))
    top, every = _constants(bounds[::width], "bigint"), _constants(bounds, "bigint")
    own = lambda part: F.slice(every, (part - 1) * width + 1, F.lit(width))
    docs = docs.withColumn("top_range", F.greatest(F.size(F.filter(top, lambda b: b <= F.col("doc_id"))), F.lit(1)))
    docs = docs.withColumn("own_range", (F.col("top_range") - 1) * width + F.greatest(F.size(F.filter(own(F.col("top_range")), lambda b: b <= F.col("doc_id"))), F.lit(1)))
    docs = docs.withColumn("own_range", F.when(F.col("doc_id").isNull(), 1).otherwise(F.col("own_range"))).drop("top_range")
    starts = F.array_contains(own(F.ceil(F.col("own_range") / width).cast("int")), F.col("doc_id"))
    before = F.when(F.col("own_range") == 1, len(bounds)).otherwise(F.col("own_range") - 1)
    copies = F.when(starts, F.array(F.struct(F.col("own_range").alias("r"), F.lit(False).alias("mark")), F.struct(before.alias("r"), F.lit(True).alias("mark")))).otherwise(F.array(F.struct(F.col("own_range").alias("r"), F.lit(False).alias("mark"))))
    rows = docs.select("doc_id", *carry, F.explode(copies).alias("c")).select("doc_id", *carry, "c.r", "c.mark")
    order = Window.partitionBy("r").orderBy("mark", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in carry}).where("not mark").drop("r", "mark")


def _edited(df: DataFrame) -> DataFrame:
    """Add n_chars and ``edited``: the text whose last half is replaced by as many code points (or all) from the start of ``next_text``."""
    df = df.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("next_text", F.coalesce("next_text", F.lit("")))
    df = df.withColumn("n_chars", F.char_length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    return df.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))


def edited_texts(docs: DataFrame) -> DataFrame:
    """Every text with its length and its edited text."""
    return _edited(with_next(docs.select("doc_id", "text")))


def fingerprint_pairs(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Every text's fingerprint ``kept``, its edited text's ``edited_kept`` and the next document's ``next_kept``.

    A text is fingerprinted once and its entries travel with it to the document before.
    """
    df = with_next(with_fingerprint(docs.select("doc_id", "text"), "text", "kept", k, w), ("text", "kept"))
    return with_fingerprint(_edited(df), "edited", "edited_kept", k, w)
