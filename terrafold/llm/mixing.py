"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. Every source's documents stand in a keyed random order on a line of its
``source_size`` words, cut in blocks of ``block_words``; a document belongs to the block in which it
starts. A target of T words takes ``T // source_size`` whole passes and a part of a last one.

A tree splits two exact block quotas of each source among ``shards``: all blocks of the whole passes, and
the quota of the last pass. A node with a quota vector and a number of shards hands its left half a
draw from the multivariate hypergeometric law, and with each quota its share of the source's
pool of blocks, down to single shards. Shard j so owns a range of each source's keyed block permutation and
draws its quota from that range: blocks are disjoint, and the tree decides which of them the
last pass takes. The last pass goes through the drawn blocks shard by shard (then through the ones left)
until the target is met to the word, so at most one document of a source is cut. Copies are shuffled
within their shard by a keyed hash.

Shards follow from the words of the mix (``SHARD_WORDS`` each); blocks grow where there would be more than
``MOST_BLOCKS``, which numpy's hypergeometric draws still take. The source table and the tree's numbers
(sources x shards) are on the driver and in a broadcast of ``MOST_CELLS`` numbers at most: shards grow beyond that,
and each is written by several tasks. The weights of a mix are its configuration: ``MOST_SOURCES`` at most.

Defined results: null text has size 0; documents of size 0 take nothing; a null source is
a source, last in order; sources without words have target 0; with no words at all, all
targets are 0; rows that repeat a doc_id are documents of their own, and each equal row takes its own
copies. Other columns of any name go through ``mix_documents`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import map_batches, whole
from ._store import stored
from .permute import feistel

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_TIMES = 3
MOST_SOURCES = 100_000
BLOCK_WORDS, SHARD_WORDS, SEED = 20_000, 2_000_000, 7
MOST_BLOCKS, MOST_CELLS, MOST_TASKS = 200_000_000, 4_000_000, 100_000
#: Documents of one source that one window group orders.
_GROUP = 4096


def targets(sizes: list[int], weights: list[float], total: float | None = None, most_times: float = MOST_TIMES) -> list[float]:
    """Shares of ``total`` by weight; none above ``most_times`` its size, the excess reshared by weight."""
    total = float(sum(sizes) if total is None else total)
    out = [0.0] * len(sizes)
    free = {i for i, s in enumerate(sizes) if s > 0}
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / weight > most_times * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most_times * sizes[i])
            left -= out[i]
        free -= over
    return out


def split_quotas(quotas: np.ndarray, pools: np.ndarray, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shards, sources) numbers of drawn blocks and of blocks to draw from.

    Exact column sums for both, row sums of the quotas as even as can be, and no quota above its pool.
    """
    drawn, pool = (np.zeros((shards, len(quotas)), dtype=np.int64) for _ in range(2))
    todo = [(np.asarray(quotas, dtype=np.int64), np.asarray(pools, dtype=np.int64), 0, shards)]
    while todo:
        have, room, lo, hi = todo.pop()
        if hi - lo == 1:
            drawn[lo], pool[lo] = have, room
            continue
        mid = (lo + hi) // 2
        take = int(have.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, take, method="marginals") if take else np.zeros_like(have)
        # what is left undrawn follows the drawn blocks, or the shards where there are none
        share = np.where(have > 0, left / np.maximum(have, 1), (mid - lo) / (hi - lo))
        spare = np.minimum(np.floor((room - have) * share).astype(np.int64), room - have)
        todo += [(left, left + spare, lo, mid), (have - left, room - left - spare, mid, hi)]
    return drawn, pool


class Draw:
    """Which shard draws each block of a source, and in what order the last pass takes them."""

    def __init__(self, blocks: np.ndarray, passes: np.ndarray, last: np.ndarray, shards: int, seed: int) -> None:
        self.blocks, self.seed = blocks, seed
        n = len(blocks)
        drawn, pool = split_quotas(np.concatenate([blocks * passes, last]), np.concatenate([blocks * passes, blocks]), shards, seed)
        starts = lambda x: np.concatenate([np.zeros((1, x.shape[1]), dtype=np.int64), np.cumsum(x, axis=0)]).T.copy()
        self.full, self.drawn, self.pool = starts(drawn[:, :n]), starts(drawn[:, n:]), starts(pool[:, n:])

    def place(self, source: int, block: np.ndarray, turn: int) -> np.ndarray:
        return feistel(block, int(self.blocks[source]), self.seed * 1_000_003 + source * (MOST_TIMES + 1) + turn + 1)

    def whole_pass(self, source: int, block: np.ndarray, turn: int) -> np.ndarray:
        """Shards of the blocks in a pass that takes all of them."""
        return np.searchsorted(self.full[source], self.place(source, block, turn) + turn * int(self.blocks[source]), side="right") - 1

    def last_pass(self, source: int, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, turn) of the blocks in the last pass: drawn blocks first, shard by shard, then the others."""
        at = self.place(source, block, MOST_TIMES)
        drawn, pool = self.drawn[source], self.pool[source]
        shard = np.searchsorted(pool, at, side="right") - 1
        inside = at - pool[shard]
        is_drawn = inside < drawn[shard + 1] - drawn[shard]
        return shard, np.where(is_drawn, drawn[shard] + inside, drawn[-1] + at - drawn[shard + 1])


def _plain(docs: DataFrame) -> list[str]:
    """Columns that can be hashed."""
    return [f"`{n}`" for n, t in docs.dtypes if not any(x in t for x in ("map<", "variant"))]


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, row, size); ``row`` is a hash of the whole row, which tells rows of one doc_id apart."""
    return docs.select("doc_id", "source", F.xxhash64(*_plain(docs)).alias("row"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))


def _before(rows: DataFrame, group: F.Column, order: list) -> F.Column:
    """Add ``at``: the words of the same source's rows before each row; groups are in the line's order."""
    rows = rows.withColumn("g", group)
    own = Window.partitionBy("k", "g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("k", "g").agg(F.sum("size").alias("in_group"))
    earlier = Window.partitionBy("k").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("offset", F.coalesce(F.sum("in_group").over(earlier), F.lit(0))).drop("in_group")
    return rows.withColumn("at", F.coalesce(F.sum("size").over(own), F.lit(0))).join(before, ["k", "g"]).withColumn("at", F.col("at") + F.col("offset")).drop("g", "offset")


def _by_source(k: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(k, kind="stable")
    cuts = np.flatnonzero(np.diff(k[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(k[rows[0]]), rows


_PLAN = "doc_id bigint, source string, row bigint, size bigint, source_size bigint, target double, taken bigint, copies array<struct<pass:int,words:bigint,shard:int,place:bigint>>"


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, shards: int | None = None, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document: what the mix takes of it.

    ``(doc_id, source, row, size, source_size, target, taken, copies)``; ``copies`` is an
    array of ``(pass, words, shard, place)``, ``place`` being the key of the local shuffle.
    """
    rows, _ = stored(sized(docs), "sizes")
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; map them to mixture components first")
    # code point order is the order of UTF-8 bytes
    found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["n"] for r in found]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(found))])
    words = [min(round(t), MOST_TIMES * s) for t, s in zip(want, sizes, strict=True)]
    block_words = max(block_words, -(-MOST_TIMES * sum(sizes) // MOST_BLOCKS))
    shards = _shards(sum(words), len(found)) if shards is None else shards
    blocks = np.array([-(-s // block_words) for s in sizes], dtype=np.int64)
    passes = np.array([w // s if s else 0 for w, s in zip(words, sizes, strict=True)], dtype=np.int64)
    rest = [w - int(p) * s for w, p, s in zip(words, passes, sizes, strict=True)]
    last = np.array([-(-r * int(b) // s) if s else 0 for r, b, s in zip(rest, blocks, sizes, strict=True)], dtype=np.int64)
    # MOST_CELLS numbers at most, three times
    draw = spark.sparkContext.broadcast(Draw(blocks, passes, last, shards, seed))
    plan = spark.createDataFrame(
        [(r["source"], i, int(r["n"]), float(t), int(p), int(x), int(b), max(1, -(-int(r["docs"]) // _GROUP))) for i, (r, t, p, x, b) in enumerate(zip(found, want, passes, rest, blocks, strict=True))],
        "source string, k int, source_size bigint, target double, passes int, rest bigint, blocks bigint, groups int",
    )
    # a row for each source, MOST_SOURCES at most
    rows = rows.join(F.broadcast(plan), rows["source"].eqNullSafe(plan["source"])).drop(plan["source"]).withColumn("h", F.xxhash64(F.lit(seed), "row"))
    # equal ranges of the hash: groups of a source in the line's order
    by_hash = F.floor(F.shiftrightunsigned("h", 33).cast("double") * F.col("groups") / float(1 << 31)).cast("int")
    line = _before(rows, by_hash, [F.shiftrightunsigned("h", 1), "h", F.col("doc_id").asc_nulls_first(), "size"])

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            k, block = whole(b, "k"), whole(b, "at") // block_words
            shard, turn = np.zeros(len(k), dtype=np.int32), np.zeros(len(k), dtype=np.int64)
            for source, own in _by_source(k):
                shard[own], turn[own] = draw.value.last_pass(source, block[own])
            yield {f.name: b.column(i) for i, f in enumerate(b.schema)} | {"block": block, "shard": shard, "turn": turn}

    some = line.where("size > 0")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema)
    placed = map_batches(some, turns, f"{ddl}, block bigint, shard int, turn bigint").withColumnRenamed("at", "line_at")
    by_turn = F.floor(F.col("turn").cast("double") * F.col("groups") / F.col("blocks")).cast("int")
    placed = _before(placed, by_turn, ["turn", "line_at", "h", F.col("doc_id").asc_nulls_first()])

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        kind = pa.struct([("pass", pa.int32()), ("words", pa.int64()), ("shard", pa.int32()), ("place", pa.int64())])
        for b in batches:
            k, size, passes, rest, at, block, last, h = (whole(b, c) for c in ("k", "size", "passes", "rest", "at", "block", "shard", "h"))
            part = np.clip(rest - at, 0, size)
            base = (h.view(np.uint64) >> np.uint64(1)).astype(np.int64)
            found = []
            for turn in range(MOST_TIMES):
                own = np.flatnonzero(passes > turn)
                shard = np.zeros(len(own), dtype=np.int64)
                for source, rows in _by_source(k[own]):
                    shard[rows] = draw.value.whole_pass(source, block[own[rows]], turn)
                found.append((own, np.full(len(own), turn), size[own], shard))
            own = np.flatnonzero(part > 0)
            found.append((own, passes[own], part[own], last[own]))
            row, turn, words, shard = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(row, kind="stable")
            row, turn, words, shard = row[order], turn[order], words[order], shard[order]
            place = feistel(base[row] ^ turn, 1 << 63, seed)
            values = pa.StructArray.from_arrays([pa.array(turn, pa.int32()), pa.array(words, pa.int64()), pa.array(shard, pa.int32()), pa.array(place, pa.int64())], fields=list(kind))
            lists = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(len(k) + 1)).astype(np.int32), values)
            yield {c: b.column(b.schema.get_field_index(c)) for c in ("doc_id", "source", "row", "size", "source_size", "target")} | {"taken": size * passes + part, "copies": lists}

    taken = map_batches(placed, copies, _PLAN)
    nothing = rows.where("size = 0").select("doc_id", "source", "row", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"), F.array().cast(_PLAN[_PLAN.index("array<") :]).alias("copies"))
    return taken.unionByName(nothing)


def _shards(words: int, sources: int) -> int:
    return max(1, min(-(-words // SHARD_WORDS), MOST_CELLS // max(1, 2 * sources)))


def mix_documents(docs: DataFrame, shards: int | None = None, **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row per copy, shard by shard and shuffled by place within.

    A copy that the target cuts keeps its first words; the text of a whole copy is untouched.
    """
    plan, _ = stored(mix_plan(docs, shards=shards, **options).where("taken > 0"), "mix")
    words, most = plan.select(F.explode("copies").alias("c")).agg(F.sum("c.words"), F.max("c.shard")).first()
    slices = max(1, -(-(words or 0) // SHARD_WORDS) // ((most or 0) + 1))
    key = [F.coalesce("doc_id", F.lit(0)).alias("key_id"), F.col("row").alias("key_row")]
    once = ["key_id", "key_row"]
    packed = docs.select(F.coalesce("doc_id", F.lit(0)).alias("key_id"), F.xxhash64(*_plain(docs)).alias("key_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    repeated = plan.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(*once)
    repeated, _ = stored(repeated, "repeated")
    copies = plan.select(*key, "size", F.explode("copies").alias("c")).select(*once, "size", "c.words", "c.shard", "c.place")
    if repeated.isEmpty():
        both = packed.join(copies, once)
    else:
        # of rows that are equal, one stands for all; each has its own copies in the plan
        again = packed.join(repeated, once, "left_semi").groupBy(*once).agg(F.any_value("doc").alias("doc"))
        both = packed.join(repeated, once, "left_anti").unionByName(again).join(copies, once)
    text = F.col("doc.text")
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    both = both.select("doc", "shard", "place", F.when(F.col("words") < F.col("size"), first).otherwise(text).alias("new_text"))
    both = both.withColumn("slice", F.floor(F.col("place") / float(1 << 63) * slices).cast("int"))
    out = both.repartition(min(MOST_TASKS, ((most or 0) + 1) * slices), "shard", "slice").sortWithinPartitions("shard", "place")
    kind = {f.name: f.dataType for f in docs.schema}
    new = {"text": F.col("new_text"), "n_chars": F.char_length("new_text").cast(kind["n_chars"]) if "n_chars" in kind else None}
    return out.select(*[new[c].alias(c) if new.get(c) is not None else F.col("doc").getField(c).alias(c) for c in docs.columns])
