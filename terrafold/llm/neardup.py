"""Near-duplicate documents: one-permutation MinHash, bands, stars, exact confirmation.

1. Every text's set of distinct ``width``-word shingles (64-bit hashes) gives one sketch
   of ``BANDS * ROWS`` bins from a single hash pass; empty bins borrow from a
   non-empty bin that a hash of (bin, attempt) picks (optimal densification).
2. Documents with equal sets collapse to their smallest ``doc_id`` first, so a group of
   exact copies costs one row from there on.
3. Each band of a sketch is a bucket. A bucket of m documents gives m - 1 edges, to
   its smallest id: the stars' components are *clusters* that hold all candidates.
4. Within clusters links are confirmed on full sets; a task gives the edges of a spanning
   forest of the links it found (at most one less than its documents), never all pairs.
   Clusters beyond ``TILE`` documents or ``TILE_BYTES`` are dealt out in tiles, each
   with the cluster's few *pivots*. What that leaves outside a cluster's largest component
   meets the whole cluster once more, tile by tile, so no link between different texts
   is lost, and a large family of copies of each other costs no pairs of tiles.
5. Components of the confirmed links are the result.

Keys that many rows share (a band of a family, a class of exact copies, a star's hub) are
joined from tables on both sides, which adaptive execution splits where a key is hot.

Shingles are 64-bit hashes of the hashes of their words (``_words``).

Defined results: texts without words (null, empty, blank) have an empty set and are
linked with nothing; fewer words than ``width`` are one shingle of the whole sequence;
rows that repeat a ``doc_id`` are one node; a null ``doc_id`` is linked with nothing
and its component is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import map_batches, whole
from ._graph import components, few
from ._store import drop, stored
from ._words import chunks, mix64, spans_of, words_of

WIDTH, BANDS, ROWS, TILE = 5, 48, 7, 384
BINS = BANDS * ROWS
_VALUE_BITS = 40
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_ATTEMPTS = 4096
_DENSE_CELLS = 4_000_000
#: Bytes of shingle sets in a tile, and in a task of small clusters, which holds about _GROUP documents at most.
TILE_BYTES, _GROUP_BYTES, _GROUP = 8 << 20, 16 << 20, 1500
PIVOTS = 4
#: The largest node bitmap (16 MB): more nodes only let more other texts through to the join.
FILTER_BITS = 1 << 27


def shingle_sets(texts, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    w = words_of(texts, lower=True)
    full = spans_of(w.hash, width)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        n = int(b - a)
        out.append(np.unique(full[a : b - width + 1] if n >= width else spans_of(w.hash[a:b], n)) if n else np.zeros(0, dtype=np.uint64))
    return out


def _probes() -> np.ndarray:
    grid = np.arange(_ATTEMPTS * BINS, dtype=np.uint64)
    return (mix64(grid + np.uint64(0x51ED27)) % np.uint64(BINS)).astype(np.int16).reshape(_ATTEMPTS, BINS)


_PROBES: list[np.ndarray] = []


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation sketches, optimally densified; rows of empty sets stay EMPTY."""
    sizes = np.array([len(s) for s in sets])
    sketch = np.full((len(sets), BINS), _EMPTY, dtype=np.uint64)
    if sizes.sum() == 0:
        return sketch
    h = mix64(np.concatenate(sets) ^ np.uint64(0xA5A5))
    row = np.repeat(np.arange(len(sets)), sizes)
    cell = row * BINS + (((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    value = mix64(h) & np.uint64((1 << _VALUE_BITS) - 1)
    order = np.lexsort((value, cell))
    cell, value = cell[order], value[order]
    lead = np.ones(len(cell), dtype=bool)
    lead[1:] = cell[1:] != cell[:-1]
    sketch.reshape(-1)[cell[lead]] = value[lead]
    if not _PROBES:
        _PROBES.append(_probes())
    solid = sketch != _EMPTY
    r, c = np.nonzero(~solid & (sizes > 0)[:, None])
    for probe in _PROBES[0]:
        if not len(r):
            break
        to = probe[c]
        hit = solid[r, to]
        sketch[r[hit], c[hit]] = sketch[r[hit], to[hit]]
        r, c = r[~hit], c[~hit]
    for i, j in zip(r, c, strict=True):  # no bin met: the next one in a circle
        ahead = np.flatnonzero(solid[i])
        sketch[i, j] = sketch[i, ahead[np.searchsorted(ahead, j) % len(ahead)]]
    return sketch


def band_keys(sketch: np.ndarray) -> np.ndarray:
    keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], len(sketch), axis=0) + np.uint64(0xB5)
    for i in range(ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + sketch[:, i::ROWS])
    return keys.view(np.int64)


def _sketch_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id")
            for lo, hi in chunks(texts):
                sets = shingle_sets(texts[lo:hi], width)
                keys = band_keys(sketches(sets))
                yield {
                    "doc_id": ids.slice(lo, hi - lo),
                    "n_shingles": np.array([len(s) for s in sets], dtype=np.int64),
                    "set_a": np.array([np.add.reduce(mix64(s)) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64),
                    "set_b": np.array([np.bitwise_xor.reduce(mix64(s + np.uint64(77))) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64),
                    "bands": list(keys),
                }

    return run


def _node_filter(clusters: DataFrame, n: int) -> bytes:
    """A bitmap of hashed node ids, 16 bits a node and FILTER_BITS at most, packed by Spark's bitmap aggregate."""
    bits = min(FILTER_BITS, 1 << max(15, (16 * n).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            at = (mix64(whole(b, "node").astype(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)
            yield {"block": at >> 15, "bit": at & 32767}

    blocks = map_batches(clusters.select("node"), place, "block bigint, bit bigint").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in blocks.collect():
        out[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out.tobytes()


def _maybe(filtered) -> object:
    """Keep the rows whose doc_id the bitmap holds: all nodes and a few others, which the join drops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bits = np.frombuffer(filtered.value, dtype=np.uint8)
        for b in batches:
            ids = whole(b, "doc_id")
            at = (mix64(ids.astype(np.uint64)) & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
            hit = pa.array(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1) == 1)
            yield {"node": b.column("doc_id").filter(hit), "text": b.column("text").filter(hit)}

    return run


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in chunks(texts):
                yield {"node": b.column("node").slice(lo, hi - lo), "cluster": b.column("cluster").slice(lo, hi - lo), "members": [s.tobytes() for s in shingle_sets(texts[lo:hi], width)]}

    return run


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _links(sets: list[np.ndarray], label: np.ndarray, ask: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Forest edges of pairs with ``100 * shared >= percent * union``.

    Entries of equal ``label`` are connected already; one of each pair is in ``ask`` (booleans).
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    forest, found = _Forest(len(sets)), []
    first: dict[int, int] = {}
    for i, x in enumerate(label.tolist()):
        forest.link(first.setdefault(x, i), i)
    order = np.argsort(sizes, kind="stable")
    ranked = sizes[order]
    asked = order[ask[order]]
    everyone = bool(ask.all())
    for at in range(0, len(asked), 64):
        rows = asked[at : at + 64]
        # partners' sizes lie between these; where all ask, smaller ones have asked already
        end = int(np.searchsorted(ranked, sizes[rows[-1]] * 100 // percent, side="right"))
        begin = at if everyone else int(np.searchsorted(ranked, -(-sizes[rows[0]] * percent // 100), side="left"))
        for lo in range(begin, end, 256):
            cols = order[lo : min(end, lo + 256)]
            if len({forest.root(int(i)) for i in np.concatenate([rows, cols])}) < 2:
                continue
            block = _shared([sets[i] for i in rows], [sets[j] for j in cols])
            ok = 100 * block >= percent * (sizes[rows][:, None] + sizes[cols][None, :] - block)
            for i, j in zip(*np.nonzero(ok), strict=True):
                x, y = int(rows[i]), int(cols[j])
                if x != y and forest.link(x, y):
                    found.append((x, y))
    return found


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets in ``a`` with those in ``b``."""
    left, right = np.concatenate(a), np.concatenate(b)
    names = np.intersect1d(left, right)
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    step = max(1, _DENSE_CELLS // max(1, len(a) + len(b)))
    for lo in range(0, len(names), step):
        some = names[lo : lo + step]
        out += np.rint(_matrix(a, some) @ _matrix(b, some).T).astype(np.int64)
    return out


def _matrix(sets: list[np.ndarray], names: np.ndarray) -> np.ndarray:
    m = np.zeros((len(sets), len(names)), dtype=np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(names, s)
        at[at == len(names)] = 0
        m[i, at[names[at] == s]] = 1
    return m


def _tile_links(percent: int):
    """Links of a group's clusters; ``ask`` says whose partners are sought, ``label`` who is connected already."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        edges = []
        for _, part in group.groupby("cluster", sort=False):
            # a repeated doc_id may have several texts: every set of a node confirms links
            part = part.sort_values("ask", ascending=False, kind="stable").drop_duplicates(["node", "members"])
            nodes = part["node"].to_numpy()
            sets = [np.frombuffer(m, dtype=np.uint64) for m in part["members"]]
            edges += [(nodes[i], nodes[j]) for i, j in _links(sets, part["label"].to_numpy(), part["ask"].to_numpy(dtype=bool), percent) if nodes[i] != nodes[j]]
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return run


_ASK = ("node", "cluster", "members", "label", "ask", "of", "i", "j")


def _tiles(count: F.Column, size: F.Column) -> F.Column:
    return F.greatest(F.ceil(count / TILE), F.ceil(size / TILE_BYTES), F.lit(1)).cast("int")


def _each(n: str) -> F.Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _confirmed(sets: DataFrame, percent: int) -> DataFrame:
    """``(node, component)`` of the confirmed links within the clusters of ``sets(node, cluster, members)``."""
    total = sets.count()
    sizes, _ = stored(few(sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("members")).alias("n")).withColumn("tiles", _tiles(F.col("m"), F.col("n"))), total), "clusters")
    size, most = sizes.agg(F.sum("n"), F.max("tiles")).first()
    if not total:
        return sets.select("node", F.col("node").alias("component")).where("false")
    bins = max(1, total // _GROUP, int(size) // _GROUP_BYTES)
    tiled = sets.join(sizes.drop("n"), "cluster").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    one = tiled.where("tiles = 1").withColumns({"label": F.col("node"), "ask": F.lit(True), "of": F.lit(0).cast("bigint"), "i": F.lit(-1), "j": F.pmod(F.xxhash64("cluster"), F.lit(bins)).cast("int")})
    large = tiled.where("tiles > 1")
    # the least of each hash class of a cluster; a map-side minimum, so no cluster meets in a task
    least = F.min(F.struct(F.xxhash64(F.col("node") + 1).alias("h"), "node", "members", "tiles")).alias("p")
    pivots = large.groupBy("cluster", F.pmod(F.xxhash64(F.col("node") + 2), F.lit(PIVOTS)).alias("c")).agg(least).select("cluster", "p.node", "p.members", "p.tiles")
    inside = large.select("cluster", "node", "members", "tile").unionByName(pivots.select("cluster", "node", "members", _each("tiles").alias("tile")))
    inside = inside.withColumns({"label": F.col("node"), "ask": F.lit(True), "of": F.col("cluster"), "i": F.col("tile"), "j": F.lit(0)})
    first = one.select(*_ASK).unionByName(inside.select(*_ASK)) if most > 1 else one.select(*_ASK)
    links, path = stored(first.groupBy("of", "i", "j").applyInPandas(_tile_links(percent), "a bigint, b bigint"), "links")
    found, _ = stored(components(links, "links", links.count()), "components")
    if most == 1:
        drop(sets.sparkSession, path)
        return found
    # who is outside the largest component of a large cluster asks all of it
    named, named_path = stored(few(large.join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).select("node", "cluster", "members", "tile", "tiles", "label"), total), "named")
    counts = named.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("cluster").agg(F.max(F.struct("k", F.negative("label").alias("label"))).alias("x"))
    largest, _ = stored(few(counts.select("cluster", F.negative("x.label").alias("giant")), total), "largest")
    outside = named.join(largest, "cluster").where("label <> giant")
    rest, _ = stored(few(outside.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"), F.sum(F.octet_length("members")).alias("n")).select("cluster", _tiles(F.col("k"), F.col("n")).alias("rows")), total), "asking")
    if rest.isEmpty():
        drop(sets.sparkSession, named_path)
        return found
    named = named.join(rest.join(largest, "cluster"), "cluster").withColumn("ask", F.col("label") != F.col("giant"))
    sought = named.select("node", "cluster", "members", "label", F.lit(False).alias("ask"), _each("rows").alias("i"), F.col("tile").alias("j"))
    asked = named.where("ask").select("node", "cluster", "members", "label", "ask", F.pmod(F.xxhash64(F.col("node") + 3), F.col("rows")).cast("int").alias("i"), _each("tiles").alias("j"))
    second = asked.unionByName(sought).withColumn("of", F.col("cluster")).select(*_ASK).groupBy("of", "i", "j").applyInPandas(_tile_links(percent), "a bigint, b bigint")
    more, _ = stored(second, "links")
    if more.isEmpty():
        return found
    joined = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    return stored(components(joined, "links", joined.count()), "components")[0]


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``; links have ``100 * shared >= percent * union``."""
    spark = docs.sparkSession
    rows, _ = stored(map_batches(docs.select("doc_id", "text"), _sketch_rows(width), "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>"), "sketches")
    n = rows.count()
    usable = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["set_a", "set_b", "n_shingles"]
    classes, _ = stored(few(usable.groupBy(*same).agg(F.min("doc_id").alias("node")), n), "classes")
    # one row of a class has its bands: the sketch follows from the set
    heads = usable.join(classes.select(F.col("node").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi")
    keys, keys_path = stored(heads.select(F.col("doc_id").alias("node"), F.explode("bands").alias("key")).transform(few, n * BANDS), "keys")
    hubs, hubs_path = stored(keys.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "hub").transform(few, n * BANDS), "hubs")
    stars = keys.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    clusters, _ = stored(components(stars, "clusters").withColumnRenamed("component", "cluster"), "clusters")
    drop(spark, keys_path)
    drop(spark, hubs_path)
    total = clusters.count()
    nodes = spark.sparkContext.broadcast(_node_filter(clusters, total))
    members = map_batches(docs.select("doc_id", "text").where("doc_id IS NOT NULL"), _maybe(nodes), "node bigint, text string").join(clusters, "node")
    sets, path = stored(map_batches(members, _set_rows(width), "node bigint, cluster bigint, members binary"), "sets")
    found = _confirmed(sets, percent)
    drop(spark, path)
    named, _ = stored(few(classes.join(found, "node", "left").select(*same, F.coalesce("component", "node").alias("component_id")), n), "named")
    out = usable.select("doc_id", *same).join(named, same).select("doc_id", "n_shingles", "component_id")
    # without words, or without a key, a row is linked with nothing
    alone = rows.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that near-duplicate removal keeps, all columns as they are.

    Of each component the document with the smallest ``doc_id`` stays; of rows that repeat its ``doc_id`` and text
    one stays (the least by a hash of the row), other texts under the same ``doc_id`` stay too, as
    do rows without a ``doc_id``, which are linked with nothing.
    """
    kept = near_duplicates(docs, percent, width).where("kept").groupBy(F.col("doc_id").alias("kept_id")).agg(F.count(F.lit(1)).alias("m"))
    packed = docs.select(F.col("doc_id").alias("kept_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    held = packed.where("kept_id IS NOT NULL").join(kept, "kept_id")
    once = held.where("m = 1").select("row")
    again = held.where("m > 1").groupBy("kept_id", F.col("row.text").alias("t")).agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return once.unionByName(again).unionByName(packed.where("kept_id IS NULL").select("row")).select("row.*")
