"""Repeated passages: every window of ``WINDOW`` words that also starts earlier goes.

A count-min sketch of the corpus narrows the windows to those that may be repeated; an
exact grouping of just these decides. The sketch counts *anchors*: of each window,
the least hash of its runs of ``GRAM`` words (of equals the first). Equal windows have
equal anchors at equal offsets, so an anchor's estimate is at least its window's count
and no repeated window is lost, while one anchor serves many windows.

1. The grid has about ``4 x anchors`` cells by the table's bytes, ``MOST_CELLS`` at most. Each task
   gives partial sketches of at most ``_FLUSH_CELLS`` counted cells, cut in blocks of the grid. Blocks
   merge as sorted streams, a block's table in memory at a time, in a tree of two levels where
   many partials meet, and end as one bit a cell: counted twice or more. The broadcast so has a fixed bound (two
   depths of ``MOST_CELLS`` bits, 128 MB); beyond some 10**8 anchors (5 GB of text) the grid fills up, and
   the share of windows that passes grows to all of them at about 10**9 anchors; none is lost.
2. Each task digests its flagged windows (128 bits of BLAKE2 over their words, so that equal
   digests mean equal words), keeps the first of each by
   (doc_id, start) and marks its later ones at once, so a passage in a third of all documents
   sends one row a task. The first ones meet sorted by digest; all but the least are marked.
3. Marks and texts meet by ``doc_id`` in one sorted pass that removes the words.

Defined results: null and blank texts have no words; texts shorter than a window lose
nothing; rows with a null ``doc_id`` have no place in the order, so they neither lose
words nor count as earlier; rows that repeat a ``doc_id`` are taken as one document's
repeats and lose the same words (they should hold equal texts). Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import map_batches, whole
from ._store import stored
from ._words import Words, chunks, is_separator, mix64, spans_of, words_of

WINDOW, GRAM = 20, 5
MOST_CELLS = 1 << 29
_BLOCKS_LOG, _LEAST_LOG = 9, 15
_TWICE = np.uint32(1 << 31)
_FLUSH, _FLUSH_CELLS = 1_500_000, 4_000_000
#: Partial sketches of a block that one task merges.
_FAN = 256


def anchors(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, each one's anchor position, anchor hashes by position), as indices of ``words``."""
    counts = np.diff(words.first) - window + 1
    counts[counts < 0] = 0
    starts = np.repeat(words.first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    if not len(starts):
        return starts, starts, np.zeros(0, dtype=np.uint64)
    grams = spans_of(words.hash, gram)
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    least = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
    have, want = 1, window - gram + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return starts, (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), grams


def _cells(grams: np.ndarray, log: int) -> np.ndarray:
    """Two cells of a grid of 2**log for every anchor."""
    h = mix64(grams ^ np.uint64(0xC0117))
    return np.stack([h >> np.uint64(32), h & np.uint64(0xFFFFFFFF)]) >> np.uint64(32 - log)


def _packed(depth: int, cells: np.ndarray, times: np.ndarray, log: int) -> Iterator[tuple[int, int, bytes]]:
    """(depth, block, cells) of ascending distinct cells: the place in the block, and a bit for twice or more."""
    low = log - _BLOCKS_LOG
    cuts = np.searchsorted(cells, np.arange((1 << _BLOCKS_LOG) + 1, dtype=np.uint64) << np.uint64(low))
    packed = (cells & np.uint64((1 << low) - 1)).astype(np.uint32) | np.where(times > 1, _TWICE, np.uint32(0))
    for i in np.flatnonzero(np.diff(cuts)):
        yield depth, int(i), packed[cuts[i] : cuts[i + 1]].tobytes()


def _sketch(log: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        found: list[np.ndarray] = []
        size = 0

        def partial() -> dict:
            cells = np.concatenate(found, axis=1)
            rows = [r for depth in (0, 1) for r in _packed(depth, *np.unique(cells[depth], return_counts=True), log)]
            return dict(zip(("depth", "block", "cells"), zip(*rows, strict=True), strict=True))

        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in chunks(texts):
                _, at, grams = anchors(words_of(texts[lo:hi]))
                if len(at):
                    found.append(_cells(grams[np.unique(at)], log))
                    size += found[-1].shape[1]
                if size > _FLUSH_CELLS:
                    yield partial()
                    found, size = [], 0
        if found:
            yield partial()

    return run


def _merge(log: int, last: bool):
    """Of rows sorted by (depth, block), each block's merged cells; at the end, one bit for each that counts twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, counts = None, np.zeros(1 << (log - _BLOCKS_LOG), dtype=np.uint8)

        def done() -> dict:
            if last:
                cells = zlib.compress(np.packbits(counts > 1).tobytes(), 1)
            else:
                at = np.flatnonzero(counts).astype(np.uint32)
                cells = (at | np.where(counts[at] > 1, _TWICE, np.uint32(0))).tobytes()
            return {"depth": [key[0]], "block": [key[1]], "cells": [cells]}

        for b in batches:
            for depth, block, packed in zip(*(b.column(c).to_pylist() for c in ("depth", "block", "cells")), strict=True):
                if key != (depth, block):
                    if key is not None:
                        yield done()
                    key = (depth, block)
                    counts[:] = 0
                cells = np.frombuffer(packed, dtype=np.uint32)
                at = cells & ~_TWICE
                counts[at] = np.minimum(2, counts[at] + np.where(cells >= _TWICE, 2, 1).astype(np.uint8))
        if key is not None:
            yield done()

    return run


def _merged(partials: DataFrame, log: int) -> DataFrame:
    """``(depth, block, cells)`` with one row a block, merged in a tree."""
    each = partials.count() >> (_BLOCKS_LOG + 1)
    ddl = "depth int, block int, cells binary"
    if each > _FAN:
        fan = -(-each // _FAN)
        parts = partials.withColumn("part", F.pmod(F.xxhash64("cells"), F.lit(fan)))
        partials = map_batches(parts.repartition("depth", "block", "part").sortWithinPartitions("part", "depth", "block").select("depth", "block", "cells"), _merge(log, False), ddl)
    return map_batches(partials.repartition("depth", "block").sortWithinPartitions("depth", "block"), _merge(log, True), ddl)


class Repeated:
    """The merged sketch: one bit a cell and depth."""

    def __init__(self, blocks: list[tuple[int, int, bytes]], log: int) -> None:
        self.log = log
        each = 1 << (log - _BLOCKS_LOG - 3)
        self.bits = np.zeros((2, each << _BLOCKS_LOG), dtype=np.uint8)
        for depth, block, packed in blocks:
            self.bits[depth, block * each : (block + 1) * each] = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        cells = _cells(grams, self.log)
        hit = np.ones(len(grams), dtype=bool)
        for depth in (0, 1):
            hit &= (self.bits[depth, (cells[depth] >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (cells[depth] & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        return hit


def digests(w: Words, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every window's words, joined by one space."""
    raw = np.frombuffer(w.buffer + b" ", dtype=np.uint8)
    apart = is_separator(raw)
    keep = ~apart
    keep[w.end] = True
    joined = np.where(apart, np.uint8(32), raw)[keep].tobytes()
    place = np.concatenate([[0], np.cumsum(w.end - w.start + 1)])
    begin, end = place[starts].tolist(), (place[starts + window] - 1).tolist()
    out = np.frombuffer(b"".join([hashlib.blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(begin, end, strict=True)]), dtype=np.int64)
    return out[::2], out[1::2]


_LOADED: dict[str, Repeated] = {}


def _flagged(name: str, sketch, batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows (h, c, doc_id, pos, known): known ones are marks already, ``pos`` = start << 32 | run length."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Repeated(*sketch.value)
    repeated = _LOADED[name]
    kept: list[tuple] = []
    size = 0

    def flush() -> Iterator[dict]:
        h, c, doc, at = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((at, doc, c, h))
        h, c, doc, at = h[order], c[order], doc[order], at[order]
        lead = np.ones(len(h), dtype=bool)
        lead[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        for lo in range(0, len(h), 200_000):
            s = np.flatnonzero(lead[lo : lo + 200_000]) + lo
            yield {"h": h[s], "c": c[s], "doc_id": doc[s], "pos": (at[s] << 32) | 1, "known": np.zeros(len(s), dtype=bool)}
        first = np.flatnonzero(lead)[np.cumsum(lead) - 1]
        rest = ~lead & ((doc != doc[first]) | (at != at[first]))
        doc, at = doc[rest], at[rest]
        if not len(at):
            return
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        cut = np.ones(len(at), dtype=bool)
        cut[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)
        runs = np.flatnonzero(cut)
        last = np.append(runs[1:], len(at)) - 1
        yield {"h": mix64(doc[runs].astype(np.uint64)).view(np.int64), "c": np.zeros(len(runs), dtype=np.int64), "doc_id": doc[runs], "pos": (at[runs] << 32) | (at[last] - at[runs] + 1), "known": np.ones(len(runs), dtype=bool)}

    for b in batches:
        texts, ids = b.column("text").to_pylist(), whole(b, "doc_id")
        for lo, hi in chunks(texts):
            w = words_of(texts[lo:hi])
            starts, at, grams = anchors(w)
            if not len(starts):
                continue
            distinct, back = np.unique(at, return_inverse=True)
            starts = starts[repeated(grams[distinct])[back]]
            h, c = digests(w, starts)
            doc = w.doc[starts]
            kept.append((h, c, ids[lo:hi][doc], starts - w.first[doc]))
            size += len(starts)
            if size > _FLUSH:
                yield from flush()
                kept, size = [], 0
    if size:
        yield from flush()


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Of rows sorted by (h, c, doc_id, pos), marks: the known ones, and all but the first of equal windows."""
    held = (None, None, None, None)
    for b in batches:
        h, c, doc, pos, known = (whole(b, x) for x in ("h", "c", "doc_id", "pos", "known"))
        new = np.flatnonzero(~known)
        h, c, d, p = h[new], c[new], doc[new], pos[new]
        if len(new):
            lead = np.ones(len(new), dtype=bool)
            lead[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            first = np.flatnonzero(lead)[np.cumsum(lead) - 1]
            fd, fp = d[first], p[first]
            if held[0] == h[0] and held[1] == c[0]:
                same = first == 0
                fd, fp = np.where(same, held[2], fd), np.where(same, held[3], fp)
            marks = (d != fd) | (p != fp)
            held = (h[-1], c[-1], fd[-1], fp[-1])
            yield {"doc_id": d[marks], "pos": p[marks]}
        yield {"doc_id": doc[known], "pos": pos[known]}


def marks_of(docs: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """``(doc_id, pos)``: runs of window starts that also start earlier, ``pos`` = start << 32 | run length."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # an anchor to about 50 bytes of text, four cells to an anchor
    log = max(_LEAST_LOG, min(most_cells.bit_length() - 1, (size // 12).bit_length()))
    partials, name = stored(map_batches(docs, _sketch(log), "depth int, block int, cells binary"), "sketch")
    bits = _merged(partials, log).collect()
    sketch = spark.sparkContext.broadcast(([(r.depth, r.block, bytes(r.cells)) for r in bits], log))
    found = map_batches(docs, lambda batches: _flagged(name, sketch, batches), "h bigint, c bigint, doc_id bigint, pos bigint, known boolean")
    return map_batches(found.repartition("h").sortWithinPartitions("h", "c", "doc_id", "pos"), _later, "doc_id bigint, pos bigint")


def _covered(n: int, marks: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of ``n`` words a marked window covers."""
    start, length = marks >> 32, marks & 0xFFFFFFFF
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, np.minimum(start, n), 1)
    np.add.at(edge, np.minimum(start + length + window - 1, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _removed(text: str | None, marks: list[np.ndarray]) -> tuple[int, int, str]:
    w = words_of([text])
    n = len(w.start)
    gone = _covered(n, np.concatenate(marks)) if marks else np.zeros(n, dtype=bool)
    kept = b" ".join([w.buffer[a:b] for a, b in zip(w.start[~gone].tolist(), w.end[~gone].tolist(), strict=True)])
    return n, int(gone.sum()), kept.decode()


def _apply(digest: bool):
    """Of rows sorted by (doc_id, pos), texts first: each text's counts and what is left of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        owner, texts, marks = None, [], []

        def done() -> list[tuple]:
            out = []
            for t in texts:
                n, gone, kept = _removed(t, marks)
                out.append((owner, n, gone, hashlib.sha256(kept.encode()).hexdigest() if digest else kept))
            return out

        columns = lambda rows: dict(zip(("doc_id", "n_words", "n_removed", "kept"), zip(*rows, strict=True), strict=True))
        for b in batches:
            rows: list[tuple] = []
            at = b.schema.get_field_index("doc_id")
            nobody = b.column(at).is_null().to_numpy(zero_copy_only=False)
            ids, pos = b.column(at).fill_null(0).to_numpy(), whole(b, "pos")
            cuts = np.flatnonzero((np.diff(ids) != 0) | nobody[1:] | nobody[:-1]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                who = None if nobody[lo] else int(ids[lo])
                if who is None or who != owner:
                    rows += done()
                    texts, marks = [], []
                owner = who
                split = lo + int(np.searchsorted(pos[lo:hi] >= 0, True))
                texts += b.column("text").slice(lo, split - lo).to_pylist()
                if split < hi:
                    marks.append(pos[split:hi])
            if rows:
                yield columns(rows)
        if texts:
            yield columns(done())

    return run


def remove_repeats(docs: DataFrame, digest: bool = False, most_cells: int = MOST_CELLS) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: the kept words joined by one space (``digest``: its SHA-256)."""
    rows = docs.select("doc_id", F.lit(-1).cast("bigint").alias("pos"), "text")
    marks = marks_of(docs, most_cells).select("doc_id", "pos", F.lit(None).cast("string").alias("text"))
    together = rows.unionByName(marks).repartition("doc_id").sortWithinPartitions("doc_id", "pos")
    return map_batches(together, _apply(digest), "doc_id bigint, n_words bigint, n_removed bigint, kept string")
