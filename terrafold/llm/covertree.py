"""Exact top-k inner products by dual-tree search over cover trees.

Every vector becomes whole numbers, floor(1024 x). The stated query set is searched block by block, each
block of at most ``QUERY_BYTES`` (the broadcast's fixed bound) collected, sent out, searched and freed
before the next; each task builds a cover tree on each run of ``CHUNK`` of its candidates and one on the
queries: a node's children are a greedy net at half its radius, and every node knows its covering radius, its
cone (the widest angle to its center) and its norms. Pairs of nodes are visited together,
largest bound first: the product of a query below Q and a candidate below P is at most
``q.p + rQ |p| + rP |q| + rQ rP``, and at most ``|Q| |P| cos(angle(q, p) - cone Q - cone P)``. A pair goes if
the lesser of both is below the worst kth score so far among Q's queries. What is left meets in exact integer
products; equal scores order by smaller vec_id. Each task gives k rows a query at most, and the best k of these
are the result.

Points whose net at half the radius needs more than ``MOST_CHILDREN`` centers stay one leaf, and
two leaves meet in dense blocks. Vectors spread evenly over many dimensions are all of that kind: no
ball or cone bound can rule any of them out, and the search is a blocked product of all pairs.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor does a
null vec_id; vectors of unequal length count as padded with zeros; a query id that repeats is one
query (its smallest vector in array order); candidates that repeat a vec_id are each a row and tie in any
order; products beyond 64 bits raise an error, as do whole numbers beyond 2**53. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import map_batches, whole
from ._store import scratch_path

SCALE, TOP, EVERY = 1024, 10, 100
QUERY_BYTES, CHUNK, LEAF, QUERY_LEAF = 16 << 20, 16384, 32, 4
#: A node with more children would be in too many dimensions for its bounds to rule anything out.
MOST_CHILDREN = 64
#: Queries of two leaves that are multiplied at a time.
_DENSE = 256


class Node:
    __slots__ = ("rows", "center", "norm", "radius", "cone", "least", "most", "children", "worst")

    def __init__(self, rows: np.ndarray, points: np.ndarray, center: int) -> None:
        self.rows, self.center = rows, points[center]
        self.norm = float(np.sqrt(self.center @ self.center))
        own = points[rows]
        squares = (own * own).sum(axis=1)
        products = own @ self.center
        self.radius = float(np.sqrt(np.maximum(squares - 2 * products + self.norm**2, 0).max()))
        norms = np.sqrt(squares)
        self.least, self.most = float(norms.min()), float(norms.max())
        scale = norms * self.norm
        self.cone = float(np.arccos(np.clip(products / scale, -1, 1)).max()) if scale.min() > 0 else np.pi
        self.children: list[Node] = []
        self.worst = -np.inf

    def bound(self, other: Node) -> float:
        """No product of a vector below and one below ``other`` is larger."""
        product = float(self.center @ other.center)
        ball = product + self.radius * other.norm + other.radius * self.norm + self.radius * other.radius
        scale = self.norm * other.norm
        apart = float(np.arccos(min(1.0, max(-1.0, product / scale)))) if scale else 0.0
        cosine = float(np.cos(max(0.0, apart - self.cone - other.cone)))
        cone = cosine * (self.most * other.most if cosine > 0 else self.least * other.least)
        b = min(ball, cone)
        # room for rounding
        return b + 1e-7 * self.most * other.most + 1


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Node:
    """A cover tree on the rows of ``points`` (float64): children cover their points within half the parent's radius."""
    root = Node(np.arange(len(points)), points, 0)
    todo = [root]
    while todo:
        top = todo.pop()
        if len(top.rows) <= leaf or top.radius == 0:
            continue
        own = points[top.rows]
        squares = (own * own).sum(axis=1)
        nearest = np.full(len(own), np.inf)
        owner = np.zeros(len(own), dtype=np.int64)
        centers: list[int] = []
        at = int(np.argmin(((own - top.center) ** 2).sum(axis=1)))
        # farthest point first until half the radius covers all
        for _ in range(max(MOST_CHILDREN, len(own) // 256)):
            far = np.maximum(squares + squares[at] - 2 * (own @ own[at]), 0)
            closer = far < nearest
            nearest[closer], owner[closer] = far[closer], len(centers)
            centers.append(at)
            at = int(np.argmax(nearest))
            if nearest[at] <= (top.radius / 2) ** 2:
                break
        else:
            continue
        children = [Node(top.rows[owner == i], points, int(top.rows[c])) for i, c in enumerate(centers) if (owner == i).any()]
        if len(children) > 1:
            top.children = children
            todo += children
    return root


class Best:
    """The k best (score, vec_id) per query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min + 1, dtype=np.int64)
        self.ids = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Offer ``scores[i, j]`` of candidate ``ids[j]`` to query ``rows[i]`` where allowed."""
        good = (scores >= self.score[rows, -1:]) & allowed
        for i in np.flatnonzero(good.any(axis=1)):
            r = rows[i]
            own = np.flatnonzero(good[i])
            if len(own) > 4 * self.k:
                # all that reach the kth largest, ties included
                least = np.partition(scores[i, own], len(own) - self.k)[len(own) - self.k]
                own = own[scores[i, own] >= least]
            s, d = np.concatenate([self.score[r], scores[i, own]]), np.concatenate([self.ids[r], ids[own]])
            order = np.lexsort((d, -s))[: self.k]
            self.score[r], self.ids[r] = s[order], d[order]


def dual_search(queries: np.ndarray, query_ids: np.ndarray, tree: Node, points: np.ndarray, ids: np.ndarray, own: Node, best: Best) -> int:
    """Update ``best`` with all of ``points``; returns the number of vector pairs that were multiplied."""
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(points).max(initial=0)) * points.shape[1]
    if exact >= 2**62:
        raise OverflowError("inner products don't fit 64 bits")
    small = exact < 2**52
    done, tick = 0, 0

    heap = [(-own.bound(tree), 0, own, tree)]
    while heap:
        negative, _, q, p = heapq.heappop(heap)
        q.worst = float(best.score[q.rows, -1].min())
        if -negative < q.worst:
            continue
        if not q.children and not p.children:
            b = points[p.rows]
            for lo in range(0, len(q.rows), _DENSE):
                rows = q.rows[lo : lo + _DENSE]
                a = queries[rows]
                scores = np.rint(a @ b.T).astype(np.int64) if small else a.astype(np.int64) @ b.astype(np.int64).T
                best.add(rows, scores, ids[p.rows], query_ids[rows][:, None] != ids[p.rows][None, :])
                done += scores.size
            continue
        split_p = p.children and (not q.children or p.radius * q.norm >= q.radius * p.norm)
        for q2, p2 in [(q, x) for x in p.children] if split_p else [(x, p) for x in q.children]:
            tick += 1
            heapq.heappush(heap, (-q2.bound(p2), tick, q2, p2))
    return done


def _usable(df: DataFrame) -> DataFrame:
    """(vec_id, v): whole-number vectors of the rows that take part."""
    e = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(ok).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v"))


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` numbers, padded with zeros and cut."""
    size = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(len(vectors), width)
    out = np.zeros((len(vectors), width))
    row, at = np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


def _search(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        query_ids, queries = block.value
        best = Best(len(query_ids), k)
        own = cover_tree(queries, QUERY_LEAF)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def search() -> None:
            ids, points = (np.concatenate(x) for x in zip(*held, strict=True))
            dual_search(queries, query_ids, cover_tree(points), points, ids, own, best)
            held.clear()

        for b in batches:
            for lo in range(0, b.num_rows, CHUNK):
                part = b.slice(lo, CHUNK)
                held.append((whole(part, "vec_id"), _matrix(part.column("v"), queries.shape[1])))
                if sum(len(i) for i, _ in held) >= CHUNK:
                    search()
        if held:
            search()
        r, c = np.nonzero(best.ids != np.iinfo(np.int64).max)
        yield {"query_id": query_ids[r], "vec_id": best.ids[r, c], "score": best.score[r, c]}

    return run


def top_products(vectors: DataFrame, every: int = EVERY, k: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best candidates of every row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = _usable(vectors.select("vec_id", "embedding"))
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, width = queries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = -(-n * 8 * (width or 0) // query_bytes)
    found = None
    for i in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).toArrow()
        if not own.num_rows:
            continue
        ids, matrix = own.column("vec_id").to_numpy(), _matrix(own.column("v").combine_chunks(), width)
        # about query_bytes: a bound that does not grow with the table
        sent = spark.sparkContext.broadcast((ids, matrix))
        path = scratch_path(spark, "products")
        part = map_batches(rows, _search(sent, k), "query_id bigint, vec_id bigint, score bigint")
        part.write.parquet(path)
        sent.destroy()
        part = spark.read.schema(part.schema).parquet(path)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
