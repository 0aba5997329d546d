"""The smallest eigenpairs of a sparse normalised Laplacian, in memory that follows its edges.

Components give the null space exactly. Further vectors are found from a hierarchy of contracted graphs: the coarsest
is solved as a dense matrix, and each finer one improves the vectors by block conjugate gradients (LOBPCG), with
the hierarchy below as the preconditioner.
"""

from __future__ import annotations

import numpy as np

#: Nodes of the coarsest graph.
COARSEST = 400


class Graph:
    """Symmetric weights between different nodes as sorted rows, and the mass (degree with loops) of each node."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, mass: np.ndarray | None = None):
        row, col, w = np.r_[i, j], np.r_[j, i], np.r_[w, w]
        order = np.argsort(row, kind="stable")
        self.n, self.row, self.col, self.w = n, row[order], col[order], w[order]
        self.degree = np.bincount(row, w, minlength=n)
        self.mass = self.degree if mass is None else mass
        self.starts = np.flatnonzero(np.r_[True, self.row[1:] != self.row[:-1]]) if len(row) else np.zeros(0, dtype=np.int64)

    def laplacian(self, x: np.ndarray) -> np.ndarray:
        out = self.degree[:, None] * x
        if len(self.starts):
            for k in range(x.shape[1]):  # a column at a time: as much again as the edges, not times the columns
                out[self.row[self.starts], k] -= np.add.reduceat(self.w * x[self.col, k], self.starts)
        return out


def components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        low = root.copy()
        np.minimum.at(low, a, b)
        np.minimum.at(low, b, a)
        while not (low[low] == low).all():
            low = low[low]
        root = low[root]


def _contracted(g: Graph) -> np.ndarray | None:
    """Nodes to 0.. : neighbours that prefer each other by weight over the smaller degree are joined, in three rounds; the rest join a neighbour."""
    group = np.full(g.n, -1)
    score = g.w / np.minimum(g.degree[g.row], g.degree[g.col])
    for _ in range(3):
        free = (group[g.row] < 0) & (group[g.col] < 0)
        if not free.any():
            break
        row, col, s = g.row[free], g.col[free], score[free]
        # equal scores: by a hash of the edge, else long ties would join little
        tie = ((np.minimum(row, col) * 2654435761 + np.maximum(row, col) * 40503) % 65521) / 65521
        order = np.lexsort((tie, s, row))
        last = np.flatnonzero(np.r_[row[order][1:] != row[order][:-1], True])
        best = np.full(g.n, -1)
        best[row[order][last]] = col[order][last]
        mutual = np.flatnonzero((best >= 0) & (best[best] == np.arange(g.n)))
        group[mutual] = np.minimum(mutual, best[mutual])
    alone = np.flatnonzero(group < 0)
    if len(alone):
        wait = group < 0
        edge = wait[g.row] & ~wait[g.col]
        order = np.lexsort((score[edge], g.row[edge]))
        row, col = g.row[edge][order], g.col[edge][order]
        last = np.flatnonzero(np.r_[row[1:] != row[:-1], True]) if len(row) else np.zeros(0, dtype=np.int64)
        group[row[last]] = group[col[last]]
        group[group < 0] = np.flatnonzero(group < 0)
    return np.unique(group, return_inverse=True)[1]


class Level:
    def __init__(self, g: Graph):
        self.g, self.to, self.below = g, None, None
        if g.n > COARSEST:
            to = _contracted(g)
            m = int(to.max()) + 1
            if m < 0.9 * g.n:
                a, b = to[g.row], to[g.col]
                upper = a < b
                key, at = np.unique(a[upper] * m + b[upper], return_inverse=True)
                self.to, self.order = to, np.argsort(to, kind="stable")
                self.heads = np.searchsorted(to[self.order], np.arange(m))
                self.below = Level(Graph(m, key // m, key % m, np.bincount(at, g.w[upper], minlength=len(key)), np.bincount(to, g.mass, minlength=m)))
        if self.below is None:
            dense = np.diag(g.degree)
            dense[g.row, g.col] -= g.w
            self.dense = dense
            values, vectors = np.linalg.eigh(dense)
            good = values > 1e-12 * max(values[-1], 1e-300)
            self.inverse = (vectors[:, good] / values[good]) @ vectors[:, good].T

    def down(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[self.order], self.heads, axis=0)

    def smooth(self, b: np.ndarray, x: np.ndarray | None, rounds: int = 2) -> np.ndarray:
        scale = 0.6 / np.maximum(self.g.degree, 1e-300)[:, None]
        for _ in range(rounds):
            x = scale * b if x is None else x + scale * (b - self.g.laplacian(x))
        return x

    def solve(self, b: np.ndarray) -> np.ndarray:
        """Nearly the inverse of the Laplacian: a cycle that visits each coarser graph twice (once from very large ones, whose sweeps cost most)."""
        if self.below is None:
            return self.inverse @ b
        x = self.smooth(b, None)
        for _ in range(2 if self.g.n < 200_000 else 1):
            x = x + self.below.solve(self.down(b - self.g.laplacian(x)))[self.to]
            x = self.smooth(b, x)
        return x

    def eigenpairs(self, take: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
        """(values, vectors x of L x = value * mass * x) beside the constant one; vectors are orthonormal by mass."""
        if self.below is None:
            scale = 1 / np.sqrt(self.g.mass)
            values, vectors = np.linalg.eigh(scale[:, None] * self.dense * scale[None, :])
            return values[1 : take + 1], scale[:, None] * vectors[:, 1 : take + 1]
        x = self.below.eigenpairs(take, max(tolerance, 1e-2))[1][self.to]
        return lobpcg(self, x, tolerance)


def _orthonormal(x: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Columns made orthonormal by mass, without those that depend on others."""
    size = np.sqrt((x * x * mass[:, None]).sum(axis=0))
    x = x[:, size > 1e-200] / size[size > 1e-200]
    values, vectors = np.linalg.eigh(x.T @ (mass[:, None] * x))
    good = values > 1e-13 * values[-1]
    return x @ (vectors[:, good] / np.sqrt(values[good]))


def lobpcg(level: Level, x: np.ndarray, tolerance: float, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    g, mass, k = level.g, level.g.mass, x.shape[1]
    flat = lambda v: v - (mass @ v) / mass.sum()
    x = _orthonormal(flat(x), mass)
    step = None
    for _ in range(rounds):
        lx = g.laplacian(x)
        values, turn = np.linalg.eigh(x.T @ lx)
        x, lx = x @ turn, lx @ turn
        rest = lx - mass[:, None] * x * values
        off = np.sqrt((rest * rest / mass[:, None]).sum(axis=0))
        if (off <= tolerance * values[-1]).all():
            return values, x
        new = flat(level.solve(rest))
        new = new - x @ (x.T @ (mass[:, None] * new))
        basis = new if step is None else np.hstack([new, step - x @ (x.T @ (mass[:, None] * step))])
        basis = _orthonormal(basis, mass)
        basis = _orthonormal(basis - x @ (x.T @ (mass[:, None] * basis)), mass)
        whole = np.hstack([x, basis])
        small = whole.T @ g.laplacian(whole)
        turn = np.linalg.eigh((small + small.T) / 2)[1][:, :k]
        step = basis @ turn[x.shape[1] :]
        x = flat(x @ turn[: x.shape[1]] + step)
        x = _orthonormal(x, mass)
    raise ValueError(f"the spectrum of a graph of {g.n} nodes did not settle in {rounds} rounds")


def smallest_eigenpairs(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, take: int, tolerance: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """The ``take`` smallest eigenpairs of the normalised Laplacian of the larger weights of both directions.

    The null vectors are those of the components, the largest first; of equal eigenvalues any basis is as good.
    """
    there = (src != dst) & (w > 0)
    i, j, w = np.minimum(src, dst)[there], np.maximum(src, dst)[there], w[there]
    order = np.lexsort((-w, i * n + j))
    i, j, w = i[order], j[order], w[order]
    first = np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])][: len(i)]
    i, j, w = i[first], j[first], w[first]
    mass = np.bincount(i, w, minlength=n) + np.bincount(j, w, minlength=n)
    alone = mass <= 1e-8
    mass[alone] = mass[alone] + 1e-3
    part = np.unique(components(n, i, j), return_inverse=True)[1]
    sizes = np.bincount(part)
    order = np.argsort(-sizes, kind="stable")
    out = []
    for c in order[:take]:
        v = np.where(part == c, np.sqrt(mass), 0.0)
        out.append((0.0, v / np.linalg.norm(v)))
    if len(sizes) < take:
        for c in order:
            nodes = np.flatnonzero(part == c)
            more = min(take - len(sizes), len(nodes) - 1)
            if more < 1:
                continue
            own = part[i] == c
            g = Graph(len(nodes), np.searchsorted(nodes, i[own]), np.searchsorted(nodes, j[own]), w[own])
            values, x = Level(g).eigenpairs(more, tolerance)
            for k in range(len(values)):
                v = np.zeros(n)
                v[nodes] = x[:, k] * np.sqrt(g.mass)
                out.append((values[k], v / np.linalg.norm(v)))
    out.sort(key=lambda p: p[0])
    return np.array([v for v, _ in out[:take]]), np.stack([v for _, v in out[:take]], axis=1)
