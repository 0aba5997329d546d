"""Keyed Feistel permutation of 0..n-1 with cycle-walking, vectorised."""

from __future__ import annotations

import numpy as np

from ._words import mix64

ROUNDS = 6


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where the keyed permutation of ``0..n-1`` sends each of ``x``.

    A balanced Feistel network permutes the smallest even-bit domain that holds ``n``; values that
    leave ``0..n-1`` walk their cycle on until they are back inside (under four steps on average).
    """
    half = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> shift, v & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (mix64(right + mix64(np.full(1, (key * 0x9E3779B97F4A7C15 + r + 1) & (1 << 64) - 1, dtype=np.uint64))) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)
