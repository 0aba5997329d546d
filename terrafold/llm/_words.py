"""Vectorised words and 64-bit hashes over UTF-8 bytes (numpy, no loop per word).

Words are maximal runs of bytes other than space and 0x09-0x0D; these bytes never
occur inside a multi-byte UTF-8 character, so byte runs equal code point runs.

A word's hash chains its 8-byte blocks through a mixer between any two of them, words beyond
``LONG`` bytes have an XXH3 hash; neither is a polynomial, so no family of words (Thue-Morse
words, say) collides for every base. Runs of words are polynomials over these hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: The C library's way to give free memory back, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
SEPARATORS = b" \t\n\x0b\x0c\r"
_IS_SEPARATOR = np.zeros(256, dtype=bool)
_IS_SEPARATOR[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPAN = 0xD1342543DE82EF95 | 1
#: Bytes of a word from which it is hashed whole.
LONG = 64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def is_separator(raw: np.ndarray) -> np.ndarray:
    """Which bytes stand between words."""
    return _IS_SEPARATOR[raw]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (wraps silently)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base**i, base**-i) modulo 2**64 for i <= n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        inverse = pow(base, -1, 1 << 64)
        have = tuple(np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size, b, dtype=np.uint64)])) for b in (base, inverse))
        _POWERS[base] = have
    return have[0], have[1]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of ``values[start:end]`` for every pair, from prefix sums modulo 2**64."""
    up, down = _powers(base, len(values))
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * down[starts]


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every word."""
    size = end - start
    padded = np.zeros(len(raw) + LONG + 8, dtype=np.uint8)
    padded[: len(raw)] = raw
    blocks = np.ndarray((len(raw) + LONG,), dtype="<u8", buffer=padded, strides=(1,))
    out = mix64(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    todo = np.flatnonzero(size <= LONG)
    done = 0
    while len(todo):
        left = size[todo] - done
        full = blocks[start[todo] + done] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.minimum(left, 8).astype(np.uint64) * np.uint64(8)))
        out[todo] = mix64((out[todo] ^ full) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(done + 1))
        done += 8
        todo = todo[left > 8]
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].tobytes())
    return out


@dataclass
class Words:
    """Words of a chunk of texts: ``doc`` indexes the chunk's rows, spans are bytes of ``buffer``."""

    buffer: bytes
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each document's first word; one more at the end


def words_of(texts: Sequence[str | None], lower: bool = False) -> Words:
    """All words of ``texts``, in order; a null text has none."""
    parts = [("" if t is None else t).encode("utf-8", "replace") for t in texts]
    buffer = b"\n".join(parts)
    raw = np.frombuffer(buffer, dtype=np.uint8)
    if lower:
        raw = _LOWER[raw]
    apart = np.ones(len(raw) + 2, dtype=np.int8)
    apart[1:-1] = _IS_SEPARATOR[raw]
    change = np.diff(apart)
    start, end = np.flatnonzero(change == -1), np.flatnonzero(change == 1)
    offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(parts)), np.diff(first))
    return Words(buffer, doc, start, end, word_hashes(raw, start, end), first)


def spans_of(hashes: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``length`` consecutive entries (runs may cross documents)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    values = mix64(hashes ^ np.uint64(salt)) if salt else hashes
    at = np.arange(n)
    return mix64(rolling(values, at, at + length, _SPAN) + np.uint64(length))


def tidy(batches: Iterator) -> Iterator:
    """The batches of a task; after each, memory that is free goes back to the system, so idle workers stay small."""
    for b in batches:
        yield b
        del b
        pa.default_memory_pool().release_unused()
        if _TRIM is not None:
            _TRIM(0)


def chunks(texts: Sequence[str | None], limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` characters; a longer text is a chunk of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n + 1
    if begin < len(texts):
        yield begin, len(texts)
