"""Byte-level BPE encoding and decoding, exact for unsplit text of any length.

Texts are split by the tokenizer's own pattern; ordinary stretches go to the compiled
encoder. A piece that the pattern leaves longer than ``LONG`` characters (one "word" of
megabytes) is encoded as a tree: halves down to ``LONG`` characters alone, ``WORKERS`` of them at a time
in threads (the compiled encoder lets others run), then the text around each join is
encoded again in a growing window until the window's first token equals the left
side's token there and its last token the right side's. A token sequence is the
encoding of its text if every two neighbours are, so agreement at both seams is exact.

Ids equal the ``tokenizers`` library's for the same file, special tokens in texts
included, as its default has it.

Defined results: null text counts as empty and has no ids; equal rows have equal
results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._arrow import map_batches
from ._words import chunks

LONG, WORKERS = 4096, 2
FIRST_WINDOW = 32


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in for each byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one byte-level BPE file in the tokenizers library's format."""

    def __init__(self, path: str, pattern: str, long: int = LONG) -> None:
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        alphabet = _byte_alphabet()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        merges = [ranks[bytes(alphabet[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(merges, merges[1:], strict=False)):
            raise ValueError("merge order and ids differ: this file can't be encoded by rank")
        self.long, self.pattern = long, regex.compile(pattern)
        self.core = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        # takes any text for one piece
        self.piece = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        self._allowed = set(self.special)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._run = regex.compile(r"\S{%d}|\s{%d}" % (long, long))

    def encode(self, text: str) -> list[int]:
        if len(text) < self.long or not self._run.search(text):
            return self.core.encode(text, allowed_special=self._allowed, disallowed_special=())
        ids: list[int] = []
        for part in self._cut.split(text) if self._cut else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids += self._pieces(part)
        return ids

    def _pieces(self, text: str) -> list[int]:
        """The pattern's pieces, those of at least ``long`` characters by tree."""
        ids: list[int] = []
        for m in self.pattern.finditer(text):
            ids += self.tree(m[0]) if m.end() - m.start() >= self.long else self._merge(m[0])
        return ids

    def _merge(self, piece: str) -> list[int]:
        """BPE of one piece, no splitting."""
        return self.piece.encode_ordinary(piece)

    def tree(self, piece: str, leaf: int = LONG, workers: int = WORKERS) -> list[int]:
        """Encode ``piece`` by halves, several at a time: first the leaves, then level by level their joins."""

        def levels(run: Callable) -> list[int]:
            done = list(run(self._merge, [piece[a : a + leaf] for a in range(0, len(piece), leaf)]))
            while len(done) > 1:
                done = list(run(lambda pair: self.join(*pair) if len(pair) > 1 else pair[0], [done[i : i + 2] for i in range(0, len(done), 2)]))
            return done[0] if done else []

        if workers > 1 and len(piece) > leaf:
            with ThreadPoolExecutor(workers) as pool:
                return levels(pool.map)
        return levels(map)

    def _inside(self, token: int) -> bool:
        """Whether a token begins within a character."""
        return self.bytes_of[token][0] & 0xC0 == 0x80

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenated texts of two encodings."""
        take = FIRST_WINDOW
        while True:
            # a window is text: its ends lie between characters
            i, j = max(0, len(left) - take), min(len(right), take)
            while i > 0 and self._inside(left[i]):
                i -= 1
            while j < len(right) and self._inside(right[j]):
                j += 1
            window = self._merge(b"".join(self.bytes_of[t] for t in [*left[i:], *right[:j]]).decode())
            left_agrees = i == 0 or window[0] == left[i]
            right_agrees = j == len(right) or window[-1] == right[j - 1]
            if left_agrees and right_agrees:
                return left[:i] + window + right[j:]
            take *= 2

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str, pattern: str, long: int = LONG) -> Codec:
    """One codec per Python worker and file."""
    return Codec(path, pattern, long)


def _encoded(docs: DataFrame, ddl: str, columns: Callable, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``columns(codec, texts)`` of every row, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        c = codec(path, pattern)
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in chunks(texts):  # ids of about half a million characters at a time
                yield {"doc_id": b.column("doc_id").slice(lo, hi - lo)} | columns(c, [t or "" for t in texts[lo:hi]])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id bigint, {ddl}")


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)`` of every text."""
    return _encoded(docs, "ids array<int>", lambda c, texts: {"ids": [np.array(c.encode(t), dtype=np.int32) for t in texts]}, path, pattern)


def _digests(c: Codec, texts: list[str]) -> dict:
    ids = [c.encode(t) for t in texts]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {"n_tokens": [len(x) for x in ids], "ids_sha256": [sha(",".join(map(str, x))) for x in ids], "decoded_sha256": [sha(c.decode(x)) for x in ids]}


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encoded, then decoded from the ids alone."""
    return _encoded(docs, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digests, path, pattern)
