"""Training-order materialisation: a keyed Feistel permutation gives every sequence a global slot.

Texts become byte-pair ids and fixed-length sequences of ``SEQ_LEN`` ids (the end-of-text id of the
tokenizer's file closes a document and fills its last sequence). How many sequences a text gives is known
only once it is encoded, but never more than its bytes allow, so each input partition owns a range of
``sum(ceil((bytes + 1) / SEQ_LEN))`` numbers and counts its sequences from the range's start; the
cycle-walking permutation of all numbers scatters them. Each range of ``per_shard`` permuted numbers
is a shard: one task sorts its sequences and writes fixed-stride little-endian records (of two bytes an id, of four
where the vocabulary has more than 65,536). The global slot is the place in shards taken in order: numbers that no
sequence uses leave no gap, texts are encoded once, and sequences move in one shuffle. About 0.4 of the numbers are
used in prose, so a shard holds about 0.4 ``per_shard`` sequences; ``per_shard`` grows with the table from ``PER_SHARD``
to ``MOST_PER_SHARD`` (some 100 MB a file), so that files neither get tiny nor many.

A shard is written under a private name and renamed when complete, so one that is there is complete and is not
written again. The table ``_manifest`` below the root (shard, first slot, number of sequences) leads a reader to
any slot; from there it reads on sequentially.

Defined results: a null text counts as empty; an empty text has no sequence; a table
without sequences gives no shard. Rows that repeat a doc_id (or have none) are documents of
their own. Other columns are not read. The input must be a table (or a plan whose partitions do not change from run to run): a partition that outgrows its
range is an error.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import map_batches, whole
from ._store import stored
from ._words import chunks
from .bpe import codec
from .permute import feistel

SEQ_LEN, PER_SHARD, MOST_PER_SHARD, KEY = 512, 8192, 262_144, 20_240_601
#: Shards that a table has before they grow.
MANY_SHARDS, MOST_TASKS = 1024, 100_000
END = "<|endoftext|>"
MANIFEST = "_manifest"


def id_type(n: int) -> np.dtype:
    return np.dtype("<u2" if n <= 1 << 16 else "<u4")


def _sequences(path: str, pattern: str, end_token: str, seq_len: int, starts: dict[int, tuple[int, int]], n: int, per_shard: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        c = codec(path, pattern)
        end_id, kind = c.special[end_token], id_type(max(c.bytes_of) + 1)
        at, end = starts.get(TaskContext.get().partitionId(), (0, 0))
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in chunks(texts):
                rows, parts, used, records = [], [], [], []
                for i, t in enumerate(texts[lo:hi], lo):
                    if not t:
                        continue
                    ids = c.encode(t)
                    flat = np.full(-(-(len(ids) + 1) // seq_len) * seq_len, end_id, dtype=kind)
                    flat[: len(ids)] = ids
                    for p, r in enumerate(flat.reshape(-1, seq_len)):
                        rows.append(i)
                        parts.append(p)
                        used.append(min(seq_len, max(0, len(ids) - p * seq_len)))
                        records.append(r.tobytes())
                if at + len(rows) > end:
                    raise RuntimeError("the input's partitions changed between two runs")
                place = feistel(np.arange(at, at + len(rows)), n, key)
                at += len(rows)
                yield {"shard": place // per_shard, "place": place, "doc_id": b.column("doc_id").take(pa.array(rows, pa.int64())), "part": parts, "n_tokens": used, "record": records}

    return run


def _write(root: str):
    """Write the shards whose rows this task has, sorted by place; give one row per sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        store, base = pafs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        now, out, temp, count = -1, None, "", 0

        def close() -> None:
            if out is not None:
                out.close()
                store.move(temp, shard_path(base, now))

        for b in batches:
            shard, records = whole(b, "shard"), b.column("record").to_pylist()
            positions = np.zeros(len(shard), dtype=np.int64)
            for lo, hi in _runs(shard):
                if shard[lo] != now:
                    close()
                    now, out, count = int(shard[lo]), None, 0
                    if store.get_file_info(shard_path(base, now)).type == pafs.FileType.NotFound:
                        temp = f"{base}/.{uuid.uuid4().hex}"
                        out = store.open_output_stream(temp, compression=None)
                if out is not None:
                    out.write(b"".join(records[lo:hi]))
                positions[lo:hi] = np.arange(count, count + hi - lo)
                count += hi - lo
            yield {"shard": shard, "position": positions, "doc_id": b.column("doc_id"), "part": b.column("part"), "n_tokens": b.column("n_tokens"), "record_sha256": [hashlib.sha256(r).hexdigest() for r in records]}
        close()

    return run


def shard_path(base: str, shard: int) -> str:
    return f"{base}/shard-{shard:010d}.bin"


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(values)) + 1
    return list(zip([0, *cuts], [*cuts, len(values)], strict=True)) if len(values) else []


def materialise(docs: DataFrame, root: str, path: str, pattern: str, seq_len: int = SEQ_LEN, per_shard: int | None = None, key: int = KEY, end: str = END) -> DataFrame:
    """Write the shards of ``docs`` below ``root`` (a URI) and return one row per sequence.

    ``(slot, shard, position, doc_id, part, n_tokens, record_sha256)``: sequence ``slot`` is record ``position`` of its shard.
    """
    docs = docs.select("doc_id", "text")
    most = F.when(F.octet_length("text") > 0, F.ceil((F.octet_length("text") + 1) / seq_len)).otherwise(0)
    # one number per input partition
    ranges = docs.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(most).alias("n")).orderBy("p").collect()
    ends = np.cumsum([r["n"] for r in ranges]).tolist()
    starts = {r["p"]: (int(e - r["n"]), int(e)) for r, e in zip(ranges, ends, strict=True)}
    n = int(ends[-1]) if ends else 0
    per_shard = per_shard or min(MOST_PER_SHARD, max(PER_SHARD, -(-n // MANY_SHARDS)))
    rows = map_batches(docs, _sequences(path, pattern, end, seq_len, starts, n, per_shard, key), "shard bigint, place bigint, doc_id bigint, part bigint, n_tokens bigint, record binary")
    shards = max(1, -(-n // per_shard))
    placed = rows.repartition(min(shards, MOST_TASKS), "shard").sortWithinPartitions("shard", "place")
    done, _ = stored(map_batches(placed, _write(root), "shard bigint, position bigint, doc_id bigint, part bigint, n_tokens bigint, record_sha256 string"), "slots")
    counts = done.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    # a row a shard
    first = counts.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"), "n")
    first.coalesce(1).write.mode("overwrite").parquet(f"{root}/{MANIFEST}")
    first = done.sparkSession.read.schema(first.schema).parquet(f"{root}/{MANIFEST}")
    return done.join(first, "shard").select((F.col("first") + F.col("position")).alias("slot"), "shard", "position", "doc_id", "part", "n_tokens", "record_sha256")


def read_slots(root: str, first: int, last: int, seq_len: int = SEQ_LEN, kind: np.dtype = id_type(0)) -> Iterator[np.ndarray]:
    """Sequences of slots ``first..last-1``, read in order; a reader can stop and go on at any slot."""
    store, base = pafs.FileSystem.from_uri(root)
    stride = seq_len * kind.itemsize
    begin, n = pads.field("first"), pads.field("n")
    shards = pads.dataset(f"{base}/{MANIFEST}", filesystem=store, format="parquet").to_table(filter=(begin < last) & (begin + n > first))
    for row in sorted(shards.to_pylist(), key=lambda r: r["first"]):
        lo, hi = max(first, row["first"]), min(last, row["first"] + row["n"])
        with store.open_input_file(shard_path(base, row["shard"])) as f:
            raw = f.read_at((hi - lo) * stride, (lo - row["first"]) * stride)
        yield from np.frombuffer(raw, dtype=kind).reshape(-1, seq_len)
