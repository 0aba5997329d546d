"""WARC archives, each record compressed alone with a dictionary that the file carries.

A file starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard
dictionary, itself compressed; every record follows as a frame of its own, so a reader can start
at any record once it has the dictionary. The dictionary is trained once on the archived records
themselves (headers, revisits and all): a keyed sample of about ``SAMPLE_ROWS`` rows, the same ones in every
run, each record whole where it has at most ``SAMPLE_BYTES`` and else its head and its tail. That is the fit of
a model on a bounded sample; every record is archived whole.

Equal payloads of at least ``least`` bytes are archived once: the largest ``page_id`` is the
``response``, the others are ``revisit`` records that refer to it and carry no payload but its
length and digest. Only digests and ids meet by key, and the ids of repeated pages then join the pages by
``page_id``, so copies of one payload, however many, stay where they are. Files are written by the tasks through the cluster's shared store under private
names and renamed when complete, so a task that runs again replaces its own file.

Defined results: null html is an empty payload; rows that repeat a page_id with equal payloads have one type, a
response each where their id is the payload's largest; a null page_id is archived as
a response and never referred to unless all its equals are null too; an empty table writes no file and
reads back empty. Other columns than page_id, url and html are not read; a null url is an empty header.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import map_batches
from ._store import stored

MAGIC = 0x184D2A5D
LEVEL, DICT_BYTES = 3, 64 << 10
SAMPLE_ROWS, SAMPLE_BYTES = 1_500, 4 << 10
_DATE = "2024-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train(samples: list[bytes]) -> bytes:
    """A dictionary of at most DICT_BYTES; too few samples to train on serve as they are."""
    samples = [s for s in samples if s]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def dictionary_frame(raw: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=19).compress(raw)
    return struct.pack("<II", MAGIC, len(body)) + body


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit names its response and has an empty block."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload if kind == "response" else b""
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": _record_id(page_id),
        "WARC-Date": _DATE,
        "WARC-Target-URI": " ".join((url or "").split()),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest32(payload)}",
        "X-Payload-Length": str(len(payload)),
        "Content-Length": str(len(block)),
    }
    if kind == "revisit":
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = _record_id(refers_to)
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else int(page_id)}>"


def _page_id(text: str) -> int | None:
    number = text.rpartition(":")[2].rstrip(">")
    return int(number) if number else None


def read_archive(stream) -> Iterator[dict]:
    """Records of one archive, in order: headers (lower-case names) and payload, whose digest is checked."""
    lead = stream.read(8)
    dictionary = None
    if len(lead) == 8:
        magic, size = struct.unpack("<II", lead)
        if magic != MAGIC:
            raise ValueError("no dictionary frame at the start")
        raw = zstandard.ZstdDecompressor().decompress(stream.read(size))
        dictionary = _dictionary(raw)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(stream, read_across_frames=True) if dictionary else zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True)
    lines = io.BufferedReader(reader, 1 << 18)
    while version := lines.readline():
        if version != b"WARC/1.1\r\n":
            raise ValueError("not a WARC record")
        head = {}
        while (line := lines.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name.lower()] = value
        block = lines.read(int(head["content-length"]))
        if lines.read(4) != b"\r\n\r\n":
            raise ValueError("record without an end")
        payload = block.partition(b"\r\n\r\n")[2] if head["warc-type"] == "response" else None
        if payload is not None and f"sha1:{digest32(payload)}" != head["warc-payload-digest"]:
            raise ValueError(f"payload digest of {head['warc-record-id']} differs")
        yield {"head": head, "payload": payload}


def with_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """``(page_id, url, html, record_type, refers_to)``; of a payload's copies the largest page_id is the response."""
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    long = F.octet_length(F.coalesce("html", F.lit(""))) >= least
    # keys alone, once; both joins read tables, which adaptive execution splits where a digest or an id is hot
    keys, _ = stored(pages.where("page_id IS NOT NULL").where(long).select("page_id", digest.alias("digest")), "digests")
    repeated, _ = stored(keys.groupBy("digest").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1"), "repeated")
    # a page_id may repeat, with one payload or several
    revisits, _ = stored(keys.join(repeated.where("first <> last"), "digest").where("page_id <> last").select("page_id", "digest", "last").distinct(), "revisits")
    named = pages.select(F.col("page_id").alias("id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("own", F.sha1(F.col("html").cast("binary")))
    joined = named.join(revisits, (F.col("id") == F.col("page_id")) & (F.col("own") == F.col("digest")), "left")
    typed = joined.select(F.col("id").alias("page_id"), "url", "html", "own", "last")
    typed = typed.select("page_id", "url", "html", F.when(F.col("last").isNotNull(), "revisit").otherwise("response").alias("record_type"), F.col("last").alias("refers_to"))
    return typed


def _sampled(page_id: int | None, url: str | None, html: str, kind: str, refers: int | None) -> bytes:
    whole = record(kind, page_id, url, html.encode(), refers)
    return whole if len(whole) <= SAMPLE_BYTES else whole[: SAMPLE_BYTES // 2] + whole[-SAMPLE_BYTES // 2 :]


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield {"h": b.column("h"), "record": [_sampled(*r) for r in zip(*(b.column(c).to_pylist() for c in _COLUMNS), strict=True)]}


_COLUMNS = ("page_id", "url", "html", "record_type", "refers_to")


def write_archives(pages: DataFrame, root: str, least: int = 0) -> DataFrame:
    """Write ``pages`` as archives below ``root`` (a URI); one row (path, records, bytes) per file."""
    n = pages.count()
    typed = with_types(pages, least)
    h = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30))
    # about SAMPLE_ROWS rows of bounded length wherever they lie, by a hash threshold: the same ones in every run
    some = typed.where(h <= int((1 << 30) * SAMPLE_ROWS / max(n, 1)))
    rows = map_batches(some.withColumn("h", h), _samples, "h bigint, record binary").collect()
    raw = train([bytes(x) for _, x in sorted((r["h"], bytes(r["record"])) for r in rows)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        store, base = pafs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        dictionary = _dictionary(raw)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        task = TaskContext.get()
        temp, path = f"{base}/.part-{task.partitionId():06d}-{task.taskAttemptId()}", f"{base}/part-{task.partitionId():06d}.warc.zst"
        out, n, size = None, 0, 0
        for b in batches:
            for page_id, url, html, kind, refers in zip(*(b.column(c).to_pylist() for c in _COLUMNS), strict=True):
                if out is None:
                    out = store.open_output_stream(temp, compression=None)
                    out.write(dictionary_frame(raw))
                frame = packer.compress(record(kind, page_id, url, html.encode(), refers))
                out.write(frame)
                n, size = n + 1, size + len(frame)
        if out is not None:
            out.close()
            store.move(temp, path)
            yield {"path": [path], "records": [n], "bytes": [size]}

    return map_batches(typed, run, "path string, records bigint, bytes bigint")


def read_archives(spark, root: str, paths: DataFrame) -> DataFrame:
    """One row per record of the archives listed in ``paths(path)``, a task reads whole files as streams."""
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        store, _ = pafs.FileSystem.from_uri(root)
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None) as f:
                    for r in read_archive(f):
                        h = r["head"]
                        revisit = h["warc-type"] == "revisit"
                        rows.append((_page_id(h["warc-record-id"]), int(h["x-payload-length"]) if revisit else len(r["payload"]), h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], _page_id(h["warc-refers-to"]) if revisit else None))
                        if len(rows) >= 5_000:
                            yield dict(zip(names, zip(*rows, strict=True), strict=True))
                            rows = []
                if rows:
                    yield dict(zip(names, zip(*rows, strict=True), strict=True))

    return map_batches(paths.select("path"), run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
