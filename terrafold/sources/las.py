"""A Spark data source for uncompressed LAS 1.2-1.4 tiles (point formats 0-3 and 6-8).

``spark.dataSource.register(LasSource)``; compressed LAZ needs a codec that is not part of this engine.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Byte offsets of colour and classification by point format.
COLOR_AT = {2: 20, 3: 28, 7: 30, 8: 30}
CLASS_AT = {0: 15, 1: 15, 2: 15, 3: 15, 6: 16, 7: 16, 8: 16}


def parse_header(raw: bytes) -> dict:
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor, kind = raw[25], raw[104] & 0x3F
    if raw[104] & 0x80:
        raise ValueError("compressed LAZ is not supported")
    offset, length = struct.unpack_from("<I", raw, 96)[0], struct.unpack_from("<H", raw, 105)[0]
    n = struct.unpack_from("<I", raw, 107)[0]
    if minor >= 4 and n == 0:
        n = struct.unpack_from("<Q", raw, 247)[0]
    return {"offset": offset, "length": length, "kind": kind, "n": n, "scale": struct.unpack_from("<3d", raw, 131), "shift": struct.unpack_from("<3d", raw, 155)}


class Tile(InputPartition):
    def __init__(self, uri: str, first: int, last: int) -> None:
        self.uri, self.first, self.last = uri, first, last


class LasReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.uris = [u for u in options["path"].split(",") if u]
        self.rows = int(options.get("rowsPerPartition", 2_000_000))

    def partitions(self) -> list[Tile]:
        out = []
        for uri in self.uris:
            store, path = pafs.FileSystem.from_uri(uri)
            with store.open_input_file(path) as f:
                n = parse_header(f.read(375))["n"]
            out += [Tile(uri, lo, min(n, lo + self.rows)) for lo in range(0, n, self.rows)]
        return out

    def read(self, tile: Tile) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(tile.uri)
        with store.open_input_file(path) as f:
            h = parse_header(f.read(375))
            for lo in range(tile.first, tile.last, 200_000):
                n = min(tile.last, lo + 200_000) - lo
                raw = np.frombuffer(f.read_at(n * h["length"], h["offset"] + lo * h["length"]), dtype=np.uint8).reshape(n, h["length"])
                at = lambda i, kind, size: raw[:, i : i + size].copy().view(kind)[:, 0]  # noqa: B023, E731
                xyz = {c: at(4 * i, "<i4", 4) * h["scale"][i] + h["shift"][i] for i, c in enumerate("xyz")}
                color = {c: (np.clip(np.rint(at(COLOR_AT[h["kind"]] + 2 * i, "<u2", 2) / 256), 0, 255).astype(np.int32) if h["kind"] in COLOR_AT else np.zeros(n, np.int32)) for i, c in enumerate("rgb")}
                kind = raw[:, CLASS_AT[h["kind"]]].astype(np.int32) & (0x1F if h["kind"] < 6 else 0xFF)
                yield pa.record_batch({"path": pa.array([tile.uri] * n), "point_id": pa.array(np.arange(lo, lo + n)), **{c: pa.array(v) for c, v in xyz.items()}, **{c: pa.array(v) for c, v in color.items()}, "label": pa.array(kind), "intensity": pa.array(at(12, "<u2", 2).astype(np.float64))})


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return "path string, point_id bigint, x double, y double, z double, r int, g int, b int, label int, intensity double"

    def reader(self, schema) -> LasReader:
        return LasReader(self.options)


def resolve(files: list[str]) -> list[str]:
    """Tiles in the order validation, training, test, LAZ before LAS within each."""
    rank = lambda p: (next((i for i, k in enumerate(("val", "train", "test")) if k in p.lower()), 3), not p.lower().endswith(".laz"), p)
    return sorted((f for f in files if f.lower().endswith((".las", ".laz"))), key=rank)
