"""A Spark data source for binary PLY point maps with box predicates pushed into the scan.

``spark.dataSource.register(PlySource)``; ``spark.read.format("ply").option("path", uri).load()``.
Partitions are vertex ranges; comparisons of x, y and z with numbers are applied to each range's array
before rows are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

# The vertex record, little endian.
VERTEX = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")])


def parse_header(raw: bytes) -> tuple[int, int]:
    """(offset of the first vertex, number of vertices)."""
    end = raw.index(b"end_header")
    offset = raw.index(b"\n", end) + 1
    for line in raw[:end].decode("ascii").splitlines():
        if line.startswith("element vertex"):
            return offset, int(line.split()[2])
    raise ValueError("no vertex element")


class Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class PlyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.uri = options["path"]
        self.rows = int(options.get("rowsPerPartition", 2_000_000))
        self.bounds: list[tuple[str, str, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        signs = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in signs and f.attribute in (("x",), ("y",), ("z",)):
                self.bounds.append((f.attribute[0], signs[type(f)], float(f.value)))
            else:
                yield f

    def _open(self):
        store, path = pafs.FileSystem.from_uri(self.uri)
        return store.open_input_file(path)

    def partitions(self) -> list[Range]:
        with self._open() as f:
            _, n = parse_header(f.read(1 << 16))
        return [Range(lo, min(n, lo + self.rows)) for lo in range(0, n, self.rows)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with self._open() as f:
            offset, _ = parse_header(f.read(1 << 16))
            for lo in range(partition.first, partition.last, 200_000):
                n = min(partition.last, lo + 200_000) - lo
                v = np.frombuffer(f.read_at(n * VERTEX.itemsize, offset + lo * VERTEX.itemsize), dtype=VERTEX)
                keep = np.ones(n, dtype=bool)
                for axis, sign, value in self.bounds:
                    a = v[axis].astype(np.float64)
                    keep &= {">": a > value, ">=": a >= value, "<": a < value, "<=": a <= value}[sign]
                at = np.flatnonzero(keep)
                yield pa.record_batch({"point_id": pa.array(at + lo, pa.int64()), **{c: pa.array(v[c][at].astype(np.float64)) for c in "xyz"}, **{c[0]: pa.array(v[c][at].astype(np.int32)) for c in ("red", "green", "blue")}})


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return "point_id bigint, x double, y double, z double, r int, g int, b int"

    def reader(self, schema) -> PlyReader:
        return PlyReader(self.options)


def cropped(points, low: tuple[float, float, float], high: tuple[float, float, float], most: int):
    """Points inside a box; beyond ``most`` of them a keyed sample that every run repeats: the ``most`` smallest hashes.

    A threshold on the hash, with room for chance, leaves a little more than ``most`` points to be ordered.
    """
    from pyspark.sql import functions as F

    for a, lo, hi in zip("xyz", low, high, strict=True):
        points = points.where((F.col(a) >= lo) & (F.col(a) <= hi))
    n = points.count()
    if n <= most:
        return points
    key = F.xxhash64("point_id")
    share = (most + 8 * most**0.5 + 64) / n
    near = points.where(F.shiftrightunsigned(F.xxhash64("point_id", F.lit(1)), 33) < int(share * (1 << 31))) if share < 1 else points
    return near.orderBy(F.xxhash64("point_id", F.lit(1)), key, "point_id").limit(most)
