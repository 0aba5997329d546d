"""Arrow batches through Python functions: integers keep all 64 bits, beside nulls too."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ._words import tidy


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], ddl: str) -> DataFrame:
    """``df.mapInArrow`` of a function that gives dicts of columns (Arrow arrays, numpy arrays or lists)."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(tidy(batches)):
            yield pa.RecordBatch.from_arrays([_array(columns[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(rows, ddl)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def map_texts(df: DataFrame, column: str, change: Callable[[list[str | None]], list[str | None]]) -> DataFrame:
    """``df`` with the strings of ``column`` replaced; every other column goes through untouched."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidy(batches):
            at = b.schema.get_field_index(column)
            yield b.set_column(at, b.schema.field(at), pa.array(change(b.column(at).to_pylist()), type=b.schema.field(at).type))

    return df.mapInArrow(rows, df.schema)


def filter_texts(df: DataFrame, column: str, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of ``df`` whose ``column`` passes, as they are."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidy(batches):
            yield b.filter(pa.array(keep(b.column(b.schema.get_field_index(column)).to_pylist()), type=pa.bool_()))

    return df.mapInArrow(rows, df.schema)


def whole(b: pa.RecordBatch, name: str) -> np.ndarray:
    """A column without nulls as numpy."""
    return b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
