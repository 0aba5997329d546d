"""Tensors of .pt and .pth files without the library that wrote them.

The format is a ZIP archive: ``<name>/data.pkl`` describes the value, ``<name>/data/<key>`` holds each
storage's raw little-endian numbers. Only dense tensors and plain containers are built; a pickle that names
anything else is an error, so reading a file never runs code from it.
"""

from __future__ import annotations

import io
import pickle
import zipfile
from collections import OrderedDict

import numpy as np

# Storage classes and their number types.
STORAGES = {
    "FloatStorage": "<f4", "DoubleStorage": "<f8", "HalfStorage": "<f2", "LongStorage": "<i8", "IntStorage": "<i4",
    "ShortStorage": "<i2", "CharStorage": "i1", "ByteStorage": "u1", "BoolStorage": "?",
}


def _tensor(storage: np.ndarray, offset: int, size: tuple[int, ...], stride: tuple[int, ...], *_) -> np.ndarray:
    if any(s < 0 for s in (offset, *size, *stride)):
        raise ValueError("tensor outside its storage")
    last = offset + sum((n - 1) * s for n, s in zip(size, stride, strict=True)) if all(size) else offset - 1
    if last >= len(storage):
        raise ValueError("tensor outside its storage")
    item = storage.itemsize
    return np.lib.stride_tricks.as_strided(storage[offset:], size, tuple(s * item for s in stride)).copy() if all(size) else np.zeros(size, storage.dtype)


class _Reader(pickle.Unpickler):
    def __init__(self, raw: bytes, archive: zipfile.ZipFile, root: str) -> None:
        super().__init__(io.BytesIO(raw))
        self.archive, self.root = archive, root

    def find_class(self, module: str, name: str):
        if module == "torch._utils" and name in ("_rebuild_tensor_v2", "_rebuild_tensor"):
            return _tensor
        if module == "torch" and name in STORAGES:
            return name
        if (module, name) == ("collections", "OrderedDict"):
            return OrderedDict
        raise ValueError(f"not a plain tensor file: it names {module}.{name}")

    def persistent_load(self, key: tuple) -> np.ndarray:
        _, kind, name, _, n = key
        return np.frombuffer(self.archive.read(f"{self.root}/data/{name}"), dtype=STORAGES[kind], count=n)


def read_tensor(raw: bytes, key: str | None = None) -> np.ndarray:
    """The tensor of a file, or the one under ``key`` of a dict."""
    if not zipfile.is_zipfile(io.BytesIO(raw)):
        raise ValueError("not a tensor file")
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        index = next((n for n in archive.namelist() if n.endswith("/data.pkl")), None)
        if index is None:
            raise ValueError("not a tensor file")
        value = _Reader(archive.read(index), archive, index.removesuffix("/data.pkl")).load()
    if isinstance(value, dict):
        value = value[key]
    if not isinstance(value, np.ndarray):
        raise ValueError("not a tensor")
    return value
