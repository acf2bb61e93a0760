"""One-off ingest of level-5 MAT files to field tables.

Only plain numeric arrays are read; columns-first data is laid out row by row."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridmill.functions.blocks import listed
from gridmill.sources.npz import FieldError
from gridmill.sources.store import found, opened

# Element and class codes of the format that hold real numbers of up to 32 bits.
ELEMENTS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8"}
CLASSES = {6: "double", 7: "single", 8: "int8", 9: "uint8", 10: "int16", 11: "uint16", 12: "int32", 13: "uint32"}
MATRIX, COMPRESSED, COMPLEX = 14, 15, 0x0800


def _elements(raw: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from(order + "II", raw, at)
        if kind >> 16:  # type and size share a word, the data follows in the next
            yield kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, raw[at + 8 : at + 8 + size]
            at += 8 + (size if kind == COMPRESSED else -(-size // 8) * 8)


def arrays(path: str, names: list[str] | None = None) -> Iterator[tuple[str, np.ndarray]]:
    """(name, array) of each variable, or of the named ones; a kind that can't be read is an error when it is met."""
    store, at = opened(path)
    try:
        with store.open_input_file(at) as f:
            raw = f.read()
    except FileNotFoundError as e:
        raise FieldError(f"no file {path}") from e
    order = {b"IM": "<", b"MI": ">"}.get(raw[126:128])
    if order is None:
        raise FieldError(f"{path} is no level-5 MAT file")
    for kind, data in _elements(raw[128:], order):
        if kind == COMPRESSED:
            kind, data = next(_elements(zlib.decompress(data), order))
        if kind != MATRIX:
            continue
        parts = list(_elements(data, order))
        flags = struct.unpack(order + "I", parts[0][1][:4])[0]
        shape, name = np.frombuffer(parts[1][1], order + "i4"), parts[2][1].decode()
        if names is not None and name not in names:
            continue
        if flags & 0xFF not in CLASSES or flags & COMPLEX or parts[3][0] not in ELEMENTS:
            raise FieldError(f"variable {name} of {path} is no real array of up to 32-bit integers or floats")
        yield name, np.frombuffer(parts[3][1], order + ELEMENTS[parts[3][0]]).astype(float).reshape(shape, order="F")


def field(path: str, name: str) -> np.ndarray:
    for found, a in arrays(path):
        if found == name:
            return a
    raise FieldError(f"{path} has no field {name}")


def ingest(spark: SparkSession, paths: list[str], fields: list[str], out: str) -> DataFrame:
    """Writes the named fields of files, or of all .mat files in folders, as Parquet, a row a sample.

    One task reads a file, whose variables it holds one after the other: the format's numbers lie by
    columns, so a sample's are spread over all of a variable. Paths are those of a store that tasks open."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                data = {}
                for name, a in arrays(path, fields):
                    data.setdefault(name, np.ascontiguousarray(a))
                if missing := [f for f in fields if f not in data]:
                    raise FieldError(f"{path} has no field {missing[0]}")
                if len({len(a) for a in data.values()}) != 1:
                    raise FieldError(f"fields of {path} with different numbers of samples")
                first = data[fields[0]]
                for at in range(0, len(first), 64):
                    n = len(first[at : at + 64])
                    columns = [pa.array([path] * n), pa.array(range(at, at + n), pa.int64()), pa.array([list(first.shape[1:])] * n, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*columns, *(listed(data[f][at : at + n].reshape(n, -1)) for f in fields)], ["path", "sample", "shape", *fields])

    kind = "path string, sample long, shape array<int>, " + ", ".join(f"`{f}` array<double>" for f in fields)
    every = [f for p in paths for f in (found(p, ".mat") or [p])]
    files = spark.createDataFrame([(p,) for p in every], "path string").repartition(len(every))
    files.mapInArrow(rows, kind).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)
