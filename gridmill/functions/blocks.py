"""Fields of one shape as NumPy blocks inside vectorised functions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def stacked(values: pa.Array, shape: tuple[int, ...]) -> np.ndarray:
    """[rows, *shape] of the rows that aren't null, which hold that many numbers each, uncopied.

    Fields are lists of numbers, or packed: the bytes of their doubles."""
    there = values.drop_null() if values.null_count else values
    if pa.types.is_binary(there.type):
        ends = np.frombuffer(there.buffers()[1], np.int32)[there.offset : there.offset + len(there) + 1]
        sizes, width = np.diff(ends), 8
    else:
        sizes, width = np.diff(there.offsets.to_numpy()), 1
    wrong = sorted({*(sizes[sizes != width * math.prod(shape)] // width).tolist()})
    if wrong:
        raise ValueError(f"fields of {wrong} values where {' x '.join(map(str, shape))} are expected")
    if width == 8:
        data = there.buffers()[2] if len(there) else b""
        return np.frombuffer(data, np.float64, math.prod(shape) * len(there), int(ends[0]) if len(there) else 0).reshape(-1, *shape)
    flat = there.flatten()
    if flat.null_count:
        raise ValueError("a field with a null value")
    return flat.to_numpy().reshape(-1, *shape)


def packed(rows: np.ndarray, like: pa.Array | None = None) -> pa.Array:
    """Rows as the bytes of their doubles; null where `like` is, if given.

    A packed field goes between Spark and Python as one piece, where an array goes number by number."""
    flat = np.ascontiguousarray(rows, float).reshape(len(rows), -1)
    there = np.ones(len(flat), bool) if like is None or not like.null_count else like.is_valid().to_numpy(zero_copy_only=False)
    size = flat.shape[1] * 8 if len(flat) else 0
    if size * len(flat) >= 1 << 31:
        raise ValueError("more than 2 GB of fields in one batch")
    ends = np.concatenate([[0], np.cumsum(there)]).astype(np.int32) * np.int32(size)
    mask = pa.py_buffer(np.packbits(there, bitorder="little").tobytes())
    return pa.BinaryArray.from_buffers(pa.binary(), len(there), [mask, pa.py_buffer(ends), pa.py_buffer(flat.ravel())])


def listed(rows: np.ndarray, like: pa.Array | None = None) -> pa.Array:
    """Rows as an array of lists; null where `like` is, if given."""
    flat = np.ascontiguousarray(rows, float).reshape(len(rows), -1)
    size = flat.shape[1] if len(flat) else 0
    if like is None or not like.null_count:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * size), pa.array(flat.ravel()))
    there = like.is_valid().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(there)]).astype(np.int32) * size
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()), mask=pa.array(~there))


def numbers(x: np.ndarray, like: pa.Array) -> pa.Array:
    """A number a row; null where `like` is."""
    out = np.full(len(like), np.nan)
    there = like.is_valid().to_numpy(zero_copy_only=False)
    out[there] = x
    return pa.array(out, pa.float64(), mask=~there)


def mapped(col: Column | str, shape: tuple[int, int], f: Callable[[np.ndarray], np.ndarray], binary: bool = False) -> Column:
    """Column of f applied to whole batches of fields; a null field stays null. binary: gives packed fields."""

    @F.arrow_udf("binary" if binary else "array<double>")
    def run(values: pa.Array) -> pa.Array:
        a = stacked(values, shape)
        return (packed if binary else listed)(f(a) if len(a) else np.zeros((0, 1)), values)

    return run(col)


def both_sides(col: Column | str, shape: tuple[int, int], x: np.ndarray, y: np.ndarray, binary: bool = False) -> Column:
    """x @ field @ y.T of every field: a linear map along either axis."""
    return mapped(col, shape, lambda a: x @ a @ y.T, binary)


def pack(col: Column | str, shape: tuple[int, ...]) -> Column:
    """Array fields as packed ones."""
    return mapped(col, shape, lambda a: a, True)


def unpack(col: Column | str, shape: tuple[int, ...]) -> Column:
    """Packed fields as array ones."""
    return mapped(col, shape, lambda a: a)
