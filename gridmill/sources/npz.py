"""Spark data source over NPZ archives: one row a sample, of one file or of all files in a folder.

    spark.dataSource.register(NpzSource)
    spark.read.format("npz").option("fields", "f,u").load("s3://bucket/sets")

Members that are stored without compression are read by ranges of samples, each by a task that seeks
to its bytes. A compressed member can't be entered in its middle, so the file of one is a single
task's, which unpacks it once, block by block; many files are read side by side. Paths are those of
a store that driver and tasks open alike."""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridmill.functions.blocks import listed
from gridmill.sources.store import found, opened


class FieldError(ValueError):
    """A file, member or type that the source can't give."""


#: Rows of a record batch, and bytes of one at most besides its first row.
ROWS, BYTES = 256, 32 << 20


def _header(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, order and type from the start of a member, of either version of the header."""
    version = np.lib.format.read_magic(f)
    return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)


class Archive:
    """An open archive of a store, to be closed by leaving its context."""

    def __init__(self, uri: str):
        store, self.path = opened(uri)
        try:
            self.file = store.open_input_file(self.path)
        except FileNotFoundError as e:
            raise FieldError(f"no file {self.path}") from e
        try:
            self.zip = zipfile.ZipFile(self.file)
        except zipfile.BadZipFile as e:
            raise FieldError(f"{self.path} is no archive") from e

    def __enter__(self) -> Archive:
        return self

    def __exit__(self, *_) -> None:
        self.zip.close()
        self.file.close()

    def member(self, name: str) -> tuple[tuple[int, ...], np.dtype, int | None]:
        """Shape, type and, if stored uncompressed, the file offset of a member's data."""
        if f"{name}.npy" not in self.zip.namelist():
            raise FieldError(f"{self.path} has no field {name}")
        info = self.zip.getinfo(f"{name}.npy")
        with self.zip.open(info) as f:
            shape, fortran, kind = _header(f)
            head = f.tell()
        if kind not in (np.dtype("<f8"), np.dtype("<f4")):
            raise FieldError(f"field {name} of {self.path} is {kind}, not single or double precision")
        if fortran:
            raise FieldError(f"field {name} of {self.path} is stored by columns")
        if not shape:
            raise FieldError(f"field {name} of {self.path} is a single number")
        if info.compress_type != zipfile.ZIP_STORED:
            return shape, kind, None
        self.file.seek(info.header_offset + 26)
        names, extra = struct.unpack("<HH", self.file.read(4))
        return shape, kind, info.header_offset + 30 + names + extra + head

    def blocks(self, name: str, start: int, stop: int, step: int) -> Iterator[np.ndarray]:
        """Samples start..stop of a member in double precision, a row each, in blocks of `step`.

        A compressed member is unpacked from its beginning, holding one block."""
        shape, kind, at = self.member(name)
        size = int(np.prod(shape[1:], dtype=np.int64))
        sizes = [min(step, stop - i) for i in range(start, stop, step)]
        as_rows = lambda raw, n: np.frombuffer(raw, kind).astype(float).reshape(n, size)
        if at is not None:
            for i, n in zip(range(start, stop, step), sizes, strict=True):
                self.file.seek(at + i * size * kind.itemsize)
                yield as_rows(self.file.read(n * size * kind.itemsize), n)
            return
        # a handle of its own, as members are unpacked side by side
        with self.zip.open(f"{name}.npy") as f:
            _header(f)
            left = start * size * kind.itemsize
            while left:
                left -= len(f.read(min(left, 1 << 22)))
            for n in sizes:
                yield as_rows(f.read(n * size * kind.itemsize), n)


def member(path: str, name: str) -> tuple[tuple[int, ...], np.dtype, int | None]:
    """Shape, type and, if stored uncompressed, the file offset of a member's data."""
    with Archive(path) as a:
        return a.member(name)


def rows(path: str, name: str, start: int, stop: int) -> np.ndarray:
    """Samples start..stop of a member, in double precision, a row each."""
    with Archive(path) as a:
        return next(a.blocks(name, start, stop, max(1, stop - start)), np.zeros((0, 1)))


class Range(InputPartition):
    def __init__(self, file: str, start: int, stop: int):
        super().__init__((file, start, stop))
        self.file, self.start, self.stop = file, start, stop


class NpzReader(DataSourceReader):
    def __init__(self, uri: str, fields: list[str], per: int):
        self.uri, self.fields, self.per = uri, fields, per

    def partitions(self) -> list[Range]:
        files = found(self.uri, ".npz")
        if not files:
            raise FieldError(f"no file {self.uri}")
        out = []
        for file in files:
            with Archive(file) as a:
                members = {f: a.member(f) for f in self.fields}
            counts = {f: m[0][0] for f, m in members.items()}
            if len({*counts.values()}) != 1:
                raise FieldError(f"fields of {file} with different numbers of samples: {counts}")
            total = next(iter(counts.values()))
            per = max(1, total) if any(m[2] is None for m in members.values()) else self.per
            out += [Range(file, i, min(total, i + per)) for i in range(0, total, per)]
        return out or [Range(files[0], 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with Archive(part.file) as a:
            shapes = [list(a.member(f)[0][1:]) for f in self.fields]
            size = max(1, max(int(np.prod(s, dtype=np.int64)) for s in shapes))
            step = max(1, min(ROWS, BYTES // (8 * size)))
            i = part.start
            for blocks in zip(*(a.blocks(f, part.start, part.stop, step) for f in self.fields), strict=True):
                n = len(blocks[0])
                columns = [pa.array([part.file] * n, pa.string()), pa.array(range(i, i + n), pa.int64()), pa.array([shapes[0]] * n, pa.list_(pa.int32())), *map(listed, blocks)]
                yield pa.RecordBatch.from_arrays(columns, ["file", "sample", "shape", *self.fields])
                i += n


class NpzSource(DataSource):
    """Options: path, of a file or a folder; fields, names joined by commas; rows, samples a partition (1024)."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def _fields(self) -> list[str]:
        return [x.strip() for x in self.options.get("fields", "f,u").split(",")]

    def schema(self) -> str:
        return "file string, sample long, shape array<int>, " + ", ".join(f"`{f}` array<double>" for f in self._fields())

    def reader(self, schema) -> NpzReader:
        return NpzReader(self.options["path"], self._fields(), int(self.options.get("rows", 1024)))
