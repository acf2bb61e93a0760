"""Streaming data source over metrics files that runs append to while they train.

    spark.dataSource.register(LiveLines)
    spark.readStream.format("live_lines").load("file:///runs")

Each trigger reads what has been added to any file since the last one. The offset has for each file
its size, a checksum of its last bytes and its time of change; a file whose bytes before the old
offset are no longer what they were (a resumed run drops epochs and goes on) is read anew. A line
belongs to the trigger that sees its end, so half a line waits, and a restarted query goes on where
its checkpoint says, in the middle of a file too.

Paths are opened through pyarrow's file systems, by tasks as by the driver, so they name a store that
all of them reach."""

from __future__ import annotations

import datetime
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from gridmill.sources.readers import METRICS, parsed_metrics
from gridmill.sources.store import opened

#: Bytes before an offset whose checksum tells whether a file was only appended to.
TAIL = 256
#: Bytes and files of one task at most; a larger addition to one file is split.
TASK_BYTES, TASK_FILES = 16 << 20, 256
#: Bytes looked back at once for the beginning of a line.
BACK = 1 << 12

_SCHEMA = "run string, file string, at long, value string, changed timestamp"


def _run(path: str) -> str:
    """Name of the folder that a file lies in; run=<name> gives the name."""
    folder = path.rsplit("/", 2)[-2] if path.count("/") else ""
    return unquote(folder[4:]) if folder.startswith("run=") else folder


def _at(f, start: int, size: int) -> bytes:
    f.seek(start)
    return f.read(size)


def _mark(f, size: int) -> int:
    """Checksum of the last bytes before an offset."""
    return zlib.crc32(_at(f, max(0, size - TAIL), min(size, TAIL)))


class Slice(InputPartition):
    """Additions to files: (path, from, to, time of change in ms)."""

    def __init__(self, parts: list[tuple[str, int, int, int]]):
        super().__init__(None)
        self.parts = parts


def lines(f, start: int, stop: int) -> Iterator[tuple[int, str]]:
    """(place, text) of the lines that end in start..stop of a file; its first line, a header, is left out."""
    back, size = b"", start
    while size and b"\n" not in back:
        step = min(BACK, size)
        size -= step
        back = _at(f, size, step) + back
    begin = size + back.rfind(b"\n") + 1 if b"\n" in back else 0
    text = _at(f, begin, stop - begin)
    end = text.rfind(b"\n") + 1
    at = begin
    for line in text[:end].split(b"\n")[:-1]:
        if at and line.rstrip(b"\r"):
            yield at, line.rstrip(b"\r").decode("utf-8", "replace")
        at += len(line) + 1


class LiveReader(DataSourceStreamReader):
    def __init__(self, root: str, name: str):
        self.root, self.name = root, name
        self.store, self.path = opened(root)
        self.last: dict[str, str] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        out = {}
        for info in self.store.get_file_info(fs.FileSelector(self.path, recursive=True, allow_not_found=True)):
            base = info.base_name
            if info.type != fs.FileType.File or base.startswith(("_", ".")) or not base.endswith(self.name):
                continue
            changed = (info.mtime_ns or 0) // 1_000_000
            was = self.last.get(info.path, "")
            if was.startswith(f"{info.size}:{changed}:"):
                out[info.path] = was
                continue
            with self.store.open_input_file(info.path) as f:
                out[info.path] = f"{info.size}:{changed}:{_mark(f, info.size)}"
        self.last = out
        return {"files": out}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        found = []
        for path, now in end["files"].items():
            size, changed, _ = map(int, now.split(":"))
            was = start["files"].get(path)
            old, old_mark = (int(was.split(":")[0]), int(was.split(":")[2])) if was else (0, 0)
            if was == now or not size:
                continue
            if old:
                with self.store.open_input_file(path) as f:
                    if old > size or _mark(f, old) != old_mark:
                        old = 0
            found += [(path, i, min(size, i + TASK_BYTES), changed) for i in range(old, size, TASK_BYTES)]
        out, held, total = [], [], 0
        for part in found:
            if held and (total + part[2] - part[1] > TASK_BYTES or len(held) == TASK_FILES):
                out.append(Slice(held))
                held, total = [], 0
            held.append(part)
            total += part[2] - part[1]
        return [*out, Slice(held)] if held else out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        for path, start, stop, changed in partition.parts:
            with self.store.open_input_file(path) as f:
                rows = list(lines(f, start, stop))
            when = datetime.datetime.fromtimestamp(changed / 1000, datetime.timezone.utc)
            n = len(rows)
            columns = [pa.array([_run(path)] * n, pa.string()), pa.array([path] * n, pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([when] * n, pa.timestamp("us", "UTC"))], ["run", "file", "at", "value", "changed"])

    def commit(self, end: dict) -> None:
        pass

    def __getstate__(self) -> dict:
        return {"root": self.root, "name": self.name}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["root"], state["name"])


class LiveLines(DataSource):
    """Options: path; name, how the files' names end (metrics.csv)."""

    @classmethod
    def name(cls) -> str:
        return "live_lines"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> LiveReader:
        return LiveReader(self.options["path"], self.options.get("name", "metrics.csv"))


def live_metrics(spark: SparkSession, path: str, name: str = "metrics.csv", keep_bad: bool = False) -> DataFrame:
    """(run, epoch, ..., ts) of metrics files as rows are appended to them; ts is when the file was last
    changed, so that epochs that a resumed run trains again come later than their first rows.

    A row that can't be read stops the query with an error that names its run and place; with keep_bad
    it is left out instead."""
    spark.dataSource.register(LiveLines)
    found = spark.readStream.format("live_lines").option("name", name).load(path)
    rows = parsed_metrics(found.withColumnRenamed("at", "line"), "changed")
    if keep_bad:
        return rows.where(~F.col("bad")).select("run", *METRICS, F.col("changed").alias("ts"))
    wrong = F.raise_error(F.format_string("byte %d of run %s: %s", "line", "run", "value")).cast("string")
    return rows.select(F.when(F.col("bad"), wrong).otherwise(F.col("run")).alias("run"), *METRICS, F.col("changed").alias("ts"))
