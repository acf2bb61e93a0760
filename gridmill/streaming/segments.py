"""A table of each run's latest epochs, kept up by small sorted segments that are merged in levels.

A batch adds one segment to level 0; FAN segments of a level are merged to one of the next, so a table
of n batches has about FAN * log(n) segments. Files of a segment hold ranges of runs, which the
manifest lists; one run is read from those files alone that may hold it. The manifest is replaced
whole after the data is there, so a segment that a crash has left behind is never seen, and a batch
that comes again is left out or writes the same segment once more."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridmill.sources import store

#: Segments of a level that are merged to one of the next.
FAN = 8
#: Rows of a file, about.
FILE_ROWS = 1 << 20


def latest(rows: DataFrame) -> DataFrame:
    """The later row of each (run, epoch); equal times go to the larger row."""
    rest = [c for c in rows.columns if c not in ("run", "epoch", "ts")]
    return rows.groupBy("run", "epoch").agg(F.max(F.struct("ts", *rest)).alias("r")).select("run", "epoch", *(f"r.{c}" for c in rest), "r.ts")


def manifest(path: str) -> dict:
    """What the table at a URI consists of: batch, schema, segments (level, folder, files with their ranges), dropped."""
    raw = store.read(f"{path}/manifest.json")
    return json.loads(raw) if raw else {"batch": -1, "schema": None, "segments": [], "dropped": []}


def _segment(rows: DataFrame, path: str, level: int, number: int) -> dict | None:
    """Writes a segment; None if it would be empty."""
    folder = f"{path}/segments/{level}-{number}"
    spark = rows.sparkSession
    size = rows.count()
    if not size:
        return None
    rows.repartitionByRange(max(1, -(-size // FILE_ROWS)), "run").sortWithinPartitions("run", "epoch").write.mode("overwrite").parquet(folder)
    # a row a file; a null run is in the range of any
    found = spark.read.schema(rows.schema).parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.min("run").alias("low"), F.max("run").alias("high"), F.count_if(F.col("run").isNull()).alias("none"))
    return {"level": level, "folder": folder, "files": [[r.name, r.low, r.high, r.none > 0] for r in found.collect()]}


def _files(spark: SparkSession, state: dict, segments: list[dict], run: object = None) -> list[str]:
    return [f"{s['folder']}/{name}" for s in segments for name, low, high, _ in s["files"] if run is None or low is not None and low <= run <= high]


def _read(spark: SparkSession, state: dict, segments: list[dict], run: object = None) -> DataFrame:
    schema = StructType.fromJson(state["schema"])
    files = _files(spark, state, segments, run)
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def add(batch: DataFrame, number: int, path: str) -> None:
    """Adds a batch of rows (run, epoch, ..., ts) to the table; one that was added before is left out."""
    state = manifest(path)
    if number <= state["batch"]:
        return
    spark, old = batch.sparkSession, state["dropped"]
    state["schema"] = state["schema"] or batch.schema.jsonValue()
    segments, dropped = state["segments"], []
    if new := _segment(latest(batch), path, 0, number):
        segments = [*segments, new]
    level = 0
    while len(mine := [s for s in segments if s["level"] == level]) >= FAN:
        merged = _segment(latest(_read(spark, state, mine)), path, level + 1, number)
        dropped += [s["folder"] for s in mine]
        segments = [s for s in segments if s["level"] != level] + [merged]
        level += 1
    # what was dropped before this batch may go: readers have had a batch's time to be done with it
    store.replace(f"{path}/manifest.json", json.dumps({"batch": number, "schema": state["schema"], "segments": segments, "dropped": dropped}).encode())
    for folder in old:
        store.remove(folder)


def table(spark: SparkSession, path: str, run: object = None) -> DataFrame:
    """The latest row of every (run, epoch) so far, or those of one run, from the files that may hold it."""
    state = manifest(path)
    if state["schema"] is None:
        raise ValueError(f"no table at {path}")
    rows = _read(spark, state, state["segments"], run)
    return latest(rows if run is None else rows.where(F.col("run") == run))
