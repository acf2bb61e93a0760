"""Epoch metrics of running experiments as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridmill.operators import tracking
from gridmill.streaming import segments
from gridmill.streaming.segments import latest

__all__ = ["SCHEMA", "KEYS", "epochs", "feed", "without_repeats", "new_runs", "totals", "latest", "keep_latest", "latest_table", "compact", "on_epoch"]

SCHEMA = "run string, epoch int, train_mse double, train_l2 double, test_l2 double, current_lr double, epoch_time_s double, ts timestamp"
KEYS = ("train_mse", "train_l2", "test_l2", "current_lr", "epoch_time_s")


def epochs(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_trigger: int = 16) -> DataFrame:
    """Rows of Parquet files as they are added under path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def feed(rows: DataFrame, *keys: str) -> DataFrame:
    """(run, key, step, value): the rows of the batch export, as epochs come in."""
    return tracking.metrics_long(rows, "epoch", *(keys or KEYS))


def without_repeats(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Drops exact repeats of an epoch that come within the given lateness."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run", "epoch", "ts"])


def new_runs(rows: DataFrame, known: DataFrame, late: str = "1 hour") -> DataFrame:
    """One create row for each run that isn't known yet."""
    fresh = rows.join(known.select("run"), "run", "left_anti")
    return fresh.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run"]).select("run", F.lit("create").alias("kind"))


def totals(rows: DataFrame) -> DataFrame:
    """Running totals of each run, for the update mode."""
    return rows.groupBy("run").agg(
        F.count("*").alias("epochs"), F.min("test_l2").alias("best"), F.max_by("test_l2", "epoch").alias("last"),
        F.sum("epoch_time_s").alias("seconds"),
    )


def keep_latest(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the later row of every (run, epoch) in a table of merged segments (streaming/segments.py).

    path: a folder or URI that driver and tasks open alike. A batch that is run twice counts once."""
    return rows.writeStream.foreachBatch(lambda batch, number: segments.add(batch, number, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_table(spark: SparkSession, path: str, run: object = None) -> DataFrame:
    """The table that keep_latest has written so far, or the rows of one run."""
    return segments.table(spark, path, run)


def compact(spark: SparkSession, path: str, into: str) -> DataFrame:
    """The table in a new folder of its own as one segment, in which later batches go on."""
    segments.add(latest_table(spark, path), segments.manifest(path)["batch"], into)
    return latest_table(spark, into)


def on_epoch(rows: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls `call` with each batch of epochs."""
    return rows.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
