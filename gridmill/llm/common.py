"""What the operators share: table reading, tables between steps and the held-out fold."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridmill.sources.shared import scratch



#: Rows of whole texts that an operator takes, and gives back, at once.
SLICE = 512


def per_batch(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run) in slices of SLICE rows.

    Spark bounds a batch by rows and bytes (spark.sql.execution.arrow.*, left as they are); the
    slices keep what operators make of it small.

    At its end a task gives the memory that it has freed back to the machine, as the worker lives on
    and the next stage's tasks in others need it."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE))
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    # the columns are met by their place, whatever their names
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(tidy, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark from whatever store `sf_dir` names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learned from: crc32 of the id as text, mod 5, is 0.

    A null id has no fold and counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def named(columns: list[str]) -> list[Column]:
    """The columns by their names as they are, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def private(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes to be none of df's columns."""
    taken, mark = {c.lower() for c in df.columns}, "_"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]
