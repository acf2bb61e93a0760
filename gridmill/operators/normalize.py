"""Per-point normalisation of fields: fit, encode, decode and stored statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType

from gridmill.functions.blocks import listed, stacked
from gridmill.functions.exact import Moments

EPS = 1e-5


def fit_points(df: DataFrame, values: str, *group: str) -> DataFrame:
    """(group, pos, n, mean, std): statistics over samples by point, as a row a point.

    std has one degree of freedom less than samples and is null for a single one."""
    points = df.select(*group, F.posexplode(values).alias("pos", "x"))
    return points.groupBy(*group, "pos").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))


def moments(df: DataFrame, values: str, *group: str) -> DataFrame:
    """The same as arrays, without a row a point: (group, n, mean[], std[]).

    Each task keeps exact sums for a group; those few rows are merged in a tree over tasks and rounded
    once, so the statistics have the same bits whatever the order of rows and the number of tasks. A
    point with an infinite or undefined number has an undefined deviation. Fields are arrays or packed;
    null ones are left out; under two samples are an error."""
    keys = list(group)

    def named(b: pa.RecordBatch) -> list[tuple]:
        return list(zip(*(b.column(k).to_pylist() for k in range(len(keys))), strict=True)) if keys else [()] * b.num_rows

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        for b in batches:
            names, column = named(b), b.column(len(keys))
            places: dict[tuple, list[int]] = {}
            for i, (key, there) in enumerate(zip(names, column.is_valid().to_pylist(), strict=True)):
                if there:
                    places.setdefault(key, []).append(i)
            for key, at in places.items():
                mine = column if len(at) == len(column) else column.take(pa.array(at))
                size = len(mine[0].as_buffer()) // 8 if pa.types.is_binary(mine.type) else len(mine[0])
                held.setdefault(key, Moments(size)).add(stacked(mine, (size,)))
        yield from sent(held)

    def sent(held: dict[tuple, Moments]) -> Iterator[pa.RecordBatch]:
        for key, m in held.items():
            n, names, data = m.dump()
            own = [pa.array([k], kind) for k, kind in zip(key, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([n], pa.int64()), pa.array([m.x.columns], pa.int32()), pa.array([names], pa.list_(pa.int32())), pa.array([data], pa.binary())], [*keys, "n", "size", "names", "data"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> dict[tuple, Moments]:
        held: dict[tuple, Moments] = {}
        for b in batches:
            for key, *state in zip(named(b), *(b.column(len(keys) + i).to_pylist() for i in range(4)), strict=True):
                n, size, names, data = state
                new = Moments.load(n, names, data, size)
                if key not in held:
                    held[key] = new
                elif held[key].x.columns != size:
                    raise ValueError(f"fields of {sorted({held[key].x.columns, size})} values in one group")
                else:
                    held[key].merge(new)
        return held

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sent(gathered(batches))

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, m in gathered(batches).items():
            mean, std = m.mean_and_std()
            own = [pa.array([k], kind) for k, kind in zip(key, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([m.n], pa.int64()), listed(mean[None]), pa.array([std if std is None else std.tolist()], pa.list_(pa.float64()))], [*keys, "n", "mean", "std"])

    x = F.col(values)
    source = df.select(*keys, (x if df.select(x).schema[0].dataType == BinaryType() else x.cast("array<double>")).alias("x"))
    kinds = [to_arrow_type(source.schema[k].dataType) for k in keys]
    head = "".join(f"`{k}` {source.schema[k].dataType.simpleString()}, " for k in keys)
    kind = head + "n long, size int, names array<int>, data binary"
    rows = source.mapInArrow(part, kind)
    # a tree over tasks: each level meets an eighth of the rows in as many tasks, one row at a time
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 8:
        parts //= 8
        rows = rows.repartition(parts).mapInArrow(merged, kind)
    rows = (rows.repartition(*keys) if keys else rows.repartition(1)).mapInArrow(done, head + "n long, mean array<double>, std array<double>")
    return rows.select(*keys, "n", "mean", F.when(F.col("n") > 1, F.col("std")).otherwise(F.raise_error("a fit needs two samples at least")).alias("std"))


def encode(values: Column | str, mean: Column | str, std: Column | str, eps: float = EPS) -> Column:
    """(x - mean) / (std + eps) at each point."""
    return F.zip_with(F.zip_with(values, mean, lambda x, m: x - m), std, lambda d, s: d / (s + eps))


def decode(values: Column | str, mean: Column | str, std: Column | str, eps: float = EPS) -> Column:
    """x * (std + eps) + mean at each point."""
    return F.zip_with(F.zip_with(values, std, lambda x, s: x * (s + eps)), mean, lambda d, m: d + m)


def split_pair(df: DataFrame, x: str = "x", y: str = "y") -> tuple[DataFrame, DataFrame]:
    """Both splits with inputs encoded by the training split's statistics, and the target's statistics.

    Targets stay as they are; their statistics are for decoding predictions."""
    train = df.where(F.col("split") == "train")
    stats = moments(train, x).select(F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    encoded = df.crossJoin(F.broadcast(stats)).withColumn(x, encode(x, "_mean", "_std")).drop("_mean", "_std")
    return encoded, moments(train, y)


def record(stats: DataFrame, shape: list[int], eps: float = EPS) -> DataFrame:
    """One-row record of fitted statistics."""
    return stats.select("mean", "std", F.array(*map(F.lit, shape)).alias("shape"), F.lit(eps).alias("eps"))


def loaded(records: DataFrame, shape: list[int] | None = None) -> DataFrame:
    """The record back, or an error if its lengths or its shape don't fit."""
    row = records.select("*", F.aggregate("shape", F.lit(1), lambda a, x: a * x.cast("int")).alias("points")).first()
    if not len(row["mean"]) == len(row["std"]) == row["points"] or shape is not None and list(row["shape"]) != list(shape):
        raise ValueError(f"statistics of shape {row['shape']} with {len(row['mean'])} means")
    return records


def encode_saved(test: DataFrame, records: DataFrame, shape: list[int], x: str = "x") -> DataFrame:
    """A test split encoded with stored statistics; the training split isn't read."""
    stats = loaded(records, shape).select(F.col("mean").alias("_mean"), F.col("std").alias("_std"), F.col("eps").alias("_eps"))
    rows = test.crossJoin(F.broadcast(stats))
    scaled = F.zip_with(F.zip_with(x, "_mean", lambda v, m: v - m), "_std", lambda d, s: d / (s + F.col("_eps")))
    return rows.withColumn(x, scaled).drop("_mean", "_std", "_eps")
