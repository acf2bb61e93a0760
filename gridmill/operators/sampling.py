"""Seeded subsets, batches and shards of samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from gridmill.functions import seeded
from gridmill.functions.shuffle import Permutation


def _numbers(spark: SparkSession, rows: list[int]) -> DataFrame:
    return spark.createDataFrame(pa.table({"sample": pa.array(rows, pa.int64())}))


def exact_subset(spark: SparkSession, population: int, n: int, seed: int) -> DataFrame:
    """(sample): the permutation rule's subset, in order.

    The rule draws one number after the other, so the driver makes the n row numbers (8 bytes each, and
    some 200 while they are drawn), whatever the population; hashed_subset() has no such part."""
    return _numbers(spark, seeded.subset(population, n, seed))


def subset_record(population: int, n: int, seed: int) -> dict:
    """What a run stores of its subset."""
    return {"seed": seed, "population": population, "hash": seeded.fingerprint(seeded.subset(population, n, seed))}


def verified_subset(spark: SparkSession, record: dict, n: int, available: int) -> DataFrame:
    """The stored subset again, or an error if it isn't what the record says."""
    if record["population"] > available:
        raise ValueError(f"a population of {record['population']} of {available} samples")
    rows = seeded.subset(record["population"], n, record["seed"])
    if (got := seeded.fingerprint(rows)) != record["hash"]:
        raise ValueError(f"the subset's hash is {got}, not {record['hash']}")
    return _numbers(spark, rows)


def fingerprints(rows: DataFrame, number: str, *group: str) -> DataFrame:
    """(group, n, hash): the fingerprint of each group's row numbers in ascending order.

    Rows are range-partitioned by group and number. Each part leaves one block for a group, a map of the
    hash before its numbers to that after, and a group's blocks are joined in order, 2 KB each; so a
    group of any size is spread over all tasks. Null numbers are left out; a null key is a key of its
    own; repeated numbers count as often as they come."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*group, "number", "read"]
    source = rows.where(F.col(number).isNotNull()).select(*group, F.col(number).cast("long").alias("number"), F.monotonically_increasing_id().alias("read"))
    ordered = source.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("read")
    kinds = [to_arrow_type(source.schema[g].dataType) for g in group]
    keys = StructType([source.schema[g] for g in group])
    schema = StructType([*keys.fields, StructField("part", LongType()), StructField("n", LongType()), StructField("after", BinaryType())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        """(key, rows of it that follow each other)."""
        for b in batches:
            names = list(zip(*(b.column(i).to_pylist() for i in range(len(group))), strict=True)) if group else [()] * b.num_rows
            start = 0
            for i in range(1, b.num_rows + 1):
                if i == b.num_rows or names[i] != names[start]:
                    yield names[start], b.slice(start, i - start)
                    start = i

    def emitted(key: tuple, part: int, held: seeded.Fnv, last: bool) -> pa.RecordBatch:
        own = [pa.array([k], t) for k, t in zip(key, kinds, strict=True)]
        rest = [pa.array([held.size // 8], pa.int64()), pa.array([held.digest()], pa.string())] if last else [pa.array([part], pa.int64()), pa.array([held.size // 8], pa.int64()), pa.array([held.after.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays([*own, *rest], [*group, *(("n", "hash") if last else ("part", "n", "after"))])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, held = TaskContext.get().partitionId(), None, None
        for key, b in runs(batches):
            new = seeded.Fnv.of(b.column(len(group)).to_numpy())
            if held is not None and key != now:
                yield emitted(now, part, held, False)
                held = None
            now, held = key, new if held is None else held.then(new)
        if held is not None:
            yield emitted(now, part, held, False)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for key, b in runs(batches):
            if held is not None and key != now:
                yield emitted(now, 0, held, True)
                held = None
            now = key
            for n, after in zip(b.column(len(group) + 1).to_pylist(), b.column(len(group) + 2).to_pylist(), strict=True):
                new = seeded.Fnv(8 * n, np.frombuffer(after, np.uint64))
                held = new if held is None else held.then(new)
        if held is not None:
            yield emitted(now, 0, held, True)

    made = ordered.mapInArrow(blocks, schema)
    made = made.repartition(*(group or [F.lit(0)])).sortWithinPartitions(*group, "part")
    return made.mapInArrow(joined, StructType([*keys.fields, StructField("n", LongType()), StructField("hash", StringType())]))


def chosen(df: DataFrame, rows: DataFrame) -> DataFrame:
    """The chosen rows in file order; `rows` holds row numbers alone and is far smaller than df."""
    return df.join(rows, "sample", "left_semi").orderBy("sample")


def rank_key(*parts: Column | str) -> Column:
    """Key of the scalable seeded order: it depends on the seed and the row alone."""
    return F.xxhash64(*parts)


def hashed_subset(samples: DataFrame, n: int, seed: int) -> DataFrame:
    """n samples by the order of their seeded hash; smaller subsets lie in larger ones.

    Only the ids are ordered, and only n rows of each task are kept."""
    return samples.select("sample").orderBy(rank_key(F.lit(seed), "sample"), "sample").limit(n)


def batches(samples: DataFrame, epochs: int, size: int, seed: int, shuffle: bool = True) -> DataFrame:
    """(epoch, batch, place, sample): batches of each epoch in its own seeded order.

    Samples are numbered once by their ids, by the counts of ranges, so no task holds them all; their
    place in each epoch follows from the number by arithmetic (functions/shuffle.py), without another
    exchange. The last batch may be short."""
    own = numbered(samples.select("sample"), [], ["sample"])
    rows = own.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if shuffle:
        rows = rows.withColumn("place", Permutation.of(samples.count()).place(F.col("place"), seed, F.col("epoch")))
    return rows.select("epoch", F.floor(F.col("place") / size).alias("batch"), "place", "sample")


def sample_number(place: Column, count: int, seed: int, epoch: Column) -> Column:
    """Number, in the order of ids, of the sample at a place of an epoch: batches() read the other way."""
    return Permutation.of(count).number(place, seed, epoch)


#: Rows of one range that are numbered by one task, about.
RANGE_ROWS = 1 << 20


def numbered(rows: DataFrame, group: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Place (from 0) of each row in its group's order, without one task per group.

    The leading order column, a number, is cut into even ranges of its extent, as many as leave
    RANGE_ROWS rows in each if they lie evenly (as hashes and row numbers do); ranges are counted,
    and rows are numbered inside their range behind those before it."""
    parts = parts or max(64, -(-rows.count() // RANGE_ROWS))
    lead = order[0]
    extent = rows.groupBy(*group).agg(F.min(lead).cast("double").alias("low"), F.max(lead).cast("double").alias("high"))
    width = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    part = F.floor((F.col(lead).cast("double") - F.col("low")) / width * parts)
    cut = rows.join(F.broadcast(extent) if not group else extent, group or None, "inner") if group else rows.crossJoin(F.broadcast(extent))
    cut = cut.withColumn("part", part).drop("low", "high")
    counts = cut.groupBy(*group, "part").count()
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy(*group, "part").orderBy(*order)
    return cut.join(starts, [*group, "part"]).withColumn("place", F.col("start") + F.row_number().over(own) - 1).drop("part", "start")


def shard(place: Column, size: Column, shards: int) -> Column:
    """Which of the even contiguous shards a place of a batch falls in; the first ones are longer."""
    small, long_ = F.floor(size / shards), size % shards
    edge = long_ * (small + 1)
    return F.when(place < edge, F.floor(place / (small + 1))).otherwise(long_ + F.floor((place - edge) / F.greatest(small, F.lit(1))))


def step_counts(runs: DataFrame) -> DataFrame:
    """Steps of each run: n_train, batch_size, epochs, adam_epochs (nullable) -> three counts."""
    per = F.ceil(F.col("n_train") / F.col("batch_size"))
    return runs.withColumns({
        "steps_per_epoch": per, "total_steps": per * F.col("epochs"),
        "schedule_steps": per * F.coalesce("adam_epochs", "epochs"),
    })


def first_order_epoch(epoch: Column, adam_epochs: Column) -> Column:
    """Whether an epoch (from 0) is one of the first-order epochs of a run."""
    return F.when(adam_epochs.isNull(), F.lit(True)).otherwise(epoch < adam_epochs)


def budget_spent(elapsed: Column, budget: Column) -> Column:
    """Whether a run's time budget is used up; no budget is never spent."""
    return F.coalesce(elapsed >= budget, F.lit(False))
