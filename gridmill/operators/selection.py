"""Exact order statistics of groups of any size, without gathering or sorting a group.

Numbers become whole numbers of the same order, whose leading bits are counted: the counts say in which
bucket the wanted one lies, and the next pass looks at that bucket alone, by its next bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions.safe import upper_median
from gridmill.sources.shared import scratch

#: Rows of a group, or of a bucket, that one task sorts.
FEW = 1 << 16
#: Bits by which a bucket is cut in a pass.
BITS = 12
#: Groups or buckets up to this number are broadcast; more are joined by shuffle.
BROADCAST = 1 << 16


def order_bits(x: Column) -> Column:
    """Whole numbers from 0 in the order of doubles: -0 equals 0, NaN comes last."""

    @F.arrow_udf("long")
    def run(values: pa.Array) -> pa.Array:
        a = values.to_numpy(zero_copy_only=False).astype(float) + 0.0
        bits = np.where(np.isnan(a), np.nan, a).view(np.int64)
        # negative numbers' bits grow as they fall; the sign bit is left out of the result, which stays positive
        ordered = np.where(bits < 0, ~bits, bits | np.int64(-(1 << 63))).view(np.uint64) >> np.uint64(1)
        return pa.array(ordered.astype(np.int64), mask=values.is_null().to_numpy(zero_copy_only=False))

    return run(x.cast("double"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST else df


def upper_medians(rows: DataFrame, value: str, *group: str) -> DataFrame:
    """(group, n, median): element n div 2 of each group's values in order (from 0), nulls left out.

    NaN is larger than any number. A group whose values are all null has n 0 and a null median; a null
    key is a key of its own. Groups of up to FEW values are sorted; in larger ones the place of the
    median is found by counts, BITS bits a pass, until FEW values are left to sort or all are equal."""
    key = F.struct(*(F.col(g) for g in group)) if group else F.struct(F.lit(0).alias("all"))
    held = _written(rows.select(key.alias("key"), F.col(value).cast("double").alias("x")), "values")
    counts = _written(held.groupBy("key").agg(F.count("x").alias("n")), "counts")
    large = counts.where(F.col("n") > FEW)
    if large.count() == 0:
        medians = held.groupBy("key").agg(F.count("x").alias("n"), upper_median(F.col("x")).alias("median"))
    else:
        names = _sized(large.select("key"))
        small = held.join(names, "key", "left_anti").groupBy("key").agg(F.count("x").alias("n"), upper_median(F.col("x")).alias("median"))
        wide = _written(held.where(F.col("x").isNotNull()).join(names, "key", "left_semi").withColumn("bits", order_bits(F.col("x"))), "bits")
        medians = small.unionByName(_selected(wide, large))
    return medians.select(*(F.col("key")[g].alias(g) for g in group), "n", "median")


def _selected(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, n, median) of large groups: rows (key, x, bits), sizes (key, n)."""
    # of each group the bucket looked at (its leading bits), the rows before it and in it
    at = sizes.select("key", "n", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"))
    shift = 63
    while shift and at.where(F.col("inside") > FEW).count():
        step = min(BITS, shift)
        inside = rows.join(_sized(at), "key").where(F.shiftright("bits", shift) == F.col("bucket"))
        shift -= step
        counts = inside.groupBy("key", "n", "before", F.shiftright("bits", shift).alias("bucket")).agg(F.count("*").alias("inside"))
        # at most 2^BITS buckets a group
        ahead = F.coalesce(F.sum("inside").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("before", F.col("before") + ahead)
        middle = F.floor(F.col("n") / 2)
        at = _written(counts.where((F.col("before") <= middle) & (middle < F.col("before") + F.col("inside"))), "buckets")
    inside = rows.join(_sized(at), "key").where(F.shiftright("bits", shift) == F.col("bucket"))
    # equal values are one row, so what is left of a group is FEW rows at most, or one value and its neighbour
    values = inside.groupBy("key", "n", "before", "x").agg(F.count("*").alias("times"))
    upto = F.col("before") + F.sum("times").over(Window.partitionBy("key").orderBy("x"))
    return values.withColumn("upto", upto).where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("key", "n").agg(F.min("x").alias("median"))
