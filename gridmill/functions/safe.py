"""Column arithmetic with IEEE results where Spark would raise or give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = "double('NaN')", "double('Infinity')"


def nan() -> Column:
    return F.lit(float("nan"))


def div(a: Column, b: Column) -> Column:
    """a / b; by zero gives an infinity of a's sign, or NaN for 0 / 0 and NaN / 0."""
    zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(nan())
    # NaN is the largest number to Spark, so it is told apart first
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.isnan(a) | F.isnan(b), nan()).when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def ln(x: Column) -> Column:
    """Natural logarithm; of zero minus infinity, of a negative number NaN."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, nan()).otherwise(F.log(x))


def nan_if_null(x: Column) -> Column:
    return F.coalesce(x, nan())


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; NaN for under two rows or a constant side."""
    varied = (F.coalesce(F.var_pop(x), F.lit(0.0)) > 0) & (F.coalesce(F.var_pop(y), F.lit(0.0)) > 0)
    sxy, sx, sy = F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)
    return F.when(F.coalesce(varied, F.lit(False)), sxy / F.when(varied, sx * sy)).otherwise(nan())


def upper_median(x: Column) -> Column:
    """Element n div 2 of the sorted values (counted from 0), nulls left out; null if there is none."""
    v = F.array_sort(F.collect_list(x))
    return F.try_element_at(v, F.expr("1") + F.floor(F.size(v) / 2).cast("int"))


def greatest_number(x: Column) -> Column:
    """Largest value as an aggregate that skips NaN; NaN if there is nothing else, null if nothing."""
    return F.coalesce(F.max(F.when(~F.isnan(x), x)), F.max(x))
