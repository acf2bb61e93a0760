"""Moving field columns between grids, and what a round trip costs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions import grids
from gridmill.functions.blocks import both_sides, listed, numbers, stacked
from gridmill.operators.losses import cc_rel


def to_uniform(values: Column | str, n: int, s: int, packed: bool = False) -> Column:
    """Fields on n x n Chebyshev nodes to s x s uniform ones; packed: gives packed fields.

    Fields come as arrays or packed (blocks.pack), which is many times faster on large grids."""
    m = grids.to_uniform(n, s)
    return both_sides(values, (n, n), m, m, packed)


def to_chebyshev(values: Column | str, s: int, n: int, degree: int = grids.DEGREE, packed: bool = False) -> Column:
    """Fields on s x s uniform nodes to n x n Chebyshev ones; packed: gives packed fields."""
    m = grids.to_chebyshev(s, n, degree)
    return both_sides(values, (s, s), m, m, packed)


def derivative(values: Column | str, n: int, axis: int, order: int = 1) -> Column:
    """First or second derivative of n x n fields along an axis."""
    d, one = (grids.derivative if order == 1 else grids.second_derivative)(n), np.eye(n)
    return both_sides(values, (n, n), *((d, one) if axis == 0 else (one, d)))


def matrix_table(spark, matrix: np.ndarray) -> DataFrame:
    """(i, k, c): a transfer matrix as a table of its entries."""
    return spark.createDataFrame([(i, k, float(matrix[i, k])) for i in range(matrix.shape[0]) for k in range(matrix.shape[1])], "i int, k int, c double")


def by_join(points: DataFrame, matrix: DataFrame) -> DataFrame:
    """The same map in relational form: (sample, i, j, value) through a matrix along both axes."""
    rows = points.withColumnRenamed("i", "k").join(F.broadcast(matrix), "k").groupBy("sample", "i", "j").agg(F.sum(F.col("c") * F.col("value")).alias("value"))
    cols = rows.withColumnRenamed("j", "k").withColumnRenamed("i", "row").join(F.broadcast(matrix), "k")
    return cols.groupBy("sample", F.col("row").alias("i"), F.col("i").alias("j")).agg(F.sum(F.col("c") * F.col("value")).alias("value"))


def round_trips(values: Column | str, n: int, cases: list[tuple[str, int, int]]) -> Column:
    """Weighted relative error of going to a coarser grid and back, one number for each case.

    cases: (restriction, s, degree). All are taken in one pass over a batch of fields."""

    trips = [grids.to_chebyshev(s, n, d) @ grids.restriction(name, n, s) for name, s, d in cases]

    @F.arrow_udf("array<double>")
    def run(col: pa.Array) -> pa.Array:
        a, w = stacked(col, (n, n)), grids.clenshaw_curtis(n)
        return listed(np.stack([cc_rel(m @ a @ m.T, a, w) for m in trips], 1), col)

    return run(values)


def floor_sweep(df: DataFrame, values: str, n: int, cases: list[tuple[str, int, int]], *group: str) -> DataFrame:
    """(group, restriction, s, degree, mean, worst) of the round-trip error."""
    known = F.array(*(F.struct(F.lit(a).alias("restriction"), F.lit(b).alias("s"), F.lit(c).alias("degree")) for a, b, c in cases))
    each = df.where(F.col(values).isNotNull()).select(*group, F.explode(F.arrays_zip(known.alias("case"), round_trips(values, n, cases).alias("error"))).alias("r"))
    each = each.select(*group, "r.case.restriction", "r.case.s", "r.case.degree", "r.error")
    return each.groupBy(*group, "restriction", "s", "degree").agg(F.avg("error").alias("mean"), F.max("error").alias("worst"))


def filter_matrix(n: int, name: str, s: int) -> np.ndarray:
    """[n, n]: nodal values to those of the filtered polynomial."""
    c, k = np.linalg.inv(grids._modes(np.arange(n), grids.chebyshev(n))), np.arange(n)
    taper, cut = name.split(" ")
    last = {"s-2": s - 2, "s*pi/2": min(int((s - 2) * np.pi / 2), n - 1), "n-1": n - 1}[cut]
    gain = np.where(k <= last, 1.0 if taper == "sharp" else np.exp(-36.0 * (k / last) ** 8), 0.0)
    return grids._modes(k, grids.chebyshev(n)) * gain @ c


def filtered_energy(values: Column | str, n: int, name: str, s: int) -> Column:
    """Share of a field's energy that a coefficient filter takes away."""
    m = filter_matrix(n, name, s)

    @F.arrow_udf("double")
    def run(col: pa.Array) -> pa.Array:
        a = stacked(col, (n, n))
        return numbers(cc_rel(m @ a @ m.T, a, grids.clenshaw_curtis(n)) ** 2, col)

    return run(values)


def best_degree(sweep: DataFrame, bound: float) -> DataFrame:
    """Smallest degree whose worst error stays within the bound at every n from 65 on."""
    good = sweep.where("n >= 65").groupBy("degree").agg(F.bool_and(F.col("worst") <= bound).alias("holds")).where("holds")
    return good.agg(F.min("degree").alias("degree"))


def best_restriction(sweep: DataFrame, within: float = 1.1) -> DataFrame:
    """For each degree and s the first restriction, in rule order, within 10 % of the lowest mean."""
    order = F.create_map(*(x for i, r in enumerate(grids.RESTRICTIONS) for x in (F.lit(r), F.lit(i))))
    least = sweep.groupBy("degree", "s").agg(F.min("mean").alias("least"))
    near = sweep.join(least, ["degree", "s"]).where(F.col("mean") <= within * F.col("least"))
    return near.groupBy("degree", "s").agg(F.min_by("restriction", order[F.col("restriction")]).alias("restriction"))
