"""Seeded random fields with solved and checked labels: one row a seed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import blocks, grids
from gridmill.operators.losses import cc_rel

# The covariance's decay and shift, the full series' expected energy, the largest
# truncation, the label check's tolerance and the grid from which it binds.
TAU_SQ, ALPHA, WHOLE_ENERGY, K_MAX = 9.0, 2.0, 4.984158e-3, 64
LABEL_GAP, LABEL_FROM = 1e-8, 65


def mu(k, l):
    """Eigenvalue of minus the Laplacian on a sine mode of [-1, 1]^2; columns or arrays."""
    return (np.pi**2 / 4) * (k * k + l * l)


def modes_table(spark: SparkSession, k_max: int) -> DataFrame:
    """(k, l, q, mu, lam): the sine modes up to k_max; a table of k_max^2 rows."""
    k, l = (spark.range(1, k_max + 1).withColumnRenamed("id", x) for x in "kl")
    m = mu(F.col("k"), F.col("l"))
    return k.crossJoin(l).select("k", "l", (F.col("k") * F.col("k") + F.col("l") * F.col("l")).alias("q"), m.alias("mu"), F.pow(m + TAU_SQ, F.lit(-ALPHA)).alias("lam"))


def spectrum(spark: SparkSession, k_max: int) -> DataFrame:
    """(i, q, k, l, f, u): covariance eigenvalues of forcing and solution, by ascending q."""
    from pyspark.sql import Window

    modes = modes_table(spark, k_max)
    energy = modes.agg((F.sum("lam") / 4).alias("s"))
    place = F.row_number().over(Window.orderBy("q", "k", "l")) - 1
    f = F.col("lam") / F.col("s")
    return modes.crossJoin(F.broadcast(energy)).select(place.alias("i"), "q", "k", "l", f.alias("f"), (f / (F.col("mu") * F.col("mu"))).alias("u"))


def tail(spark: SparkSession, k_max: int) -> DataFrame:
    """(s_k, eps_k): energy of the truncation and what it leaves out."""
    return modes_table(spark, k_max).agg((F.sum("lam") / 4).alias("s_k")).withColumn("eps_k", 1 - F.col("s_k") / WHOLE_ENERGY)


def default_truncation(n: int) -> int:
    if n < 3:
        raise ValueError(f"a grid of {n} nodes")
    return min((n - 1) // 2, K_MAX)


def draw(seed: int, k_max: int) -> np.ndarray:
    """Normals of a seed; a smaller truncation is the leading block of a larger one."""
    return np.random.Generator(np.random.Philox(key=seed)).standard_normal((K_MAX, K_MAX))[:k_max, :k_max]


def _sines(x: np.ndarray, k_max: int) -> np.ndarray:
    return np.sin(np.pi * np.arange(1, k_max + 1)[None, :] * (x[:, None] + 1) / 2)


def series(seeds: np.ndarray, n: int, k_max: int) -> tuple[np.ndarray, np.ndarray]:
    """Forcing and exact solution [seeds, n, n] of each seed's series."""
    k = np.arange(1, k_max + 1, dtype=float)
    m = mu(k[:, None], k[None, :])
    lam = (m + TAU_SQ) ** -ALPHA
    c = np.array([draw(int(s), k_max) for s in seeds]) * np.sqrt(lam / (lam.sum() / 4))
    basis = _sines(grids.chebyshev(n), k_max)
    return basis @ c @ basis.T, basis @ (c / m) @ basis.T


def split(spark: SparkSession, n: int, count: int, base: int, k_max: int | None = None, s: int | None = None, parts: int | None = None) -> DataFrame:
    """A labelled split of count samples. Map-only over seeds, so it spreads freely."""
    ids = spark.range(0, count, 1, parts) if parts else spark.range(count)
    return labelled(ids.withColumnRenamed("id", "sample"), n, base, k_max, s)


def labelled(samples: DataFrame, n: int, base: int, k_max: int | None = None, s: int | None = None, packed: bool = False) -> DataFrame:
    """Fields of the given samples: sample i has seed base + i.

    label_error compares the solved label with the exact series, transfer is the round trip through
    the s x s grid. From 65 nodes a side a label further off than LABEL_GAP, or NaN, is an error.
    packed: f and u are packed fields (blocks.packed), which large grids are written and read as fastest."""
    k_max, s = k_max or default_truncation(n), s or n - 1
    field, kind = (blocks.packed, "binary") if packed else (blocks.listed, "array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver, w = grids.Poisson(n, n), grids.clenshaw_curtis(n)
        there = grids.to_chebyshev(s, n) @ grids.to_uniform(n, s)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.column(0).slice(at, 64).to_numpy()
                f, exact = series(base + part, n, k_max)
                u = solver(f)
                gap = cc_rel(u, exact, w)
                bad = ~(gap <= LABEL_GAP)
                if n >= LABEL_FROM and bad.any():
                    i = int(np.argmax(bad))
                    raise ValueError(f"label of sample {part[i]}, seed {base + part[i]}, is off by {gap[i]}")
                numbers = [pa.array(part), pa.array(base + part), field(f), field(u), pa.array(gap), pa.array(cc_rel(there @ u @ there.T, u, w))]
                yield pa.RecordBatch.from_arrays(numbers, ["sample", "seed", "f", "u", "label_error", "transfer"])

    return samples.select(F.col("sample").cast("long").alias("sample")).mapInArrow(run, f"sample long, seed long, f {kind}, u {kind}, label_error double, transfer double")


def solve(values, n: int):
    """Column of labels u for a column of forcings f on n x n nodes."""
    solver = grids.Poisson(n, n)
    return blocks.mapped(values, (n, n), solver)


def manufactured(spark: SparkSession, n: int) -> DataFrame:
    """(name, i, j, u, f): closed-form pairs with f = -(u_xx + u_yy) and u = 0 on the edges."""
    from gridmill.operators.fields import nodes_table

    x = nodes_table(spark, n).select(F.col("j").alias("i"), F.col("x").alias("x"))
    y = nodes_table(spark, n).select("j", F.col("x").alias("y"))
    xc, yc, pi = F.col("x"), F.col("y"), np.pi
    bx, by = 1 - xc * xc, 1 - yc * yc
    pairs = {
        "sine": (F.sin(pi * xc) * F.sin(pi * yc), 2 * pi**2 * F.sin(pi * xc) * F.sin(pi * yc)),
        "polynomial": (bx * by, 2 * (bx + by)),
        "anisotropic": (F.sin(pi * xc) * F.sin(3 * pi * yc), 10 * pi**2 * F.sin(pi * xc) * F.sin(3 * pi * yc)),
        "exponential": (bx * by * F.exp(xc + yc), F.exp(xc + yc) * (by * (1 + 4 * xc + xc * xc) + bx * (1 + 4 * yc + yc * yc))),
    }
    rows = F.array(*(F.struct(F.lit(name).alias("name"), u.alias("u"), f.alias("f")) for name, (u, f) in pairs.items()))
    return x.crossJoin(F.broadcast(y)).select("i", "j", F.explode(rows).alias("r")).select("r.name", "i", "j", "r.u", "r.f")


def point_moments(split_: DataFrame, values: str = "f") -> DataFrame:
    """(pos, mean_square): mean square over samples at each point."""
    return split_.select(F.posexplode(values).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x") * F.col("x")).alias("mean_square"))


def covariance(x: np.ndarray, y: np.ndarray, k_max: int) -> float:
    """Covariance of the field at two points (a pair of coordinates each) that the spectrum implies."""
    k = np.arange(1, k_max + 1, dtype=float)
    lam = (mu(k[:, None], k[None, :]) + TAU_SQ) ** -ALPHA
    lam = lam / (lam.sum() / 4)
    first, second = (_sines(np.array([x[i], y[i]]), k_max).prod(0) for i in (0, 1))
    return float(first @ lam @ second)


def covariance_check(split_: DataFrame, n: int, pairs: list[tuple[tuple[int, int], tuple[int, int]]], k_max: int, values: str = "f") -> DataFrame:
    """(pair, n, covariance, expected, scatter): mean products of the field at pairs of nodes, beside
    those that the spectrum implies, with the standard error of so many samples.

    pairs: nodes (i, j) of the n x n grid. A column of products a pair, one pass, no points exploded."""
    at = grids.chebyshev(n)
    value = lambda p: F.element_at(values, p[0] * n + p[1] + 1)
    sums = split_.agg(F.count("*").alias("n"), *(F.avg(value(a) * value(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    point = lambda p: (at[p[0]], at[p[1]])
    rows = []
    for i, (a, b) in enumerate(pairs):
        own, first, second = (covariance(np.array(point(p)), np.array(point(q)), k_max) for p, q in ((a, b), (a, a), (b, b)))
        # a product of two joint normals
        rows.append(F.struct(F.lit(i).alias("pair"), F.col(f"c{i}").alias("covariance"), F.lit(own).alias("expected"), (F.sqrt(F.lit(first * second + own**2)) / F.sqrt("n")).alias("scatter")))
    return sums.select("n", F.explode(F.array(*rows)).alias("r")).select("r.pair", "n", "r.covariance", "r.expected", "r.scatter")
