"""Structure of a field set by proper orthogonal decomposition, fitted over distributed samples."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from gridmill.functions import grids
from gridmill.functions.blocks import listed, packed, stacked
from gridmill.functions.safe import div
from gridmill.operators import transfer
from gridmill.operators.normalize import moments

#: Numbers that the driver holds of one complete decomposition at most: its factor, or the samples
#: themselves where they are fewer than points. Larger sets are decomposed to their leading modes.
MOST_NUMBERS = 1 << 25
#: Modes sought beside those asked for, blocks that a search holds, and passes that it takes at most.
MORE, BLOCKS, PASSES = 16, 6, 40
#: Points whose sums travel in one row.
POINTS = 2048


def grid_weights(side: int, kind: str) -> np.ndarray:
    """Quadrature weights a point of a square grid, flattened; of a uniform one the cell's area."""
    w = grids.clenshaw_curtis(side) if kind == "chebyshev" else np.full(side, 2 / (side - 1))
    return np.outer(w, w).ravel()


class Pod:
    """mean [points], weights [points], singular values [r], modes [r, points], number of samples.

    energy: of the centred fields, from their moments. residual: the largest gap of A^T A v - sigma^2 v
    over the modes, as a share of the first sigma^2, where only the leading modes were sought; None for
    a complete decomposition, whose singular values are all there."""

    def __init__(self, mean: np.ndarray, weights: np.ndarray, sigma: np.ndarray, modes: np.ndarray, samples: int, energy: float, residual: float | None = None):
        self.mean, self.weights, self.sigma, self.modes, self.samples, self.energy, self.residual = mean, weights, sigma, modes, samples, energy, residual

    def eigenvalues(self) -> np.ndarray:
        return self.sigma**2 / (self.samples - 1)


def fit(df: DataFrame, values: str, weights: np.ndarray, keep: int | None = None, within: float = 1e-10) -> Pod:
    """Decomposition of the centred, weighted fields without forming their Gram matrix.

    Where samples or points are few (MOST_NUMBERS) it is complete: tasks reduce their rows to
    triangular factors that meet in a tree, or the few samples come to the driver as they are. Else
    the `keep` leading modes are sought by a blocked Krylov method begun at random: each pass over the
    fields costs two products with a block of keep + MORE vectors, its sums meet in a tree, and the
    search ends once the residuals are within `within` of the first eigenvalue. Singular values then
    come from a triangular factor of the fields' coefficients. The driver holds
    2 * BLOCKS * (keep + MORE) vectors of the grid, whatever the number of samples."""
    (one,) = fit_by(df.withColumn("_all", F.lit("")), values, "_all", {"": weights}, keep, within).values()
    return one


def fit_by(df: DataFrame, values: str, key: str, weights: dict[str, np.ndarray], keep: int | None = None, within: float = 1e-10) -> dict[str, Pod]:
    """A decomposition for each key, a text such as a grid's name; weights: of each key's grid.

    Fields are arrays or packed. The complete ones take one pass over all rows together, however many
    keys there are."""
    for w in weights.values():
        if not np.isfinite(w).all() or (w < 0).any():
            raise ValueError("weights must be finite and not negative")
    rows = df.where(F.col(values).isNotNull()).select(F.col(key).alias("key"), _numbers(df, values).alias("x"))
    rows = rows.where(F.col("key").isin(*weights))
    # a row a key
    base = {r["key"]: (int(r.n), np.array(r["mean"]), np.array(r["std"])) for r in moments(rows, "x", "key").select("key", "n", "mean", F.when(F.col("n") > 1, F.col("std")).alias("std")).where("n > 1").collect()}
    for k, w in weights.items():
        if k not in base:
            raise ValueError("a decomposition needs two samples at least")
        if len(base[k][1]) != len(w):
            raise ValueError(f"fields of {len(base[k][1])} points with {len(w)} weights")
    small = {k for k, w in weights.items() if min(base[k][0], len(w)) * len(w) <= MOST_NUMBERS}
    if keep is None and len(small) < len(weights):
        raise ValueError("the complete decomposition is too large: say how many modes to keep")
    out: dict[str, Pod] = {}
    centre = {k: (base[k][1], np.sqrt(w)) for k, w in weights.items()}
    factors = _factors(rows.where(F.col("key").isin(*small)), {k: centre[k] for k in small}, any(base[k][0] > len(weights[k]) for k in small)) if small else {}
    for k, w in weights.items():
        n, mean, std = base[k]
        energy = float((w * std**2).sum() * (n - 1))
        if k in small:
            sigma, modes = _decomposed(factors[k], min(keep or n, len(w), n))
            out[k] = Pod(mean, w, sigma, modes, n, energy)
        else:
            sigma, modes, residual = _leading(rows.where(F.col("key") == k).select("x"), *centre[k], min(keep, len(w), n), within)
            out[k] = Pod(mean, w, sigma, modes, n, energy, residual)
    return out


def _numbers(df: DataFrame, values: str) -> Column:
    """Fields as they are if packed, else as arrays of doubles."""
    return F.col(values) if df.select(values).schema[0].dataType == BinaryType() else F.col(values).cast("array<double>")


def _blocks(batches: Iterator[pa.RecordBatch], mean: np.ndarray, root: np.ndarray, at: int = 0) -> Iterator[np.ndarray]:
    """Centred, weighted fields [rows, points] of a column, some at a time."""
    size = max(1, (1 << 21) // len(mean))
    for b in batches:
        for i in range(0, b.num_rows, size):
            x = stacked(b.column(at).slice(i, size), (len(mean),))
            yield (x - mean) * root


def _factors(rows: DataFrame, centre: dict[str, tuple[np.ndarray, np.ndarray]], many: bool = True) -> dict[str, np.ndarray]:
    """A matrix for each key with the singular values and right vectors of its centred fields.

    many: whether any key has more samples than points."""

    def reduced(held: list[np.ndarray], points: int) -> np.ndarray:
        a = np.concatenate(held)
        return np.linalg.qr(a, mode="r") if len(a) > points else a

    def reduce_rows(pairs: Iterator[tuple[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for k, x in pairs:
            mine, points = held.setdefault(k, []), x.shape[1]
            mine.append(x)
            if sum(map(len, mine)) >= 2 * points + 64:
                held[k] = [reduced(mine, points)]
        for k, mine in held.items():
            a = reduced(mine, mine[0].shape[1])
            for i in range(0, len(a), 256):
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(a[i : i + 256]), pa.string()), packed(a[i : i + 256])], ["key", "row"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
        for b in batches:
            names = np.array(b.column(0).to_pylist(), object)
            for k in dict.fromkeys(names):
                yield k, b.column(1).filter(pa.array(names == k))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from reduce_rows((k, (stacked(x, (len(centre[k][0]),)) - centre[k][0]) * centre[k][1]) for k, x in cut(batches))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from reduce_rows((k, stacked(x, (len(centre[k][0]),))) for k, x in cut(batches))

    kind = "key string, row binary"
    got = rows.select("key", "x").mapInArrow(first, kind)
    # samples that are fewer than points are not reduced on the way
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) if many else 1
    while parts > 8:
        parts //= 8
        got = got.repartition(parts).mapInArrow(again, kind)
    table = got.repartition("key").mapInArrow(again, kind).toArrow() if parts > 1 else got.toArrow()
    held: dict[str, list[np.ndarray]] = {}
    for b in table.to_batches():
        for k, x in cut([b]):
            held.setdefault(k, []).append(stacked(x, (len(centre[k][0]),)))
    return {k: reduced(mine, len(centre[k][0])) for k, mine in held.items()}


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sum of all tasks' matrices, which come in rows (block, salt, data); only the sum is collected."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for block, salt, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                a = np.frombuffer(data.as_buffer())
                held[block, salt] = held[block, salt] + a if (block, salt) in held else a
        for (block, salt), a in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([a.tobytes()], pa.binary())], ["block", "salt", "data"])

    kind = "block int, salt int, data binary"
    rows = parts.repartition("block", "salt").mapInArrow(add, kind).withColumn("salt", F.lit(0)).repartition("block").mapInArrow(add, kind)
    out = np.zeros(shape)
    for r in rows.collect():  # the matrix, in blocks
        a = np.frombuffer(r.data).reshape(-1, shape[1])
        out[r.block * POINTS : r.block * POINTS + len(a)] = a
    return out


def _sent(a: np.ndarray, salts: int) -> Iterator[pa.RecordBatch]:
    salt = TaskContext.get().partitionId() % salts
    for block, i in enumerate(range(0, len(a), POINTS)):
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([a[i : i + POINTS].tobytes()], pa.binary())], ["block", "salt", "data"])


def _leading(rows: DataFrame, mean: np.ndarray, root: np.ndarray, keep: int, within: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Leading singular values, modes and the largest residual of the fields `x`."""
    spark, points = rows.sparkSession, len(mean)
    salts = max(1, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def acted(w: np.ndarray) -> np.ndarray:
        """A^T A w."""
        sent = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sent.value.shape)
            for x in _blocks(batches, mean, root):
                total += x.T @ (x @ sent.value)
            yield from _sent(total, salts)

        try:
            return _summed(rows.mapInArrow(run, "block int, salt int, data binary"), w.shape)
        finally:
            sent.unpersist()

    wide = min(keep + MORE, points)
    basis = np.zeros((points, 0))
    image = basis
    new = np.random.default_rng(0).normal(size=(points, wide)) * (root > 0)[:, None]
    residual = np.inf
    for _ in range(PASSES):
        for _ in range(2):
            new = new - basis @ (basis.T @ new)
            new, r = np.linalg.qr(new)
        basis, image = np.hstack([basis, new]), np.hstack([image, acted(new)])
        small = basis.T @ image
        value, vector = np.linalg.eigh((small + small.T) / 2)
        value, vector = value[::-1], vector[:, ::-1]
        ritz, moved = basis @ vector[:, :wide], image @ vector[:, :wide]
        gap = moved - ritz * value[:wide]
        size = np.linalg.norm(gap, axis=0)
        residual = float(size[:keep].max() / max(value[0], 1e-300))
        if residual <= within or basis.shape[1] >= points:
            break
        if basis.shape[1] + wide > min(BLOCKS * wide, points):
            # go on from the best of what was found
            held = vector[:, : 2 * wide]
            basis, image = basis @ held, image @ held
        wanted = np.flatnonzero(size > 1e-14 * value[0])[:wide]
        wanted = wanted[: points - basis.shape[1]]
        if not len(wanted):
            break
        new = gap[:, wanted] / size[wanted]
    modes = ritz[:, :keep]
    # singular values of the fields' coefficients, not of their squares
    sent = spark.sparkContext.broadcast(modes)

    def coefficients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, sent.value.shape[1]))
        for x in _blocks(batches, mean, root):
            held = np.linalg.qr(np.concatenate([held, x @ sent.value]), mode="r")
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([""] * len(held), pa.string()), listed(held)], ["key", "x"])

    flat = {"": (np.zeros(keep), np.ones(keep))}
    (factor,) = _factors(rows.mapInArrow(coefficients, "key string, x array<double>"), flat).values()
    _, sigma, turn = np.linalg.svd(factor, full_matrices=False)
    return sigma, turn @ modes.T, residual


def _decomposed(r: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and the first right vectors; of a wide factor by a triangular one of its few rows."""
    if len(r) < r.shape[1]:
        q, low = np.linalg.qr(r.T)
        _, sigma, small = np.linalg.svd(low.T)
        return sigma, small[:keep] @ q.T
    _, sigma, modes = np.linalg.svd(r, full_matrices=False)
    return sigma, modes[:keep]


def projected(pod: Pod, df: DataFrame, values: str) -> np.ndarray:
    """Energy of the centred fields along each mode, by a pass over them."""
    mean, root, modes = pod.mean, np.sqrt(pod.weights), pod.modes
    sent = df.sparkSession.sparkContext.broadcast(modes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sent.value), 1))
        for x in _blocks(batches, mean, root):
            total[:, 0] += ((x @ sent.value.T) ** 2).sum(0)
        yield from _sent(total, 1)

    rows = df.where(F.col(values).isNotNull()).select(_numbers(df, values).alias("x"))
    return _summed(rows.mapInArrow(run, "block int, salt int, data binary"), (len(modes), 1))[:, 0]


def check(pod: Pod, df: DataFrame | None = None, values: str | None = None, within: float = 1e-10) -> None:
    """Error unless the decomposition is one of the fields.

    The squared singular values of a complete one add up to the energy of the centred fields; the
    residuals of a leading one are small. Where the fields are given, the modes are at right angles,
    and the fields' energy along each is its squared singular value. All within a share of the energy."""
    scale = max(pod.energy, 1e-300)
    gap = (pod.sigma**2).sum() - pod.energy
    if pod.residual is None and not abs(gap) <= within * scale or not gap <= within * scale:
        raise ValueError(f"the singular values miss the energy by {gap / scale}")
    if pod.residual is not None and not pod.residual <= within:
        raise ValueError(f"the modes were sought to a residual of {pod.residual} only")
    if df is None:
        return
    turned = np.abs(pod.modes @ pod.modes.T - np.eye(len(pod.modes))).max(initial=0.0)
    off = np.abs(projected(pod, df, values) - pod.sigma[: len(pod.modes)] ** 2).max(initial=0.0)
    if not turned <= 1e-9 or not off <= within * scale:
        raise ValueError(f"the modes miss their energy by {off / scale} and right angles by {turned}")


def spectrum(spark, pod: Pod, **keys) -> DataFrame:
    """(keys, i, sigma, eigenvalue): a row a mode. Of leading modes alone also trace, the sum of all eigenvalues."""
    lam = pod.eigenvalues()
    rest = () if pod.residual is None else (pod.energy / (pod.samples - 1),)
    rows = [(*keys.values(), i, float(s), float(e), *rest) for i, (s, e) in enumerate(zip(pod.sigma, lam, strict=True))]
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) else 'int'}" for k, v in keys.items())
    return spark.createDataFrame(rows, (kinds + ", " if kinds else "") + "i int, sigma double, eigenvalue double" + (", trace double" if rest else ""))


def cumulative(rows: DataFrame, *group: str) -> DataFrame:
    """Adds share: the running part of each group's eigenvalues; a row a mode, some thousands."""
    run = Window.partitionBy(*group).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.col("trace") if "trace" in rows.columns else F.sum("eigenvalue").over(Window.partitionBy(*group))
    return rows.withColumn("share", div(F.sum("eigenvalue").over(run), whole))


def energy_ranks(rows: DataFrame, fractions: list[float], *group: str) -> DataFrame:
    """(group, fraction, rank): modes that reach each share; all of them if none does, but null where
    the rows are leading modes alone (they have a trace)."""
    each = cumulative(rows, *group).withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    reached = F.min(F.when(F.col("share") >= F.col("fraction"), F.col("i") + 1))
    return each.groupBy(*group, "fraction").agg((reached if "trace" in rows.columns else F.coalesce(reached, F.count("*"))).alias("rank"))


def flagged_ranks(ranks: DataFrame, population: DataFrame, samples: int, *group: str) -> DataFrame:
    """Ranks beside those of the population, flagged where these exceed what the samples can show."""
    other = population.withColumnRenamed("rank", "population_rank")
    return ranks.join(other, [*group, "fraction"]).withColumn("beyond", F.col("population_rank") > samples - 1)


def reconstruction(values: Column | str, pod: Pod, side: int, ranks: list[int]) -> Column:
    """Relative error of each field's reconstruction by so many modes; NaN for a zero field."""
    root, mean, modes = np.sqrt(pod.weights), pod.mean, pod.modes

    @F.arrow_udf("array<double>")
    def run(col: pa.Array) -> pa.Array:
        flat = stacked(col, (side, side)).reshape(-1, side * side)
        centred = (flat - mean) * root
        part = centred @ modes.T
        size = np.sqrt((flat**2 * pod.weights).sum(1))
        with np.errstate(all="ignore"):
            out = [np.sqrt(((centred - part[:, :r] @ modes[:r]) ** 2).sum(1)) / size for r in ranks]
        return listed(np.array(out).T, col)

    return run(values)


def by_rank(df: DataFrame, values: str, pod: Pod, side: int, ranks: list[int], *group: str) -> DataFrame:
    """(group, rank, mean, worst) of the reconstruction error."""
    known = F.array(*map(F.lit, ranks))
    each = df.where(F.col(values).isNotNull()).select(*group, F.explode(F.arrays_zip(known.alias("rank"), reconstruction(values, pod, side, ranks).alias("error"))).alias("r"))
    return each.groupBy(*group, F.col("r.rank").alias("rank")).agg(F.avg("r.error").alias("mean"), F.max("r.error").alias("worst"))


def trace_check(rows: DataFrame, population: DataFrame, samples: int, *group: str) -> DataFrame:
    """Trace of the fit against the population's, with its expected scatter."""
    ours = rows.groupBy(*group).agg(F.sum("eigenvalue").alias("trace"))
    theirs = population.groupBy(*group).agg(F.sum("eigenvalue").alias("population"), F.sum(F.col("eigenvalue") * F.col("eigenvalue")).alias("squares"))
    both = ours.join(theirs, [*group]) if group else ours.crossJoin(F.broadcast(theirs))
    return both.withColumn("ratio", div(F.col("trace"), F.col("population"))).withColumn("scatter", div(F.sqrt(2 * F.col("squares") / (samples - 1)), F.col("population"))).drop("squares")


def equal_groups(rows: DataFrame, population: DataFrame, samples: int, *group: str) -> DataFrame:
    """Sums of eigenvalues over positions that share a q, with their ratio and a flag.

    population: (i, q, eigenvalue). A group of g is off beyond three times sqrt(2 / (samples g))."""
    both = rows.select(*group, "i", F.col("eigenvalue").alias("own")).join(population.select("i", "q", F.col("eigenvalue").alias("whole")), "i")
    sums = both.groupBy(*group, "q").agg(F.count("*").alias("g"), F.sum("own").alias("own"), F.sum("whole").alias("whole"))
    ratio = div(F.col("own"), F.col("whole"))
    return sums.withColumn("ratio", ratio).withColumn("off", F.abs(ratio - 1) > 3 * F.sqrt(F.lit(2.0) / (samples * F.col("g"))))


def against_grid(rows: DataFrame, base: str, *group: str) -> DataFrame:
    """Eigenvalues of each grid over those of the base grid. rows: (group, grid, i, eigenvalue)."""
    ref = rows.where(F.col("grid") == base).select(*group, "i", F.col("eigenvalue").alias("base"))
    return rows.join(ref, [*group, "i"]).withColumn("ratio", div(F.col("eigenvalue"), F.col("base"))).drop("base")


def leading(rows: DataFrame, population: DataFrame, k: int = 20, *group: str) -> DataFrame:
    """The first eigenvalues beside the population's."""
    return rows.where(F.col("i") < k).select(*group, "i", "eigenvalue").join(population.select("i", F.col("eigenvalue").alias("population")), "i", "left")


def grid_fits(df: DataFrame, values: str, side: int, sizes: list[int], keep: int | None = None) -> dict[str, Pod]:
    """Fits of fields on `side` Chebyshev nodes a side and of the same on uniform learning grids.

    Restriction by interpolation; uniform grids are weighted by their cells' area, so that eigenvalues
    compare. Every field is read once for the means and once for all complete fits. Keys: cgl and s=<size>."""
    x = F.col(values).cast("array<double>")
    each = [F.struct(F.lit("cgl").alias("grid"), x.alias("x"))]
    each += [F.struct(F.lit(f"s={s}").alias("grid"), transfer.to_uniform(x, side, s).alias("x")) for s in sizes]
    rows = df.where(F.col(values).isNotNull()).select(F.explode(F.array(*each)).alias("g")).select("g.*")
    weights = {"cgl": grid_weights(side, "chebyshev")} | {f"s={s}": grid_weights(s, "uniform") for s in sizes}
    return fit_by(rows, "x", "grid", weights, keep)


def grid_spectra(spark, fits: dict[str, Pod], **keys) -> DataFrame:
    """(keys, grid, i, sigma, eigenvalue) of all fits, as against_grid() and energy_ranks() take them."""
    out = None
    for grid, pod in fits.items():
        rows = spectrum(spark, pod, **keys, grid=grid)
        out = rows if out is None else out.unionByName(rows)
    return out


def grid_summary(rows: DataFrame, base: str, samples: int, *group: str) -> DataFrame:
    """(group, grid, trace, ratio, directions): each grid's trace over the base grid's, and how many
    eigenvalues are beyond rounding (1e-12 of the first)."""
    first = F.max("eigenvalue").over(Window.partitionBy(*group, "grid"))
    real = F.col("eigenvalue") > 1e-12 * F.col("first")
    sums = rows.withColumn("first", first).groupBy(*group, "grid").agg(F.sum("eigenvalue").alias("trace"), F.least(F.count_if(real), F.lit(samples - 1)).alias("directions"))
    ref = sums.where(F.col("grid") == base).select(*group, F.col("trace").alias("whole"))
    both = sums.join(ref, [*group]) if group else sums.crossJoin(F.broadcast(ref))
    return both.withColumn("ratio", div(F.col("trace"), F.col("whole"))).drop("whole")
