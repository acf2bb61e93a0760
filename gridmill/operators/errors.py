"""Per-sample errors of predictions, their summaries and cross-checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions import grids
from gridmill.functions.blocks import listed, stacked
from gridmill.functions.safe import correlation, div, ln, nan_if_null
from gridmill.operators.losses import cc_rel, relative
from gridmill.operators.normalize import decode, encode, moments

ERRORS = "transfer double, model double, total double, u_norm double, boundary_ratio double, boundary_rms double"

#: Boundary share of the mean error from which the boundary is worth a study.
BOUNDARY_SHARE = 0.10


def boundary(u_hat: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest edge value over the largest of u; edge RMS over the RMS of u. Corners are on two edges."""
    edges = np.stack([u_hat[:, 0], u_hat[:, -1], u_hat[:, :, 0], u_hat[:, :, -1]], 1)
    with np.errstate(all="ignore"):
        ratio = np.abs(edges).max((1, 2)) / np.abs(u).max((1, 2))
        line = np.sqrt((edges**2 * w).sum((1, 2)) / 8)
        return ratio, line / np.sqrt(np.einsum("kij,i,j->k", u**2, w, w) / 4)


def sample_errors(pred: Column | str, u: Column | str, s: int, n: int, degree: int = grids.DEGREE) -> Column:
    """All errors of a prediction on the s x s uniform grid against u on n x n nodes, as one struct.

    Null where either field is."""
    names = [x.split(" ")[0] for x in ERRORS.split(", ")]
    down, up = grids.to_uniform(n, s), grids.to_chebyshev(s, n, degree)

    @F.arrow_udf(ERRORS)
    def run(p: pa.Array, v: pa.Array) -> pa.Array:
        both = pc.and_(p.is_valid(), v.is_valid())
        p, v, w = stacked(p.filter(both), (s, s)), stacked(v.filter(both), (n, n)), grids.clenshaw_curtis(n)
        coarse, u_hat = down @ v @ down.T, up @ p @ up.T
        with np.errstate(all="ignore"):
            model = np.sqrt(((p - coarse) ** 2).sum((1, 2))) / np.sqrt((coarse**2).sum((1, 2)))
        found = cc_rel(up @ coarse @ up.T, v, w), model, cc_rel(u_hat, v, w), np.sqrt(np.einsum("kij,i,j->k", v**2, w, w)), *boundary(u_hat, v, w)
        out = []
        for x in found:
            spread = np.full(len(both), np.nan)
            spread[both.to_numpy(zero_copy_only=False)] = x
            out.append(pa.array(spread))
        return pa.StructArray.from_arrays(out, names, mask=pc.invert(both))

    return run(pred, u)


def score(predictions: DataFrame, truth: DataFrame, s: int, n: int, *keys: str) -> DataFrame:
    """Errors of predictions (keys, sample, pred) against (sample, u); both must have each sample."""
    both = predictions.join(truth.select("sample", "u"), "sample")
    missing = predictions.join(truth, "sample", "left_anti").limit(1).count()
    if missing:
        raise ValueError("a prediction without its true field")
    return both.select(*keys, "sample", sample_errors("pred", "u", s, n).alias("e")).select(*keys, "sample", "e.*")


def stats(values: Column) -> Column:
    """(mean, worst) as an aggregate: NaN in any value or no values make both NaN."""
    return F.struct(nan_if_null(F.avg(values)).alias("mean"), nan_if_null(F.max(values)).alias("worst"))


def worst_sample(rows: DataFrame, error: str, *group: str) -> DataFrame:
    """First sample with the largest error of each group; NaN counts as the largest."""
    return rows.groupBy(*group).agg(F.max_by("sample", F.struct(error, (-F.col("sample")).alias("s"))).alias("worst_sample"))


def log_correlation(a: Column, b: Column) -> Column:
    """Correlation of the logarithms as an aggregate; NaN for under two rows or a constant side."""
    return correlation(ln(a), ln(b))


def relative_gap(a: Column, b: Column) -> Column:
    return div(F.abs(a - b), F.abs(b))


def check_sidecar(evaluations: DataFrame, sidecars: DataFrame, within: float = 1e-12) -> DataFrame:
    """Adds compared and agrees: transfer statistics against the sidecar of the same set.

    Another s or count isn't compared and passes."""
    side = sidecars.select("set", F.col("s").alias("s2"), F.col("count").alias("count2"), F.col("mean").alias("mean2"), F.col("max").alias("max2"))
    both = evaluations.join(side, "set", "left")
    compared = F.coalesce((F.col("s") == F.col("s2")) & (F.col("count") == F.col("count2")), F.lit(False))
    near = (relative_gap(F.col("mean"), F.col("mean2")) <= within) & (relative_gap(F.col("worst"), F.col("max2")) <= within)
    return both.withColumn("compared", compared).withColumn("agrees", F.when(compared, near).otherwise(True)).drop("s2", "count2", "mean2", "max2")


def check_last_epoch(evaluations: DataFrame, last: DataFrame, within: float = 1e-5) -> DataFrame:
    """Adds agrees: the mean model error against the loss of the run's last epoch."""
    both = evaluations.join(last.select("run", "test_l2"), "run", "left")
    return both.withColumn("agrees", F.coalesce(relative_gap(F.col("model_mean"), F.col("test_l2")) <= within, F.lit(False)))


def boundary_verdict(boundary_mean: Column, total_mean: Column) -> Column:
    return F.coalesce(div(boundary_mean, total_mean) >= BOUNDARY_SHARE, F.lit(False))


def evaluation(errors: DataFrame, *group: str, arrays: bool = True) -> DataFrame:
    """One record a group: statistics of the five errors, worst sample, correlation, verdict.

    arrays: also the per-sample errors and norms in sample order; the long table stays the source."""
    names = ["transfer", "model", "total", "boundary_ratio", "boundary_rms"]
    columns = [stats(F.col(x)).alias(x) for x in names]
    columns += [F.count("*").alias("n_test"), F.max_by("sample", F.struct("total", (-F.col("sample")).alias("s"))).alias("worst_sample"), log_correlation(F.col("total"), F.col("u_norm")).alias("log_correlation")]
    if arrays:
        columns += [F.array_sort(F.collect_list(F.struct("sample", "total", "u_norm"))).alias("rows")]
    out = errors.groupBy(*group).agg(*columns)
    if arrays:
        out = out.withColumn("total_per_sample", F.col("rows.total")).withColumn("u_norm_per_sample", F.col("rows.u_norm")).drop("rows")
    return out.withColumn("boundary_matters", boundary_verdict(F.col("boundary_rms.mean"), F.col("total.mean")))


def by_group(errors: DataFrame, *group: str) -> DataFrame:
    """Mean and worst of each error by group, as plain columns: the study over grids and runs."""
    names = ["transfer", "model", "total"]
    return errors.groupBy(*group).agg(*(f(x).alias(f"{x}_{n}") for x in names for f, n in ((F.avg, "mean"), (F.max, "worst"))))


def resolution_study(rows: DataFrame, model: Callable[[Column], Column], trained: int, last: DataFrame | None = None) -> DataFrame:
    """Model error at each resolution with the weights unchanged and the statistics fitted anew.

    rows: (n, split, sample, x, y). For each n, inputs are encoded by the statistics of its training
    split, given to `model`, and decoded by the target's; the error is the relative norm over its test
    split. All n are fitted in one job; the statistics are a row for each n, broadcast.
    Returns n, n_test, mean, worst, ratio (of the means, to the trained n's) and, where `last` is given
    (a row with test_l2, the run's last loss), agrees: at the trained n the mean is that loss."""
    train, test = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")
    named = lambda v: moments(train.withColumnRenamed("n", "side"), v, "side").select(F.col("side").alias("n"), F.col("mean").alias(f"{v}_mean"), F.col("std").alias(f"{v}_std"))
    both = test.join(F.broadcast(named("x")), "n").join(F.broadcast(named("y")), "n")
    pred = decode(model(encode("x", "x_mean", "x_std")), "y_mean", "y_std")
    errors = both.select("n", "y", pred.alias("pred")).select("n", relative("pred", "y").alias("e"))
    out = to_trained(errors.groupBy("n").agg(F.count("*").alias("n_test"), nan_if_null(F.avg("e")).alias("mean"), nan_if_null(F.max("e")).alias("worst")), "n", "mean", trained)
    if last is None:
        return out
    runs = out.withColumn("run", F.lit(0)).withColumnRenamed("mean", "model_mean")
    checked = check_last_epoch(runs, last.select(F.lit(0).alias("run"), "test_l2")).withColumn("agrees", F.when(F.col("n") == trained, F.col("agrees")))
    return checked.withColumnRenamed("model_mean", "mean").drop("run", "test_l2")


@lru_cache(64)
def _transfers(n: int, s: int, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Down and up matrices and the weights of n nodes."""
    return grids.to_uniform(n, s), grids.to_chebyshev(s, n, degree), grids.clenshaw_curtis(n)


def restricted(values: Column | str, n: Column | str) -> Column:
    """Fields on n x n nodes to (n - 1) x (n - 1) uniform ones; n may differ from row to row."""

    @F.arrow_udf("array<double>")
    def run(v: pa.Array, side: pa.Array) -> pa.Array:
        out: list[np.ndarray | None] = [None] * len(v)
        for m, at in _by_side(side, v):
            down = _transfers(m, m - 1, grids.DEGREE)[0]
            for i, x in zip(at, (down @ stacked(v.take(pa.array(at)), (m, m)) @ down.T).reshape(len(at), -1), strict=True):
                out[i] = x
        return pa.array(out, pa.list_(pa.float64()))

    return run(values, n)


def _by_side(side: pa.Array, *fields: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Each size with the places of its rows whose fields are there."""
    there = np.logical_and.reduce([x.is_valid().to_numpy(zero_copy_only=False) for x in (side, *fields)])
    sides = side.fill_null(0).to_numpy()
    for m in np.unique(sides[there]):
        yield int(m), np.flatnonzero(there & (sides == m))


def errors_by_side(pred: Column | str, u: Column | str, n: Column | str, degree: int = grids.DEGREE) -> Column:
    """(transfer, model, total) of predictions on (n - 1) x (n - 1) uniform nodes against u on n x n ones.

    n may differ from row to row; its matrices are made once a task. Null where either field is."""

    @F.arrow_udf("transfer double, model double, total double")
    def run(p: pa.Array, v: pa.Array, side: pa.Array) -> pa.Array:
        out, none = np.full((3, len(p)), np.nan), np.ones(len(p), bool)
        for m, at in _by_side(side, p, v):
            down, up, w = _transfers(m, m - 1, degree)
            a, b = stacked(p.take(pa.array(at)), (m - 1, m - 1)), stacked(v.take(pa.array(at)), (m, m))
            coarse = down @ b @ down.T
            with np.errstate(all="ignore"):
                model = np.sqrt(((a - coarse) ** 2).sum((1, 2))) / np.sqrt((coarse**2).sum((1, 2)))
            out[:, at], none[at] = (cc_rel(up @ coarse @ up.T, b, w), model, cc_rel(up @ a @ up.T, b, w)), False
        return pa.StructArray.from_arrays([pa.array(x) for x in out], ["transfer", "model", "total"], mask=pa.array(none))

    return run(pred, u, n)


def resolution_errors(rows: DataFrame, model: Callable[[Column], Column], trained: int, last: DataFrame | None = None) -> DataFrame:
    """Errors 2, 3 and 4 of one model at each resolution, its statistics fitted anew for each.

    rows: (n, split, sample, f, u), fields on n x n Chebyshev nodes; rows without either are left out. For each n both fields of the
    training split are restricted to n - 1 uniform nodes and their statistics fitted; inputs of the test
    split are restricted, encoded, given to `model` and decoded; its output is scored on the uniform grid
    (model) and, taken back to the nodes, against u (total), beside what the round trip costs (transfer).
    All n share their passes; the statistics are a row for each n, broadcast.
    Returns n, s, n_test, mean and worst of each error, ratio (of the mean model errors, to the trained
    n's) and, where `last` is given (a row with test_l2), agrees at the trained n."""
    rows = rows.where(F.col("f").isNotNull() & F.col("u").isNotNull()).withColumn("x", restricted("f", "n"))
    train, test = rows.where(F.col("split") == "train").withColumn("y", restricted("u", "n")), rows.where(F.col("split") == "test")
    named = lambda v: moments(train.select(F.col("n").alias("side"), v), v, "side").select(F.col("side").alias("n"), F.col("mean").alias(f"{v}_mean"), F.col("std").alias(f"{v}_std"))
    both = test.join(F.broadcast(named("x")), "n").join(F.broadcast(named("y")), "n")
    pred = decode(model(encode("x", "x_mean", "x_std")), "y_mean", "y_std")
    scored_ = both.select("n", "sample", "u", pred.alias("pred")).select("n", "sample", errors_by_side("pred", "u", "n").alias("e")).select("n", "sample", "e.*")
    names = ["transfer", "model", "total"]
    out = scored_.groupBy("n").agg(F.count("*").alias("n_test"), *(f.alias(f"{x}_{k}") for x in names for k, f in (("mean", nan_if_null(F.avg(x))), ("worst", nan_if_null(F.max(x))))))
    out = to_trained(out.withColumn("s", F.col("n") - 1), "n", "model_mean", trained)
    if last is None:
        return out
    checked = check_last_epoch(out.withColumn("run", F.lit(0)), last.select(F.lit(0).alias("run"), "test_l2"))
    return checked.withColumn("agrees", F.when(F.col("n") == trained, F.col("agrees"))).drop("run", "test_l2")


def to_trained(rows: DataFrame, rate: str, loss: str, trained: int, *group: str) -> DataFrame:
    """Ratio of each rate's loss to the trained rate's."""
    base = rows.where(F.col(rate) == trained).select(*group, F.col(loss).alias("base"))
    both = rows.join(base, [*group]) if group else rows.crossJoin(F.broadcast(base))
    return both.withColumn("ratio", div(F.col(loss), F.col("base"))).drop("base")


class FourierModel:
    """Weights of a scoring model: lift, layers of (modes, 1 x 1 mix), projection.

    lift: (w [in, hidden], b); layers: list of (spectral complex, w, b); project: list of (w, b); all
    arrays NumPy. Of planes spectral is [2, m, m, hidden, hidden] and the inputs are the value and
    both coordinates; of lines it is [m, hidden, hidden] and they are the value and the coordinate.
    padding: points put behind each axis and cut off again."""

    def __init__(self, lift: tuple, layers: list[tuple], project: list[tuple], padding: int = 0):
        self.lift, self.layers, self.project, self.padding = lift, layers, project, padding

    def _modes(self, a: np.ndarray, spectral: np.ndarray) -> np.ndarray:
        """The lowest modes of each channel, mixed."""
        axes = tuple(range(1, a.ndim - 1))
        m = spectral.shape[-3]
        if m > a.shape[-2] // 2 + 1 or len(axes) == 2 and 2 * m > a.shape[1]:
            raise ValueError(f"{m} modes on a grid of {' x '.join(map(str, a.shape[1:-1]))}")
        f = np.fft.rfftn(a, axes=axes)
        g = np.zeros_like(f)
        if len(axes) == 1:
            g[:, :m] = np.einsum("kxi,xio->kxo", f[:, :m], spectral)
        else:
            g[:, :m, :m] = np.einsum("kxyi,xyio->kxyo", f[:, :m, :m], spectral[0])
            g[:, -m:, :m] = np.einsum("kxyi,xyio->kxyo", f[:, -m:, :m], spectral[1])
        return np.fft.irfftn(g, s=a.shape[1:-1], axes=axes)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """[samples, h, w] or [samples, points] inputs to outputs of the same shape."""
        sides = x.shape[1:]
        at = np.meshgrid(*(np.arange(n) / (n - 1) if n > 1 else np.zeros(1) for n in sides), indexing="ij")
        # the last axis' coordinate comes first
        a = np.stack([x, *(np.broadcast_to(c, x.shape) for c in reversed(at))], -1) @ self.lift[0] + self.lift[1]
        a = np.pad(a, ((0, 0), *[(0, self.padding)] * len(sides), (0, 0)))
        for i, (spectral, mix, b) in enumerate(self.layers):
            a = self._modes(a, spectral) + a @ mix + b
            if i < len(self.layers) - 1:
                a = np.maximum(a, 0)
        a = a[(slice(None), *(slice(n) for n in sides))]
        for i, (v, b) in enumerate(self.project):
            a = a @ v + b
            if i < len(self.project) - 1:
                a = np.maximum(a, 0)
        return a[..., 0]


def scored(df: DataFrame, values: str, shape: tuple[int, ...], model: FourierModel, out: str = "pred") -> DataFrame:
    """Predictions of each row's field, one- or two-dimensional as shape is; null for a null field.
    The weights are broadcast once."""
    weights = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def run(col: pa.Array) -> pa.Array:
        fields = stacked(col, shape)
        return listed(weights.value(fields) if len(fields) else np.zeros((0, 1)), col)

    return df.withColumn(out, run(values))


def ranked(df: DataFrame, by: str, *group: str) -> DataFrame:
    """Rank from 1 in descending order, within small groups such as a run's error table."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(by))))
