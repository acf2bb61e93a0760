"""Losses and norms of a predicted against a true field, a number a sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions import grids
from gridmill.functions.blocks import numbers, stacked
from gridmill.functions.safe import div

#: Points a side up to which quadrature weights are written into the plan.
LITERAL_SIDE = 24


def _power_sum(values: Column, p: float) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.pow(F.abs(x), F.lit(float(p))))


def norm(values: Column, p: float = 2) -> Column:
    return F.pow(_power_sum(values, p), F.lit(1.0 / p))


def _gap(pred: Column | str, target: Column | str) -> Column:
    return F.zip_with(pred, target, lambda a, b: a - b)


def _check_p(p: float) -> None:
    if p < 1:
        raise ValueError(f"a norm of order {p}")


def relative(pred: Column | str, target: Column | str, p: float = 2) -> Column:
    """||pred - target|| / ||target||; a zero target gives infinity, or NaN if both are zero."""
    _check_p(p)
    return div(norm(_gap(pred, target), p), norm(F.col(target) if isinstance(target, str) else target, p))


def absolute(pred: Column | str, target: Column | str, shape: list[int], p: float = 2) -> Column:
    """Norm of the difference with the grid's cell size, 1 / (s - 1) along each axis."""
    _check_p(p)
    if min(shape) < 2:
        raise ValueError("an axis needs two points at least")
    cell = np.prod([1 / (s - 1) for s in shape]) ** (1 / p)
    return float(cell) * norm(_gap(pred, target), p)


def reduced(losses: DataFrame, loss: str, how: str, *group: str) -> DataFrame:
    """Mean or sum of the losses; 'none' leaves them as they are."""
    if how == "none":
        return losses
    return losses.groupBy(*group).agg({"mean": F.avg, "sum": F.sum}[how](loss).alias(loss))


def cc_norm_sq(values: Column | str, side: int) -> Column:
    """Sum of w_i w_j v_ij^2 with Clenshaw-Curtis weights.

    Built-in functions up to LITERAL_SIDE points a side; the weights of larger grids are no literals."""
    w = grids.clenshaw_curtis(side)
    if side > LITERAL_SIDE:

        @F.arrow_udf("double")
        def run(v: pa.Array) -> pa.Array:
            return numbers(np.einsum("kij,i,j->k", stacked(v, (side, side)) ** 2, w, w), v)

        return run(values)
    weights = F.array(*(F.lit(float(x)) for x in np.outer(w, w).ravel()))
    return F.aggregate(F.zip_with(values, weights, lambda v, x: v * v * x), F.lit(0.0), lambda a, x: a + x)


def cc_rel(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted ||a - b|| / ||b|| of each field, both scaled by their own largest value first."""

    def size(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = np.abs(x).max((1, 2))
        with np.errstate(all="ignore"):
            unit = np.where(top[:, None, None] > 0, x / top[:, None, None], x)
            return top, np.sqrt(np.einsum("kij,i,j->k", unit**2, w, w))

    (da, na), (db, nb) = size(a - b), size(b)
    with np.errstate(all="ignore"):
        return np.where(da == 0, 0.0, da) / db * np.where(da == 0, 0.0, na) / nb


def cc_relative(pred: Column | str, target: Column | str, side: int) -> Column:
    """Weighted relative error as a column, safe for very large and very small fields."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        both = pc.and_(a.is_valid(), b.is_valid())
        got = cc_rel(stacked(a.filter(both), (side, side)), stacked(b.filter(both), (side, side)), grids.clenshaw_curtis(side))
        return numbers(got, pc.if_else(both, 1, pa.scalar(None, pa.int64())))

    return run(pred, target)


def epoch_means(losses: DataFrame) -> DataFrame:
    """(epoch, mse, l2) from (epoch, batch, mse, l2) a sample: mean of batch means, and sample mean."""
    by_batch = losses.groupBy("epoch", "batch").agg(F.avg("mse").alias("mse"), F.sum("l2").alias("l2"), F.count("*").alias("n"))
    return by_batch.groupBy("epoch").agg(F.avg("mse").alias("mse"), (F.sum("l2") / F.sum("n")).alias("l2"))


def residual(pred: Column | str, target: Column | str, batch_size: Column) -> Column:
    """(pred - target) / (||target|| sqrt(B)): half its squared norm over a batch is the loss."""
    scale = norm(F.col(target) if isinstance(target, str) else target) * F.sqrt(batch_size)
    return F.transform(_gap(pred, target), lambda x: div(x, scale))
