import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.functions import grids, safe, seeded


def test_grids():
    x = grids.chebyshev(9)
    assert x[0] == -1 and x[-1] == 1 and np.array_equal(x, -x[::-1])
    assert np.allclose(grids.clenshaw_curtis(3), [1 / 3, 4 / 3, 1 / 3])
    for n in range(4, 20):
        w = grids.clenshaw_curtis(n)
        assert (w > 0).all() and np.isclose(w.sum(), 2)
        assert np.isclose(w @ grids.chebyshev(n) ** 2, 2 / 3)


def test_transfers_reproduce_polynomials():
    x = grids.chebyshev(9)
    for s in (5, 9, 12):
        m = grids.to_uniform(9, s)
        assert np.allclose(m.sum(1), 1) and np.allclose(m @ x**8, grids.uniform(s) ** 8)
        back = grids.to_chebyshev(s, 9)
        assert np.allclose(back.sum(1), 1) and np.allclose(back @ grids.uniform(s) ** 2, x**2)
    assert grids.to_uniform(9, 5)[2].tolist() == [0, 0, 0, 0, 1, 0, 0, 0, 0]
    for bad in ((3, 5), (5, 2)):
        with pytest.raises(ValueError):
            grids.to_uniform(*bad)


def test_restrictions_keep_constants():
    for name in grids.RESTRICTIONS:
        assert np.allclose(grids.restriction(name, 9, 7).sum(1), 1)
    # means of x^2 over cells
    s, half = 5, 0.25
    got = grids.restriction("cell mean", 9, s) @ grids.chebyshev(9) ** 2
    low, high = np.maximum(grids.uniform(s) - half, -1), np.minimum(grids.uniform(s) + half, 1)
    assert np.allclose(got, (high**3 - low**3) / 3 / (high - low))


def test_derivatives_and_solver():
    x = grids.chebyshev(11)
    assert np.allclose(grids.derivative(11) @ x**7, 7 * x**6) and np.allclose(grids.second_derivative(11) @ x**7, 42 * x**5)
    wave = np.sin(np.pi * (grids.chebyshev(21) + 1) / 2)
    u = np.outer(wave, wave)
    assert np.abs(grids.Poisson(21, 21)(u[None] * np.pi**2 / 2)[0] - u).max() < 1e-12
    with pytest.raises(ValueError):
        grids.Poisson(2, 5)


def test_subset_rule():
    want = [18, 36, 87, 108, 132, 152, 185, 230, 266, 320, 400, 468, 469, 590, 597, 607, 652, 712, 716, 776, 786, 791, 803, 864, 959]
    assert seeded.subset(1000, 25, 0) == want
    assert seeded.fingerprint(want) == "65104831155be79e" and seeded.fingerprint([]) == "cbf29ce484222325"
    for seed in range(3):
        held = set()
        for n in (25, 50, 100, 250, 500, 1000):
            rows = seeded.subset(1000, n, seed)
            assert held <= {*rows} and len({*rows}) == n
            held = {*rows}
    with pytest.raises(ValueError):
        seeded.subset(5, 6, 0)


def test_safe_arithmetic(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (None, 1.0), (float("nan"), 0.0)], "a double, b double")
    got = [r[0] for r in rows.select(safe.div(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [float("inf"), float("-inf")] and np.isnan(got[2]) and got[3] == 2 and got[4] is None and np.isnan(got[5])
    logs = [r[0] for r in spark.createDataFrame([(0.0,), (-1.0,), (1.0,)], "a double").select(safe.ln(F.col("a"))).collect()]
    assert logs[0] == float("-inf") and np.isnan(logs[1]) and logs[2] == 0
    median = spark.createDataFrame([(x,) for x in (4.0, 1.0, 3.0, 2.0, None)], "a double").agg(safe.upper_median(F.col("a"))).first()[0]
    assert median == 3.0
    assert spark.createDataFrame([(None,)], "a double").agg(safe.upper_median(F.col("a"))).first()[0] is None
    one = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double").agg(safe.correlation(F.col("a"), F.col("b"))).first()[0]
    assert np.isnan(one)
    top = spark.createDataFrame([(1.0,), (float("nan"),)], "a double").agg(safe.greatest_number(F.col("a"))).first()[0]
    assert top == 1.0
