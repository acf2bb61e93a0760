import numpy as np
import pytest

from gridmill.functions import grids
from gridmill.operators import pod


def decaying(n, side, seed=0, power=1.5):
    """Fields with a falling spectrum and no equal singular values."""
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(side * side, side * side)))
    return rng.normal(size=(n, side * side)) * np.arange(1, side * side + 1) ** -power @ q.T + rng.normal(size=side * side)


def frame(spark, a, parts=3):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)], "sample long, values array<double>").repartition(parts)


def svd(a, w):
    return np.linalg.svd((a - a.mean(0)) * np.sqrt(w), full_matrices=False)


@pytest.mark.parametrize(("n", "side"), [(400, 9), (60, 12)])
def test_leading_modes_equal_those_of_numpy(spark, monkeypatch, n, side):
    monkeypatch.setattr(pod, "MOST_NUMBERS", 100)
    monkeypatch.setattr(pod, "POINTS", 10)
    monkeypatch.setattr(pod, "MORE", 4)
    a, w = decaying(n, side), pod.grid_weights(side, "chebyshev")
    df = frame(spark, a)
    fitted = pod.fit(df, "values", w, keep=8)
    _, sigma, modes = svd(a, w)
    assert np.allclose(fitted.sigma, sigma[:8], rtol=1e-12) and fitted.modes.shape == (8, side * side) and 0 <= fitted.residual <= 1e-10
    assert np.allclose(np.abs(np.einsum("ij,ij->i", fitted.modes, modes[:8])), 1, atol=1e-7)
    assert np.isclose(fitted.energy, (sigma**2).sum(), rtol=1e-12)
    pod.check(fitted, df, "values")
    ranks = {r.fraction: r["rank"] for r in pod.energy_ranks(pod.spectrum(spark, fitted), [0.5, 0.9999999]).collect()}
    share = np.cumsum(sigma**2) / (sigma**2).sum()
    assert ranks == {0.5: int(np.argmax(share >= 0.5)) + 1, 0.9999999: None}


def test_two_thousand_samples(spark, monkeypatch):
    a, w = decaying(2000, 21, seed=2, power=0.8), pod.grid_weights(21, "chebyshev")
    df, want = frame(spark, a, 8), svd(a, w)[1]
    whole = pod.fit(df, "values", w)
    pod.check(whole, df, "values")
    assert np.allclose(whole.sigma, want, rtol=1e-10) and whole.residual is None
    monkeypatch.setattr(pod, "MOST_NUMBERS", 1000)
    lead = pod.fit(df, "values", w, keep=16)
    pod.check(lead, df, "values")
    assert np.allclose(lead.sigma, want[:16], rtol=1e-12)


def test_fewer_directions_than_asked_for(spark, monkeypatch):
    monkeypatch.setattr(pod, "MOST_NUMBERS", 10)
    rng = np.random.default_rng(3)
    a = rng.normal(size=(50, 3)) @ rng.normal(size=(3, 49)) + 2
    fitted = pod.fit(frame(spark, a), "values", pod.grid_weights(7, "uniform"), keep=6)
    want = svd(a, pod.grid_weights(7, "uniform"))[1]
    assert np.allclose(fitted.sigma[:3], want[:3], rtol=1e-10) and (fitted.sigma[3:] < 1e-10 * want[0]).all()
    same = pod.fit(frame(spark, np.ones((4, 49))), "values", pod.grid_weights(7, "uniform"), keep=2)
    assert (same.sigma < 1e-12).all()


def test_wrong_decompositions_are_found(spark, monkeypatch):
    a, w = decaying(80, 6, seed=4), pod.grid_weights(6, "chebyshev")
    df = frame(spark, a)
    fitted = pod.fit(df, "values", w)
    pod.check(fitted, df, "values")
    good = fitted.modes
    for modes in (good[::-1], np.vstack([good[:1], good[:1], good[2:]]), np.linalg.qr(np.random.default_rng(0).normal(size=good.T.shape))[0].T):
        fitted.modes = modes
        pod.check(fitted)
        with pytest.raises(ValueError):
            pod.check(fitted, df, "values")
    fitted.modes, fitted.sigma = good, fitted.sigma * 1.001
    with pytest.raises(ValueError):
        pod.check(fitted)
    monkeypatch.setattr(pod, "MOST_NUMBERS", 10)
    with pytest.raises(ValueError, match="how many modes"):
        pod.fit(df, "values", w)
    monkeypatch.setattr(pod, "PASSES", 1)
    with pytest.raises(ValueError, match="residual"):
        pod.check(pod.fit(df, "values", w, keep=4), df, "values")


def test_null_fields_and_wrong_sizes(spark):
    a, w = decaying(30, 4), pod.grid_weights(4, "chebyshev")
    df = frame(spark, a)
    more = df.unionByName(spark.createDataFrame([(99, None)], df.schema))
    assert np.allclose(pod.fit(more, "values", w).sigma, svd(a, w)[1])
    with pytest.raises(ValueError):
        pod.fit(df, "values", pod.grid_weights(5, "chebyshev"))
    with pytest.raises(ValueError):
        pod.fit(df, "values", -w)


def test_fits_by_grid(spark):
    n = 12
    rng = np.random.default_rng(5)
    x = grids.chebyshev(n)
    bump = (1 - x[:, None] ** 2) * (1 - x[None, :] ** 2)
    a = np.array([bump * (c[0] + c[1] * x[:, None] + c[2] * x[None, :] ** 2) for c in rng.normal(size=(40, 3))]).reshape(40, -1)
    df = frame(spark, a)
    fits = pod.grid_fits(df, "values", n, [11, 6])
    for name, s in (("cgl", None), ("s=11", 11), ("s=6", 6)):
        down = np.eye(n) if s is None else grids.to_uniform(n, s)
        w = pod.grid_weights(n, "chebyshev") if s is None else pod.grid_weights(s, "uniform")
        b = (down @ a.reshape(-1, n, n) @ down.T).reshape(40, -1)
        assert np.allclose(fits[name].sigma[:3], svd(b, w)[1][:3], rtol=1e-9)
        pod.check(fits[name])
    spectra = pod.grid_spectra(spark, fits, field="u")
    got = {r.grid: r for r in pod.grid_summary(spectra, "cgl", 40, "field").collect()}
    assert got["cgl"].ratio == 1 and all(r.directions == 3 for r in got.values()) and abs(got["s=11"].ratio - 1) < 0.1
    ratios = {(r.grid, r.i): r.ratio for r in pod.against_grid(spectra, "cgl", "field").where("i < 3").collect()}
    assert all(abs(ratios["s=11", i] - 1) < 0.1 for i in range(3))
    ranks = {(r.grid, r.fraction): r["rank"] for r in pod.energy_ranks(spectra, [0.999999], "field", "grid").collect()}
    assert set(ranks.values()) == {3}
