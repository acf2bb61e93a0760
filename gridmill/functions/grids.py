"""Grids, quadrature weights and the small matrices that move fields between grids."""

from __future__ import annotations

import numpy as np

#: Blending degree of the interpolant from the uniform grid.
DEGREE = 2


def chebyshev(n: int) -> np.ndarray:
    """n Chebyshev-Gauss-Lobatto nodes, ascending, with exact ends and symmetry."""
    return np.sin(np.pi * (2 * np.arange(n) - (n - 1)) / (2 * (n - 1)))


def uniform(s: int) -> np.ndarray:
    """s equally spaced nodes on [-1, 1]."""
    return -1 + 2 * np.arange(s) / (s - 1)


def clenshaw_curtis(n: int) -> np.ndarray:
    """Quadrature weights of the Chebyshev nodes; they sum to 2."""
    last = n - 1
    k = np.arange(1, last // 2 + 1)
    b = np.where(2 * k == last, 1.0, 2.0)
    j = np.arange(n)[:, None]
    inner = 1 - (b / (4 * k**2 - 1) * np.cos(2 * np.pi * j * k / last)).sum(1)
    return np.where((np.arange(n) % last) == 0, 1.0, 2.0) / last * inner


def _barycentric(x: np.ndarray, w: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Interpolation matrix from nodes x with weights w; a target on a node gets its unit row."""
    gap = to[:, None] - x[None, :]
    exact = gap == 0
    terms = w / np.where(exact, 1.0, gap)
    rows = terms / terms.sum(1, keepdims=True)
    hit = exact.any(1)
    rows[hit] = exact[hit]
    return rows


def _signs(n: int) -> np.ndarray:
    return np.where(np.arange(n) % 2, -1.0, 1.0)


def _lobatto_weights(n: int) -> np.ndarray:
    w = _signs(n)
    w[[0, -1]] /= 2
    return w


def _check(n: int, s: int) -> None:
    if n < 4 or s < 3:
        raise ValueError(f"a transfer needs n >= 4 and s >= 3, not n = {n} and s = {s}")


def to_uniform(n: int, s: int) -> np.ndarray:
    """[s, n]: values at n Chebyshev nodes to s uniform ones, by the interpolating polynomial."""
    _check(n, s)
    return _barycentric(chebyshev(n), _lobatto_weights(n), uniform(s))


def to_chebyshev(s: int, n: int, degree: int = DEGREE) -> np.ndarray:
    """[n, s]: values at s uniform nodes to n Chebyshev ones, by blended polynomials of a degree."""
    _check(n, s)
    x, d = uniform(s), min(degree, s - 1)
    w = np.zeros(s)
    for k in range(s):
        for i in range(max(0, k - d), min(k, s - 1 - d) + 1):
            others = [j for j in range(i, i + d + 1) if j != k]
            w[k] += (-1) ** i / np.prod(x[k] - x[others]) if others else (-1) ** i
    return _barycentric(x, w, chebyshev(n))


def _modes(k: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Chebyshev polynomials [x, k]."""
    return np.cos(k[None, :] * np.arccos(np.clip(x, -1, 1))[:, None])


def _coefficients(n: int) -> np.ndarray:
    """[n, n]: values at the Chebyshev nodes to Chebyshev coefficients."""
    return np.linalg.inv(_modes(np.arange(n), chebyshev(n)))


#: Restrictions to the uniform grid, simplest first.
RESTRICTIONS = ("plain", "cell mean", "sharp s-2", "sharp s*pi/2", "smooth s-2", "smooth s*pi/2", "smooth n-1")


def restriction(name: str, n: int, s: int) -> np.ndarray:
    """[s, n]: a restriction by name: interpolation, mean over cells, or with filtered coefficients."""
    if name == "plain":
        return to_uniform(n, s)
    c, k, x = _coefficients(n), np.arange(n), uniform(s)
    if name == "cell mean":
        half = 1 / (s - 1)
        low, high = np.maximum(x - half, -1), np.minimum(x + half, 1)

        def integral(at: np.ndarray) -> np.ndarray:
            up = _modes(np.arange(n + 1), at)
            out = np.empty((len(at), n))
            out[:, 0], out[:, 1:2] = at, (at**2 / 2)[:, None]
            j = np.arange(2, n)
            out[:, 2:] = up[:, j + 1] / (2 * (j + 1)) - up[:, j - 1] / (2 * (j - 1))
            return out

        return (integral(high) - integral(low)) / (high - low)[:, None] @ c
    taper, cut = name.split(" ")
    last = {"s-2": s - 2, "s*pi/2": min(int((s - 2) * np.pi / 2), n - 1), "n-1": n - 1}[cut]
    gain = np.where(k <= last, 1.0 if taper == "sharp" else np.exp(-36.0 * (k / last) ** 8), 0.0)
    return _modes(k, x) * gain @ c


def derivative(n: int) -> np.ndarray:
    """[n, n]: first derivative at the Chebyshev nodes; rows sum to zero by the diagonal."""
    x, w = chebyshev(n), _lobatto_weights(n)
    gap = x[:, None] - x[None, :] + np.eye(n)
    d = w[None, :] / w[:, None] / gap
    np.fill_diagonal(d, 0)
    np.fill_diagonal(d, -d.sum(1))
    return d


def second_derivative(n: int) -> np.ndarray:
    """[n, n]: second derivative at the Chebyshev nodes, with the same diagonal rule."""
    x, d = chebyshev(n), derivative(n)
    gap = x[:, None] - x[None, :] + np.eye(n)
    out = 2 * d * (np.diag(d)[:, None] - 1 / gap)
    np.fill_diagonal(out, 0)
    np.fill_diagonal(out, -out.sum(1))
    return out


class Poisson:
    """Solves -(u_xx + u_yy) = f with u = 0 on the edges of an nx by ny Chebyshev grid."""

    def __init__(self, nx: int, ny: int):
        if min(nx, ny) < 3:
            raise ValueError("a grid needs 3 nodes a side at least")
        self.x, self.y = self._eigen(nx), self._eigen(ny)
        self.scale = -1 / (self.x[0][:, None] + self.y[0][None, :])

    @staticmethod
    def _eigen(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values, vectors = np.linalg.eig(second_derivative(n)[1:-1, 1:-1])
        if np.abs(np.imag(values)).max() > 1e-10 * np.abs(values).max():
            raise ValueError("the second derivative has complex eigenvalues")
        vectors = np.real(vectors)
        return np.real(values), vectors, np.linalg.inv(vectors)

    def __call__(self, f: np.ndarray) -> np.ndarray:
        """f: [samples, nx, ny]; its edges are not read."""
        (_, vx, ix), (_, vy, iy) = self.x, self.y
        u = np.zeros_like(f)
        u[:, 1:-1, 1:-1] = vx @ (ix @ f[:, 1:-1, 1:-1] @ iy.T * self.scale) @ vy.T
        return u
