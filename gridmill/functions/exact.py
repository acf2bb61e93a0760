"""Sums of doubles that don't depend on the order or grouping of their terms.

A number is cut at fixed powers of two, 2^(WIDTH * k), into whole multiples of them, and the multiples
are added up as 64-bit numbers. The cuts are exact, so the sums are; they are rounded once, at the end."""

from __future__ import annotations

import numpy as np

WIDTH = 32
#: Rows that are cut at once, by their numbers.
NUMBERS = 1 << 20


class Sums:
    """Exact sums of many columns. bins: k -> multiples of 2^(WIDTH * k) of each column; odd: sums of what isn't finite."""

    def __init__(self, columns: int):
        self.columns, self.bins, self.odd = columns, {}, None

    def add(self, a: np.ndarray) -> None:
        """Adds the rows of a [rows, columns]."""
        fine = np.isfinite(a)
        if not fine.all():
            with np.errstate(all="ignore"):
                own = np.where(fine, 0.0, a).sum(0)
                self.odd = own if self.odd is None else self.odd + own
            a = np.where(fine, a, 0.0)
        most = np.abs(a).max(initial=0.0)
        if not most:
            return
        k = int(np.floor(np.frexp(most)[1] / WIDTH))
        rest = a
        while rest.any():
            q = np.rint(np.ldexp(rest, -WIDTH * k))
            self._put(k, q.astype(np.int64).sum(0))
            rest = rest - np.ldexp(q, WIDTH * k)
            k -= 1

    def _put(self, k: int, v: np.ndarray) -> None:
        self.bins[k] = self.bins[k] + v if k in self.bins else v

    def merge(self, other: Sums) -> None:
        for k, v in other.bins.items():
            self._put(k, v)
        if other.odd is not None:
            with np.errstate(all="ignore"):
                self.odd = other.odd if self.odd is None else self.odd + other.odd
        self.carry()

    def carry(self) -> None:
        """Keeps every multiple within 2^(WIDTH - 1) either way, so that more can be added."""
        k = min(self.bins, default=0)
        while k <= max(self.bins, default=-1):
            v = self.bins.get(k)
            if v is not None:
                over = v + (1 << WIDTH - 1) >> WIDTH
                if over.any():
                    self.bins[k] = v - (over << WIDTH)
                    self._put(k + 1, over)
            k += 1

    def whole(self) -> tuple[list[int], int]:
        """The columns' sums as whole numbers of 2^shift."""
        if not self.bins:
            return [0] * self.columns, 0
        low = min(self.bins)
        total = np.zeros(self.columns, object)
        for k, v in self.bins.items():
            total += v.astype(object) << WIDTH * (k - low)
        return total.tolist(), WIDTH * low


def _quotient(a: int, b: int, shift: int) -> float:
    """a * 2^shift / b, rounded once."""
    try:
        return (a << shift) / b if shift >= 0 else a / (b << -shift)
    except OverflowError:
        return float("inf") if a > 0 else float("-inf")


class Moments:
    """Count, sums and sums of squares of columns, merged in any order to the same bits."""

    def __init__(self, columns: int):
        self.n, self.x, self.xx = 0, Sums(columns), Sums(columns)

    def add(self, a: np.ndarray) -> None:
        step = max(1, NUMBERS // max(1, a.shape[1]))
        for i in range(0, len(a), step):
            b = a[i : i + step]
            self.x.add(b)
            with np.errstate(all="ignore"):
                # a square and what its rounding has lost, by halves of 26 bits
                square = b * b
                far = b * 134217729.0
                high = far - (far - b)
                low = b - high
                lost = ((high * high - square) + 2 * high * low) + low * low
            self.xx.add(square)
            self.xx.add(np.where(np.isfinite(square) & np.isfinite(lost), lost, 0.0))
        self.n += len(a)

    def merge(self, other: Moments) -> None:
        self.n += other.n
        self.x.merge(other.x)
        self.xx.merge(other.xx)

    def mean_and_std(self) -> tuple[np.ndarray, np.ndarray | None]:
        """Of every column; with a degree of freedom less for the deviation, which a single row has none of."""
        x, s = self.x.whole()
        mean = np.array([_quotient(v, self.n, s) for v in x])
        if self.x.odd is not None:
            mean = mean + self.x.odd
        if self.n < 2:
            return mean, None
        xx, t = self.xx.whole()
        # n * sum(x^2) - sum(x)^2 in units of the finer of both
        low = min(2 * s, t)
        top = [(self.n * b << t - low) - (a * a << 2 * s - low) for a, b in zip(x, xx, strict=True)]
        var = np.array([_quotient(max(v, 0), self.n * (self.n - 1), low) for v in top])
        return mean, np.sqrt(np.where(self._off(), np.nan, var))

    def _off(self) -> np.ndarray:
        """Columns with something that isn't finite."""
        off = np.zeros(self.x.columns, bool)
        for odd in (self.x.odd, self.xx.odd):
            if odd is not None:
                off |= odd != 0
        return off

    def dump(self) -> tuple[int, list[int], bytes]:
        """(n, names, data): arrays of 8 bytes a column, named by what they hold."""
        names, parts = [], []
        for which, s in enumerate((self.x, self.xx)):
            s.carry()
            for k in sorted(s.bins):
                names.append(which << 16 | k + (1 << 15))
                parts.append(s.bins[k].astype(np.int64).tobytes())
            if s.odd is not None:
                names.append(which + 2 << 16)
                parts.append(s.odd.tobytes())
        return self.n, names, b"".join(parts)

    @staticmethod
    def load(n: int, names: list[int], data: bytes, columns: int) -> Moments:
        out = Moments(columns)
        out.n = n
        for i, name in enumerate(names):
            raw = data[i * 8 * columns : (i + 1) * 8 * columns]
            which = name >> 16
            s = (out.x, out.xx)[which % 2]
            if which < 2:
                s.bins[(name & 0xFFFF) - (1 << 15)] = np.frombuffer(raw, np.int64).copy()
            else:
                s.odd = np.frombuffer(raw).copy()
        return out
