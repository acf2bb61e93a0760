"""Seeded permutations of 0..n-1 by arithmetic: a number's place is computed, not sorted for.

Numbers are cut in two, x = left * b + right with left < a and right < b, and rounds add a hash of
one part to the other, modulo its size; each round can be undone, so together they permute 0..a*b-1.
a and b are chosen with a * b just over n, and a number that leaves 0..n-1 is put through again until
it is back, a * b - n times at most."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs of rounds.
PAIRS = 4
#: Sizes of the left part that are tried for a small excess.
TRIED = 2048
# fixed values of the hash
PRIME, FACTOR, SEED_FACTOR, STEP = (1 << 31) - 1, 48_271, 1_000_003, 7_919


@dataclass(frozen=True)
class Permutation:
    """Of 0..n-1, n up to 2^50, for any seed and epoch."""

    n: int
    a: int
    b: int

    @staticmethod
    def of(n: int) -> Permutation:
        root = max(1, math.isqrt(max(n - 1, 0)) + 1)
        a = min(range(root, root + min(TRIED, root)), key=lambda s: (s * -(-n // s) - n, s))
        return Permutation(n, a, max(1, -(-n // a)))

    @property
    def walks(self) -> int:
        """Numbers outside 0..n-1 that are permuted too."""
        return self.a * self.b - self.n

    def place(self, x: Column, seed: int, epoch: Column) -> Column:
        """Place of number x in the order of a seed and an epoch."""
        return self._walked(x, lambda v: self._rounds(v, seed, epoch))

    def number(self, place: Column, seed: int, epoch: Column) -> Column:
        """The number at a place: what place() undoes."""
        return self._walked(place, lambda v: self._undone(v, seed, epoch))

    def _walked(self, x: Column, once) -> Column:
        first = once(x.cast("long"))
        if not self.walks:
            return first
        # few numbers go further than once
        on = lambda start: F.aggregate(F.sequence(F.lit(1), F.lit(self.walks)), start, lambda v, _: F.when(v < self.n, v).otherwise(once(v)))
        return F.transform(F.array(first), lambda v: F.when(v < self.n, v).otherwise(on(v)))[0]

    def _parts(self, v: Column) -> Column:
        right = v % self.b
        # a multiple of b over b is exact in doubles
        return F.struct(((v - right) / self.b).cast("long").alias("l"), right.alias("r"))

    def _rounds(self, v: Column, seed: int, epoch: Column) -> Column:
        def pair(s: Column, k: Column) -> Column:
            left = (s["l"] + _hash(s["r"], k["one"])) % self.a
            return F.transform(F.array(left), lambda x: F.struct(x.alias("l"), ((s["r"] + _hash(x, k["two"])) % self.b).alias("r")))[0]

        return F.aggregate(_keys(seed, epoch), self._parts(v), pair, lambda s: s["l"] * self.b + s["r"])

    def _undone(self, v: Column, seed: int, epoch: Column) -> Column:
        def pair(s: Column, k: Column) -> Column:
            right = F.pmod(s["r"] - _hash(s["l"], k["two"]), F.lit(self.b))
            return F.transform(F.array(right), lambda x: F.struct(F.pmod(s["l"] - _hash(x, k["one"]), F.lit(self.a)).alias("l"), x.alias("r")))[0]

        return F.aggregate(F.reverse(_keys(seed, epoch)), self._parts(v), pair, lambda s: s["l"] * self.b + s["r"])


def _hash(x: Column, key: Column) -> Column:
    """A number under the prime; 64 bits hold all that is computed."""
    mixed = (x % PRIME * FACTOR + key) % PRIME
    return F.transform(F.array(mixed), lambda q: q.bitwiseXOR(F.shiftright(q, 15)) * FACTOR % PRIME)[0]


def _keys(seed: int, epoch: Column) -> Column:
    """Keys of the pairs of rounds."""
    base = (F.lit(seed % PRIME * SEED_FACTOR % PRIME) + F.pmod(epoch.cast("long"), F.lit(PRIME))) % PRIME * FACTOR
    at = lambda i: (base + i * STEP) % PRIME
    return F.array(*(F.struct(at(2 * i + 1).alias("one"), at(2 * i + 2).alias("two")) for i in range(PAIRS)))


def sql(source: str, seed: int) -> str:
    """place() before any walk in SQL: the rows of `source` (x, epoch, a, b and others) with a column y."""
    key = lambda i: f"(({seed % PRIME * SEED_FACTOR % PRIME} + epoch) % {PRIME} * {FACTOR} + {i * STEP}) % {PRIME}"
    out = f"(SELECT *, x // b AS l, x % b AS r FROM {source})"
    for i in range(PAIRS):
        for k, (to, of, size) in enumerate((("l", "r", "a"), ("r", "l", "b"))):
            out = f"(SELECT *, ({of} % {PRIME} * {FACTOR} + {key(2 * i + k + 1)}) % {PRIME} AS q FROM {out})"
            out = f"(SELECT * EXCLUDE (q, {to}), ({to} + xor(q, q >> 15) * {FACTOR} % {PRIME}) % {size} AS {to} FROM {out})"
    return f"(SELECT *, l * b + r AS y FROM {out})"


def plain(p: Permutation, x: int, seed: int, epoch: int) -> int:
    """place() of one number, for checks."""
    base = (seed % PRIME * SEED_FACTOR % PRIME + epoch % PRIME) % PRIME * FACTOR

    def hashed(v: int, i: int) -> int:
        q = (v % PRIME * FACTOR + (base + i * STEP) % PRIME) % PRIME
        return (q ^ q >> 15) * FACTOR % PRIME

    while True:
        left, right = divmod(x, p.b)
        for i in range(PAIRS):
            left = (left + hashed(right, 2 * i + 1)) % p.a
            right = (right + hashed(left, 2 * i + 2)) % p.b
        x = left * p.b + right
        if x < p.n:
            return x
