"""The exact seeded permutation of the subset rule, and the fingerprint of chosen rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MASK32, _MASK64 = (1 << 32) - 1, (1 << 64) - 1
# The stream cipher's constant words, the generator that spreads a seed over the key,
# and the 64-bit FNV-1a basis and prime.
SIGMA = (0x61707865, 0x3320646E, 0x79622D32, 0x6B206574)
PCG_STEP, PCG_PLUS = 6364136223846793005, 11634580027462260723
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def _key(seed: int) -> list[int]:
    """Eight key words from a 64-bit seed."""
    state, out = seed, []
    for _ in range(8):
        state = (state * PCG_STEP + PCG_PLUS) & _MASK64
        x, turn = ((state >> 18 ^ state) >> 27) & _MASK32, state >> 59
        out.append((x >> turn | x << (-turn & 31)) & _MASK32)
    return out


def _blocks(key: list[int], counter: int, n: int) -> np.ndarray:
    """Words [n, 16] of n blocks of the eight-round stream, from a counter on."""
    count = np.arange(counter, counter + n, dtype=np.uint64)
    start = [np.full(n, w, np.uint32) for w in (*SIGMA, *key)] + [(count & np.uint64(_MASK32)).astype(np.uint32), (count >> np.uint64(32)).astype(np.uint32)] + [np.zeros(n, np.uint32)] * 2
    w = [x.copy() for x in start]

    def quarter(a: int, b: int, c: int, d: int) -> None:
        for p, q, r, turn in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
            w[p] += w[q]
            x = w[r] ^ w[p]
            w[r] = x << np.uint32(turn) | x >> np.uint32(32 - turn)

    for _ in range(4):
        for i in range(4):
            quarter(i, 4 + i, 8 + i, 12 + i)
        for i in range(4):
            quarter(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4)
    return np.stack([a + b for a, b in zip(w, start, strict=True)], 1)


def _draws(seed: int, at_once: int) -> Iterator[int]:
    """The stream's 64-bit numbers, made so many blocks of eight at once."""
    key, counter = _key(seed), 0
    while True:
        words = _blocks(key, counter, at_once).astype(np.uint64)
        yield from (words[:, ::2] | words[:, 1::2] << np.uint64(32)).ravel().tolist()
        counter += at_once


def subset(population: int, n: int, seed: int) -> list[int]:
    """First n of the seeded permutation of range(population), ascending.

    For one seed a smaller subset lies in every larger one. Only the places that the shuffle has moved
    are held, at most two for each of the n, so a population of any size takes no memory."""
    if n > population:
        raise ValueError(f"{n} of {population} rows")
    moved: dict[int, int] = {}
    out = np.empty(n, np.int64)
    draws = _draws(seed, min(1024, n // 8 + 1))
    for i in range(n):
        left = population - i
        if left > 1:
            limit = _MASK64 - _MASK64 % left
            r = next(draws)
            while r >= limit:
                r = next(draws)
            at = i + r % left
        else:
            at = i
        own = moved.pop(i, i)
        if at == i:
            out[i] = own
        else:
            out[i], moved[at] = moved.get(at, at), own
    out.sort()
    return out.tolist()


#: Stretches that a block of row numbers is cut into, which are hashed side by side.
LANES = 64


class Fnv:
    """FNV-1a of some bytes as a map of the state before them to that after.

    A step xors a byte into the state's low byte and multiplies, so its effect on the other bytes is a
    factor alone. A stretch of bytes is thus a power of the prime and, for each low byte that the state
    can have before it, the state after it if the other bytes are zero."""

    def __init__(self, size: int = 0, after: np.ndarray | None = None):
        """size: bytes; after: by low byte."""
        self.size, self.after = size, np.arange(256, dtype=np.uint64) if after is None else after

    @staticmethod
    def of(rows: np.ndarray) -> Fnv:
        """Of row numbers as little-endian 64-bit words."""
        words = np.ascontiguousarray(rows, np.dtype("<i8")).view(np.uint8).reshape(-1, 8)
        each = len(words) // LANES
        lanes = Fnv._run(words[: each * LANES].reshape(LANES, each * 8)) if each else []
        rest = Fnv._run(words[each * LANES :].reshape(1, -1))
        out = Fnv()
        for part in (*lanes, *rest):
            out = out.then(part)
        return out

    @staticmethod
    def _run(bytes_: np.ndarray) -> list[Fnv]:
        state = np.tile(np.arange(256, dtype=np.uint64), (len(bytes_), 1))
        prime = np.uint64(FNV_PRIME)
        for column in bytes_.T.astype(np.uint64):
            state ^= column[:, None]
            state *= prime
        return [Fnv(bytes_.shape[1], row) for row in state]

    def then(self, other: Fnv) -> Fnv:
        """Of these bytes and then the other's."""
        low = self.after & np.uint64(255)
        factor = np.uint64(pow(FNV_PRIME, other.size, 1 << 64))
        return Fnv(self.size + other.size, (self.after - low) * factor + other.after[low.astype(np.int64)])

    def digest(self) -> str:
        low = FNV_BASIS & 255
        h = ((FNV_BASIS - low) * pow(FNV_PRIME, self.size, 1 << 64) + int(self.after[low])) & _MASK64
        return f"{h:016x}"


def fingerprint(rows: list[int] | np.ndarray) -> str:
    """FNV-1a of the row numbers as little-endian 64-bit words, as 16 hex digits."""
    return Fnv.of(np.asarray(rows, np.int64)).digest()
