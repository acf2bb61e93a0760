"""64-bit hashes of a text's words, computed over whole stretches of text at once."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Characters hashed at once, besides the rest of a word that begins among them.
STRETCH = 1 << 18

# fixed odd multipliers of the hash
_BASE, _MIX_A, _MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX_B)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as many as were needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 4096)
            base, inverse = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            base[0] = inverse[0] = 1
            self.up, self.down = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def hashes(codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """A hash of each run of codes (bytes or code points) that lie inside words, in order."""
    if not len(codes):
        return np.zeros(0, np.uint64)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, last = edges[int(inside[0]) :: 2], edges[1 - int(inside[0]) :: 2]
    starts = np.concatenate([[0], first]) if inside[0] else first
    ends = np.concatenate([last, [len(codes)]]) if inside[-1] else last
    up, down = _powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    # codes count from 1, so that no character is lost in a product
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


@lru_cache(2)
def _table(digits: bool) -> np.ndarray:
    """Whether each code point is a letter or number; with digits also decimal digits and _."""
    points = map(chr, range(sys.maxunicode + 1))
    if digits:
        return np.fromiter((c.isalnum() or c == "_" for c in points), bool, sys.maxunicode + 1)
    return np.fromiter((c.isalnum() and not c.isdecimal() for c in points), bool, sys.maxunicode + 1)


_BYTES = np.ones(256, bool)
_BYTES[[32, *range(9, 14)]] = False
_BLANK = re.compile(rb"[\x20\t-\r]")
_GAP = re.compile(r"\W")


def _cuts(text: str | bytes, gap: re.Pattern) -> Iterator[str | bytes]:
    at = 0
    while len(text) - at > STRETCH:
        found = gap.search(text, at + STRETCH)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def of_text(text: str | None, digits: bool = True) -> np.ndarray:
    """Hashes of the lower-cased words of a text: runs of letters and numbers, with digits also of
    decimal digits and underscores."""
    table = _table(digits)
    out = []
    for part in _cuts((text or "").lower(), _GAP):
        codes = np.frombuffer(part.encode(), np.uint8) if part.isascii() else np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        out.append(hashes(codes, table[codes]))
    return np.concatenate(out)


def of_bytes(text: str | None) -> np.ndarray:
    """Hashes of what ASCII white space separates in a text, with A-Z lowered."""
    out = []
    for part in _cuts((text or "").encode("utf-8", "surrogatepass").lower(), _BLANK):
        codes = np.frombuffer(part, np.uint8)
        out.append(hashes(codes, _BYTES[codes]))
    return np.concatenate(out)
