"""Splitting a text into the pre-tokens of a vocabulary, with the character tables of its library.

Python's own patterns split most texts. They know another version of Unicode than the library, and
take some numbers for letters, so every character on which the two disagree is found once, by
comparing them over all code points; texts that hold one are split by the library."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from tokenizers import Regex, Tokenizer, pre_tokenizers

# The published split patterns of the byte-level and of the word-end vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_FAST = {
    PATTERN: re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"),
    WORD_PATTERN: re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+"),
}


#: Characters of text split at once.
STRETCH = 1 << 16
#: Between a visible ASCII character and a line's end or blank followed by one: words end before it
#: in either vocabulary, as a blank belongs to the word behind it.
_CUT = re.compile(r"[!-~](?=[ \n][!-~])")


def stretches(text: str) -> Iterator[str]:
    """Cuts a text where no word, composition or special string can span."""
    at = 0
    while len(text) - at > STRETCH:
        found = _CUT.search(text, at + STRETCH)
        end = found.start() + 1 if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def normal(text: str) -> str:
    """The word-end vocabulary's normal form but for white space: composed and lowered letter by letter."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


#: Characters that pass through the library at once while the tables are compared.
_AT_ONCE = 4096


def _points() -> list[int]:
    return [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]


def _library_classes(text: str) -> dict[str, np.ndarray]:
    """Where the library finds letters, numbers, white space and marks."""
    out = {}
    for name in (r"\p{L}", r"\p{N}", r"\s", r"\p{M}"):
        split, found = pre_tokenizers.Split(Regex(f"(?:{name})+"), "removed", invert=True), np.zeros(len(text), bool)
        for i in range(0, len(text), _AT_ONCE):
            for _, (a, z) in split.pre_tokenize_str(text[i : i + _AT_ONCE]):
                found[i + a : i + z] = True
        out[name] = found
    return out


@lru_cache(8)
def odd_characters(path: str) -> np.ndarray:
    """For each code point whether Python and the library of the tokenizer file disagree on it."""
    points = np.array(_points())
    text = "".join(map(chr, points))
    lib = _library_classes(text)
    own = {
        r"\p{L}": [c.isalnum() and not c.isdecimal() for c in text],
        r"\p{N}": [c.isdecimal() for c in text],
        r"\s": [c.isspace() for c in text],
    }
    bad = np.zeros(len(points), bool)
    for name, found in own.items():
        bad |= np.array(found) != lib[name]
    # marks that Python doesn't know could be ordered otherwise
    bad |= lib[r"\p{M}"] & np.array([unicodedata.category(c) == "Cn" for c in text])
    if normalizer := Tokenizer.from_file(path).normalizer:
        # no character composes with a bar
        for i in range(0, len(text), _AT_ONCE):
            some = text[i : i + _AT_ONCE].replace("|", "a")
            theirs = normalizer.normalize_str("|".join(some))
            for k, x in enumerate(theirs.split("|") if theirs != normal("|".join(some)) else ()):
                bad[i + k] |= x != normal(some[k]) and not (lib[r"\s"][i + k] and x == " ")
    out = np.zeros(sys.maxunicode + 1, bool)
    out[points] = bad
    return out


class Splitter:
    """Pre-tokens of texts by the pattern of a tokenizer file, normalised where the file says so.

    odd: what odd_characters found, as packed bits."""

    def __init__(self, path: str, pattern: str, normalize: bool, odd: bytes):
        self.path, self.pattern, self.normalize = path, pattern, normalize
        self.odd = np.unpackbits(np.frombuffer(odd, np.uint8)).astype(bool)
        self.odd_ascii = [chr(c) for c in np.flatnonzero(self.odd[:128])]
        self.fast = _FAST.get(pattern)
        self._library = None

    def _agrees(self, text: str) -> bool:
        if text.isascii():
            return not any(c in text for c in self.odd_ascii)
        return not self.odd[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any()

    def _exact(self, text: str) -> list[str]:
        if self._library is None:
            split = pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)
            self._library = Tokenizer.from_file(self.path).normalizer, split
        normalizer, split = self._library
        if self.normalize:
            text = normalizer.normalize_str(text)
        return [x for x, _ in split.pre_tokenize_str(text)]

    def __call__(self, text: str) -> list[str]:
        if self.fast is None or not self._agrees(text):
            return self._exact(text)
        if self.normalize:
            plain = normal(text)
            if plain is not text and not self._agrees(plain):
                return self._exact(text)
            text = plain
        return self.fast.findall(text)


def packed(path: str) -> bytes:
    """odd_characters for a task: 139 KB, whatever the input."""
    return np.packbits(odd_characters(path)).tobytes()
