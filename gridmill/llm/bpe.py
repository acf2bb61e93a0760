"""Byte-pair encoding and decoding as a streaming transducer of constant memory.

`Encoder.feed` takes a text in stretches and returns the ids that no later character can change.
Two lookaheads make an id stable: a word is complete once a character of another class follows, and
inside a word longer than the window a boundary is kept once every end that a later token could
start from leads back to it. As no token is longer than the longest merge result, those ends lie in
the last `lookahead` symbols. `Decoder` turns ids back into text one id at a time and holds at most
the bytes of one unfinished character."""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from gridmill.llm import pretoken
from gridmill.llm.common import per_batch

#: Words, shorter than HEAP bytes, whose ids a task remembers since it last put older ones aside; those
#: it keeps, as many again, until the next time.
MEMORY = 150_000
#: Pairs of tokens whose fit is remembered.
FITS = 50_000
#: Symbols of one word from which its ids are emitted while it is still being read.
WINDOW = 1 << 12

#: Symbols from which a word is merged by a heap.
HEAP = 48
_NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    shifted = {b: 256 + i for i, b in enumerate(others)}
    return [chr(shifted.get(b, b)) for b in range(256)]


class Merges:
    """Vocabulary and merge list of a tokenizer file, with the lookahead they need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        self.vocab: dict[str, int] = dict(model["vocab"])
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.rank = {m: i for i, m in enumerate(pairs)}
        self.alphabet = byte_alphabet()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.normalize = spec.get("normalizer") is not None
        self.decoder = (spec.get("decoder") or {}).get("type")
        pre = spec["pre_tokenizer"]
        first = pre["pretokenizers"][0] if pre["type"] == "Sequence" else pre
        self.keep_gaps = first["type"] == "ByteLevel"
        self.pattern = pretoken.PATTERN if self.keep_gaps else first["pattern"]["Regex"]
        self.tokens = {i: t for t, i in (self.vocab | self.added).items()}
        # the same in numbers: pairs of ids to ranks, ranks to ids, first and last bytes to ids
        number = lambda t: self.vocab.get(t, -1)
        self.pair = {number(a) << 20 | number(b): i for (a, b), i in self.rank.items()}
        self.made = [number(a + b) for a, b in self.rank]
        self.inner, self.last = [number(c) for c in self.alphabet], [number(c + self.suffix) for c in self.alphabet]
        # tokens of the vocabulary that were tried, so no more than it has
        self.known: dict[str, bool] = {}
        # no token covers more symbols: beyond this no later character reaches back
        self.lookahead = max((len(t.removesuffix(self.suffix)) for t in self.vocab), default=1)

    def merge(self, symbols: list[str]) -> list[str]:
        """Applies the merge list, lowest rank first and leftmost first among equals."""
        if len(symbols) >= HEAP:
            return self._merge_long(symbols)
        rank = self.rank.get
        ranks = [rank(pair, _NEVER) for pair in zip(symbols, symbols[1:], strict=False)]
        while ranks and (best := min(ranks)) < _NEVER:
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), _NEVER)
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), _NEVER)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap of the pairs and links between the symbols."""
        rank, n = self.rank.get, len(symbols)
        part, after, before = [*symbols], [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank((a, b))) is not None]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue  # one of the two is merged since
            part[i], part[j], after[i] = a + b, "", after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank((part[i], part[after[i]]))) is not None:
                    heappush(heap, (r, i, part[i], part[after[i]]))
            if before[i] >= 0 and (r := rank((part[before[i]], part[i]))) is not None:
                heappush(heap, (r, before[i], part[before[i]], part[i]))
        return [x for x in part if x]

    def whole(self, token: str) -> bool:
        """Whether the symbols of a token merge to it."""
        if token not in self.known:
            self.known[token] = token in self.vocab and self.merge([*token]) == [token]
        return self.known[token]

    def ids(self, symbols: Iterable[str]) -> list[int]:
        """Ids of the tokens; symbols outside the vocabulary have none."""
        return [i for s in symbols if (i := self.vocab.get(s)) is not None]

    def symbols(self, word: str) -> str:
        return "".join(map(self.alphabet.__getitem__, word.encode("utf-8", "surrogatepass")))

    def word(self, word: str) -> list[int]:
        """Ids of a complete word."""
        raw = word.encode("utf-8", "surrogatepass")
        if 0 < len(raw) < HEAP:
            return self._merge_ids([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]])
        s = self.symbols(word)
        if len(s) > WINDOW:
            long = LongWord(self)
            return list(chain(*(long.feed(s[i : i + WINDOW]) for i in range(0, len(s), WINDOW)), long.end()))
        return self.ids(self.merge([*s[:-1], s[-1] + self.suffix])) if s else []

    def _merge_ids(self, ids: list[int]) -> list[int]:
        """merge() of a short word in numbers; -1 is a symbol outside the vocabulary."""
        rank, made = self.pair.get, self.made
        ranks = [rank(a << 20 | b, _NEVER) for a, b in pairwise(ids)]
        while ranks and (best := min(ranks)) < _NEVER:
            i = ranks.index(best)
            ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 20 | ids[i + 1], _NEVER)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | ids[i], _NEVER)
        return [i for i in ids if i >= 0] if -1 in ids else ids


class LongWord:
    """Ids of one word read in parts: holds the symbols behind the last stable boundary only.

    back[i] is the start of the only token that can end at i; the last symbol is held until the
    word's end is known, as it may carry the end-of-word suffix."""

    def __init__(self, merges: Merges):
        self.m, self.held, self.back, self.fits = merges, "", [0], {}

    def _fit(self, a: str, b: str) -> bool:
        """Whether token b can follow token a: merging both together gives them back."""
        if len(self.fits) > FITS:
            self.fits.clear()
        if (a, b) not in self.fits:
            self.fits[a, b] = self.m.merge(list(a + b)) == [a, b]
        return self.fits[a, b]

    def feed(self, symbols: str) -> list[int]:
        m, self.held = self.m, self.held + symbols
        s, back = self.held, self.back
        for end in range(len(back), len(s)):
            for start in range(max(0, end - m.lookahead), end):
                t = s[start:end]
                if (end - start == 1 or t in m.vocab and m.whole(t)) and back[start] is not None and (start == 0 or self._fit(s[back[start] : start], t)):
                    back.append(start)
                    break
            else:
                back.append(None)
        ends = {i for i in range(max(0, len(back) - m.lookahead - 1), len(back)) if back[i] is not None}
        while len(ends) > 1:  # back to the boundary that all of them share
            last = max(ends)
            ends = (ends - {last}) | {back[last]}
        cut = ends.pop()
        if not cut:
            return []
        stable, at = [], cut
        while at:
            stable.append(s[back[at] : at])
            at = back[at]
        self.held, self.back = s[cut:], [0]
        return m.ids(reversed(stable))

    def end(self) -> list[int]:
        s = self.held
        return self.m.ids(self.m.merge([*s[:-1], s[-1] + self.m.suffix])) if s else []


class Encoder:
    """Ids of texts; remembers the short words it has met lately."""

    def __init__(self, merges: Merges, odd: bytes):
        self.m, self.known, self.old = merges, {}, {}
        self.split = pretoken.Splitter(merges.path, merges.pattern, merges.normalize, odd)
        self.special = re.compile("|".join(map(re.escape, sorted(merges.added, key=len, reverse=True)))) if merges.added else None

    def _words(self, words: list[str]) -> list[int]:
        missing = {*words}.difference(self.known)
        if len(self.known) > MEMORY:
            self.known, self.old, missing = {}, self.known, {*words}
        known, old = self.known, self.old
        for w in missing:
            known[w] = old.get(w) or tuple(self.m.word(w))
        out = [*chain.from_iterable(map(known.__getitem__, words))]
        for w in missing:
            if len(w) >= HEAP:
                del known[w]
        return out

    def feed(self, stretch: str) -> list[int]:
        """Ids of a stretch, all of them stable."""
        out: list[int] = []
        at = 0
        for found in self.special.finditer(stretch) if self.special else ():
            out += self._words(self.split(stretch[at : found.start()]))
            out.append(self.m.added[found.group()])
            at = found.end()
        out += self._words(self.split(stretch[at:]))
        return out


class Decoder:
    """Text of ids, one id after another.

    Without a decoder in the tokenizer file tokens are joined by blanks; with the byte-level one
    their bytes are read as UTF-8, and bytes that form no character become U+FFFD."""

    def __init__(self, merges: Merges):
        self.m, self.first = merges, True
        self.bytes = {c: b for b, c in enumerate(merges.alphabet)} if merges.decoder == "ByteLevel" else None
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        """Text that is certain after these ids; unknown ids give nothing."""
        tokens = self.m.tokens
        found = [tokens[i] for i in ids if i in tokens]
        if self.bytes is not None:
            return self.utf8.decode(b"".join(self._bytes(t) for t in found))
        if not found:
            return ""
        text = " ".join(found) if self.first else " " + " ".join(found)
        self.first = False
        return text

    def _bytes(self, token: str) -> bytes:
        if all(c in self.bytes for c in token):
            return bytes(self.bytes[c] for c in token)
        return token.encode("utf-8")

    def end(self) -> str:
        return self.utf8.decode(b"", True) if self.bytes is not None else ""


def encode_decode(docs: DataFrame, vocabulary: str, texts: bool = False) -> DataFrame:
    """Ids of every row's whole text, and the text decoded from them, stretch by stretch.

    docs: doc_id, text; other columns are ignored. A null or empty text has no ids and the empty
    decoded text; repeated rows each give a row; a null id stays null; an empty table gives none.
    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one blank), decoded_sha256
    (of the decoded text in UTF-8); with texts also ids and decoded themselves."""

    odd = pretoken.packed(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(vocabulary)
        encoder, shown = Encoder(merges, odd), {i: str(i) for i in merges.tokens}
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n, of_ids, of_text, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(merges)
                every, said = [], []
                for stretch in pretoken.stretches(text.as_py() or ""):
                    ids = encoder.feed(stretch)
                    if ids:
                        of_ids.update(((" " if n else "") + " ".join(map(shown.__getitem__, ids))).encode())
                        n += len(ids)
                    part = decoder.feed(ids)
                    of_text.update(part.encode())
                    if texts:
                        every += ids
                        said.append(part)
                part = decoder.end()
                of_text.update(part.encode())
                rows.append((doc_id, n, of_ids.hexdigest(), of_text.hexdigest()) + ((every, "".join([*said, part])) if texts else ()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * texts
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=False)] if rows else [pa.array([], k) for k in kinds], names[: len(kinds)])

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts
    return per_batch(docs.select("doc_id", "text"), run, kind)
