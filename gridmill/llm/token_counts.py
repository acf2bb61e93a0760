"""Token counts of whole texts without making ids for them.

Texts are read in chunks of bounded size. A chunk keeps each document's pre-token frequencies as
packed index/frequency arrays, and its distinct pre-tokens in the order of their hashes. Hash ranges,
as many as keep the pre-tokens of one under RANGE bytes, bring equal pre-tokens of all chunks
together: a task goes through one range after another and counts the pieces of each distinct
pre-token once. The counts go back to their chunks and are multiplied with the frequencies. A
pre-token of every document is met once a chunk, so no range is hot.

The number of ranges grows with the input, a chunk does not: cut into very many ranges it would fall
into crumbs. Beyond FAN ranges chunks are therefore cut into the root of their number only; groups of
chunks merge what they have in such a wide range, and what is distinct there is cut once more."""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridmill.llm import common, pretoken

#: Characters of text that one chunk holds at most, besides its last document.
CHUNK_CHARS = 24_000_000
#: Bytes of the pre-tokens of one hash range, all chunks together.
RANGE = 64 << 20
#: Ranges that a chunk is cut into at once.
FAN = 1024
#: Bytes of pre-tokens, repeats counted, that a group of chunks merges in one wide range.
CELL = 16 << 20
#: Pre-tokens in one row.
TOKENS_A_ROW = 1 << 18


def _tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _specials(t) -> re.Pattern | None:
    """Matches the special strings, which are cut out before a text is split."""
    found = sorted((x.content for x in t.get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, found))) if found else None


def _pieces(t: Tokenizer, tokens: list[str]) -> np.ndarray:
    """How many pieces each of the distinct pre-tokens has."""
    out = np.zeros(len(tokens), np.int32)
    for i in range(0, len(tokens), 4096):
        out[i : i + 4096] = [len(e.ids) for e in t.encode_batch_fast(tokens[i : i + 4096], add_special_tokens=False)]
    return out


class _Chunk:
    """Frequencies of the documents read so far."""

    def __init__(self, specials: re.Pattern | None, split: pretoken.Splitter):
        self.specials, self.split, self.index, self.docs = specials, split, {}, []
        self.at, self.freq, self.chars = [], [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        text, counts, special = text or "", Counter(), 0
        for stretch in pretoken.stretches(text):
            parts = self.specials.split(stretch) if self.specials else [stretch]
            special += len(parts) - 1
            for x in parts:
                counts.update(self.split(x))
        index = self.index
        self.at.append(np.fromiter((index.setdefault(w, len(index)) for w in counts), np.uint32, len(counts)))
        self.freq.append(np.fromiter(counts.values(), np.uint32, len(counts)))
        self.docs.append((doc_id, len(text.encode("utf-8", "surrogatepass")), special))
        self.chars += len(text)

    def rows(self, chunk: int) -> Iterator[pa.RecordBatch]:
        """The documents' frequencies in one row, then the pre-tokens by their hashes."""
        raw = [w.encode("utf-8", "surrogatepass") for w in self.index]
        order = np.argsort(_hashes(raw), kind="stable")
        place = np.empty(len(raw), np.uint32)
        place[order] = np.arange(len(raw), dtype=np.uint32)
        sizes = np.array([len(x) for x in self.at], np.uint32)
        blob = np.concatenate([np.array([len(sizes)], np.uint32), sizes, place[np.concatenate(self.at)], *self.freq])
        yield _batch(chunk, None, None, _shuffled(blob), zip(*self.docs, strict=True))
        for i in range(0, len(raw), TOKENS_A_ROW):
            some = order[i : i + TOKENS_A_ROW]
            yield _batch(chunk, i, sum(len(raw[k]) for k in some), _pack([raw[k] for k in some]), [None] * 3)


def _batch(chunk: int, first: int | None, size: int | None, blob: bytes, lists: Iterable) -> pa.RecordBatch:
    arrays = [pa.array([chunk], pa.int64()), pa.array([first], pa.int32()), pa.array([size], pa.int64()), pa.array([zstandard.compress(blob, 3)]), *(pa.array([x], pa.list_(pa.int64())) for x in lists)]
    return pa.RecordBatch.from_arrays(arrays, ["chunk", "first", "size", "blob", "doc_ids", "n_bytes", "special"])


def _hashes(raw: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh32_intdigest, raw), np.uint32, len(raw))


def _pack(raw: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, raw), np.uint32, len(raw))
    return np.uint32(len(raw)).tobytes() + _shuffled(sizes) + b"".join(raw)


def _unpack(raw: bytes) -> list[bytes]:
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = (np.cumsum(_unshuffled(raw[4 : 4 + 4 * n])) + 4 + 4 * n).tolist()
    return [raw[a:z] for a, z in zip([4 + 4 * n, *ends], ends, strict=False)]


def _shuffled(x: np.ndarray) -> bytes:
    """Byte planes of 32-bit numbers, which compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes()


def _unshuffled(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).reshape(-1).view(np.uint32)


_PARTS = "chunk long, first int, size long, blob binary, doc_ids array<bigint>, n_bytes array<bigint>, special array<bigint>"


_COUNTS = "chunk long, first int, range long, counts binary"
_CELLS = "chunk long, first int, range long, blob binary, cell long, wide int"


def _by_range(raw: list[bytes], hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, list[bytes]]:
    """The hash ranges of pre-tokens in the order of their hashes, and a pack for each."""
    own = hashes.astype(np.uint64) * np.uint64(ranges) >> np.uint64(32)
    edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(raw)]
    return own[edges[:-1]].astype(np.int64), [zstandard.compress(_pack(raw[i:k]), 3) for i, k in zip(edges, edges[1:], strict=False)]


def _cuts(tokens: DataFrame, ranges: int) -> DataFrame:
    """The chunks' pre-tokens in packs of one hash range."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, first, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = _unpack(zstandard.decompress(blob.as_py()))
                own, packs = _by_range(raw, _hashes(raw), ranges)
                arrays = [pa.array([chunk] * len(packs), pa.int64()), pa.array([first] * len(packs), pa.int32()), pa.array(own), pa.array(packs)]
                yield pa.RecordBatch.from_arrays(arrays, ["chunk", "first", "range", "blob"])

    return common.per_batch(tokens.select("chunk", "first", "blob"), cut, "chunk long, first int, range long, blob binary")


def _merged(tokens: DataFrame, ranges: int, size: int, counts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The packs' counts, in wide ranges, by way of what groups of chunks have in each.

    A cell is what one group has in one wide range, CELL bytes on average. Rows of the table of cells
    are a chunk's places among the distinct pre-tokens of its cell, or these in packs of one range."""
    wide = math.isqrt(ranges - 1) + 1
    groups = max(1, -(-size // (wide * CELL)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, packs = None, {}, []

        def cell() -> Iterator[pa.RecordBatch]:
            raw, hashes = [*index], _hashes([*index])
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(raw), np.uint32)
            place[order] = np.arange(len(raw), dtype=np.uint32)
            own, out = _by_range([raw[i] for i in order], hashes[order], wide * wide)
            rows = [(chunk, first, None, zstandard.compress(_shuffled(place[at]), 3)) for chunk, first, at in packs]
            rows += [(None, None, r, blob) for r, blob in zip(own.tolist(), out, strict=True)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            arrays = [pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)]
            arrays += [pa.array([now[0]] * len(rows), pa.int64()), pa.array([now[1]] * len(rows), pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["chunk", "first", "range", "blob", "cell", "wide"])

        for b in batches:
            for chunk, first, at, blob, group in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if (group, at) != now:
                    if packs:
                        yield from cell()
                    now, index, packs = (group, at), {}, []
                raw = _unpack(zstandard.decompress(blob))
                packs.append((chunk, first, np.fromiter((index.setdefault(x, len(index)) for x in raw), np.uint32, len(raw))))
        if packs:
            yield from cell()

    grouped = _cuts(tokens, wide).withColumn("cell", F.pmod(F.xxhash64("chunk"), F.lit(groups)))
    dealt = grouped.repartition("cell", "range").sortWithinPartitions("cell", "range")
    cells = common.saved(common.per_batch(dealt, merge, _CELLS), "cells")
    distinct = cells.where("range is not null").select(F.col("cell").alias("chunk"), F.col("wide").alias("first"), "range", "blob")
    counted = counts(distinct).toDF("cell", "wide", "range", "counts")

    def back(key, left: pa.Table, right: pa.Table) -> pa.Table:
        pieces = np.frombuffer(b"".join(zstandard.decompress(x.as_py()) for x in right.sort_by("range").column("counts")), np.uint32)
        own = [zstandard.compress(pieces[_unshuffled(zstandard.decompress(x.as_py()))].tobytes(), 1) for x in left.column("blob")]
        return pa.table([left.column("chunk"), left.column("first"), left.column("wide").cast(pa.int64()), pa.array(own, pa.binary())], names=["chunk", "first", "range", "counts"])

    places = cells.where("range is null").select("chunk", "first", "cell", "wide", "blob")
    return places.groupBy("cell", "wide").cogroup(counted.groupBy("cell", "wide")).applyInArrow(back, _COUNTS)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """Tokens of every row's whole text, as the tokenizers library counts them.

    docs: doc_id, text; other columns are ignored. vocabulary: path of the byte-level tokenizer file.
    A null or empty text has 0 bytes and 0 tokens; repeated rows and ids each give a row, a null
    id stays null; an empty table gives no rows. Special strings inside a text are one token each.
    Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    odd = pretoken.packed(vocabulary)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials, split = _specials(_tokenizer(vocabulary)), pretoken.Splitter(vocabulary, pretoken.PATTERN, False, odd)
        part, seq, chunk = TaskContext.get().partitionId(), 0, _Chunk(specials, split)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                chunk.add(doc_id, text.as_py())
                if chunk.chars >= CHUNK_CHARS:
                    yield from chunk.rows((part << 32) + seq)
                    chunk, seq = _Chunk(specials, split), seq + 1
        if chunk.docs:
            yield from chunk.rows((part << 32) + seq)

    parts = common.saved(common.per_batch(docs.select("doc_id", "text"), chunks, _PARTS), "pretokens")

    tokens = parts.where("first is not null")
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = tokens.agg(F.sum("size")).first()[0] or 0
    ranges = max(spread, -(-size // RANGE))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, now, known = _tokenizer(vocabulary), None, {}
        for b in batches:
            outs = []
            for own, blob in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                if own != now:
                    now, known = own, {}
                raw = _unpack(zstandard.decompress(blob.as_py()))
                new = [x for x in raw if x not in known]
                known.update(zip(new, _pieces(t, [x.decode("utf-8", "surrogatepass") for x in new]).tolist(), strict=True))
                outs.append(zstandard.compress(np.fromiter(map(known.__getitem__, raw), np.uint32, len(raw)).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(outs, pa.binary())], ["chunk", "first", "range", "counts"])

    def counts(cuts: DataFrame) -> DataFrame:
        return common.per_batch(cuts.repartition("range").sortWithinPartitions("range"), count, _COUNTS)

    counted = counts(_cuts(tokens, ranges)) if ranges <= FAN else _merged(tokens, ranges, size, counts)

    def total(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        counts = right.sort_by([("first", "ascending"), ("range", "ascending")]).column("counts")
        pieces = np.frombuffer(b"".join(zstandard.decompress(x.as_py()) for x in counts), np.uint32).astype(np.int64)
        blob = _unshuffled(zstandard.decompress(row["blob"]))
        n = int(blob[0])
        at, freq = blob[n + 1 :].reshape(2, -1)
        sums = np.array(row["special"], np.int64)
        np.add.at(sums, np.repeat(np.arange(n), blob[1 : n + 1]), pieces[at] * freq)
        return pa.table([pa.array(row["doc_ids"], pa.int64()), pa.array(row["n_bytes"], pa.int64()), pa.array(sums)], names=["doc_id", "n_bytes", "n_tokens"])

    kept = parts.where("first is null").select("chunk", "blob", "doc_ids", "n_bytes", "special")
    sums = kept.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(total, "doc_id long, n_bytes long, n_tokens long")
    return sums.withColumn("over_limit", F.col("n_tokens") > limit)
