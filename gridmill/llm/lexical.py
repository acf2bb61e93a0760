"""Ranked lexical search by dense matrix products: tiles of items' term weights times tiles of documents' impacts.

Texts are read once: a document leaves its length and how often it holds each term of the items.
Documents' tiles are then multiplied with tiles of a few items over the terms of just these items.
All numbers are whole, and a tile has no more terms than keep its sums under 2^53, so products in
doubles are exact; sums over several tiles of terms are added as 64-bit numbers."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm.common import per_batch, saved

#: Documents, items and terms of a tile.
DOCS, ITEMS, TERMS = 512, 64, 4096
#: Bytes of text split into terms at once, besides the rest of a term.
STRETCH = 1 << 20
#: Terms of items, counted once an item, that are searched in one pass over the documents; more
#: items are searched in several passes.
PASS_TERMS = 1 << 17

# fixed values of the score
IMPACT, TF, LENGTH, SHARE = 1_000_000_000, 1000, 8, 90

#: Letters and digits of ASCII lowered, other ASCII to blanks; bytes of other characters as they are.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, by stretches."""
    at = 0
    while at < len(raw):
        found = _GAP.search(raw, at + STRETCH) if len(raw) - at > STRETCH else None
        end = found.start() if found else len(raw)
        yield raw[at:end].translate(_TERMS).split()
        at = end


def _bytes(column: pa.Array) -> Iterator[bytes]:
    """Texts as bytes; null as empty."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): every term of every item once; rows that share an id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw in zip(b.column(0), _bytes(b.column(1)), strict=True):
                found = sorted({t for part in terms(raw) for t in part})
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(found), b.column(0).type), pa.array(found, pa.binary())], ["item_id", "term"])

    kind = dict(items.dtypes)["item_id"]
    return per_batch(items.select("item_id", "text"), run, f"item_id {kind}, term binary").distinct()


def _counted(docs: DataFrame, places: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, at, tf): a document's terms with repeats, and the places and counts of those in `places`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ends, at, tf = [], [0], [], []
            for raw in _bytes(b.column(1)):
                n, held = 0, Counter()
                for part in terms(raw):
                    n += len(part)
                    held.update(filter(places.__contains__, part))
                lengths.append(n)
                at += map(places.__getitem__, held)
                tf += held.values()
                ends.append(len(at))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (at, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "at", "tf"])

    kind = dict(docs.dtypes)["doc_id"]
    return per_batch(docs.select("doc_id", "text"), run, f"doc_id {kind}, n long, at array<int>, tf array<int>")


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def damping(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents of n terms each."""
    kind = np.int64 if SHARE * int(n.max(initial=0)) * documents < 1 << 63 else object
    return (100 - SHARE + SHARE * n.astype(kind) * documents // total).astype(np.int64)


class Tiles:
    """Items in tiles: of each tile its items, the places of its terms, and the weights as (item, term, weight)."""

    def __init__(self, held: list[list[int]], weights: np.ndarray):
        """held: of each item the places of its terms; weights: by place, all under 2^53 / IMPACT * TF."""
        self.size, self.tiles = len(weights), []
        #: with so many terms a sum of weight times impact stays under 2^53
        self.width = max(1, min(TERMS, (1 << 53) // (max(1, int(weights.max(initial=1))) * (IMPACT // TF))))
        for i in range(0, len(held), ITEMS):
            some = held[i : i + ITEMS]
            flat = np.array([p for x in some for p in x], np.int64)
            own = np.repeat(np.arange(len(some)), [len(x) for x in some])
            places, column = np.unique(flat, return_inverse=True)
            self.tiles.append((i, len(some), places, own, column, weights[flat].astype(float)))

    def scores(self, doc: np.ndarray, at: np.ndarray, impact: np.ndarray, docs: int) -> Iterator[tuple[int, np.ndarray]]:
        """Of each tile of items the first one's number and the scores [items, docs] of a tile of documents,
        whose entries are (doc, at, impact)."""
        for first, items, places, own, column, w in self.tiles:
            place = np.full(self.size, -1, np.int64)
            place[places] = np.arange(len(places))
            mine = place[at]
            total = np.zeros((items, docs), np.int64)
            for c in range(0, len(places), self.width):
                width = min(self.width, len(places) - c)
                left, right = np.zeros((items, width)), np.zeros((width, docs))
                pick = (column >= c) & (column < c + width)
                left[own[pick], column[pick] - c] = w[pick]
                pick = (mine >= c) & (mine < c + width)
                right[mine[pick] - c, doc[pick]] = impact[pick]
                total += (left @ right).astype(np.int64)
            yield first, total


class _Best:
    """The k highest scores of each item so far; equal scores by ascending id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.zeros(items, np.int64)
        self.item = self.score = self.id = np.zeros(0, np.int64)
        self.none = np.zeros(0, bool)

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        item, score, ids, none = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.id, ids), (self.none, none)))
        order = np.lexsort((ids, none, -score, item))
        item = item[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        order, item = order[nth < self.k], item[nth < self.k]
        self.item, self.score, self.id, self.none = item, score[order], ids[order], none[order]
        last = nth[nth < self.k] == self.k - 1
        self.floor[item[last]] = self.score[last]


def _ranked(counted: DataFrame, items: list, kind: str, tiles: Tiles, documents: int, total: int, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(items), k)
        for whole in batches:
            for b in (whole.slice(i, DOCS) for i in range(0, whole.num_rows, DOCS)):
                n, ids = b.column(1).to_numpy(), b.column(0)
                none = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                doc = np.repeat(np.arange(len(n)), np.diff(b.column(2).offsets.to_numpy()))
                at, tf = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy().astype(np.int64)
                if not len(at):
                    continue
                impact = IMPACT * tf // (TF * tf + LENGTH * damping(n, documents, total)[doc])
                for first, scores in tiles.scores(doc, at, impact, len(n)):
                    floor = best.floor[first : first + len(scores)]
                    i, j = np.nonzero((scores > 0) & (scores >= floor[:, None]))
                    if len(i):
                        best.add(i + first, scores[i, j], ids[j], none[j])
        found = [pa.array(best.item, pa.int32()), pa.array(best.id, pa.int64(), mask=best.none), pa.array(best.score)]
        yield pa.RecordBatch.from_arrays(found, ["item", "doc_id", "score"])

    rows = per_batch(counted, run, "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # a row an item of the pass
    names = rows.sparkSession.createDataFrame(list(enumerate(items)), f"item int, item_id {kind}")
    return top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k documents that score highest for each item, exactly.

    docs: doc_id (whole number), text; items: item_id, text; other columns are ignored. Terms are runs
    of ASCII letters and digits and of all characters beyond ASCII, with A-Z lowered. A null or empty
    text has no term: such a document is not counted and never found, such an item gets no rows, nor
    does one whose terms no document holds. Rows that share an item id (null is one too) are one item
    with all their terms. Every document row is ranked, repeated ones each; equal scores go by
    ascending doc_id, null last. Fewer documents with a score above 0 than k are all given; empty
    tables give no rows.
    Returns item_id, rank (from 1), doc_id, score."""
    spark, kind = docs.sparkSession, dict(items.dtypes)["item_id"]
    held = saved(item_terms(items), "item-terms")
    passes = max(1, -(-held.count() // PASS_TERMS))
    held = held.withColumn("pass", F.pmod(F.xxhash64("item_id"), F.lit(passes)))
    out, stats = None, None
    for i in range(passes):
        # about PASS_TERMS rows
        rows = held.where(F.col("pass") == i).select("item_id", "term").collect()
        places: dict[bytes, int] = {}
        own: dict[object, list[int]] = {}
        for r in rows:
            own.setdefault(r.item_id, []).append(places.setdefault(bytes(r.term), len(places)))
        counted = saved(_counted(docs, places), "counted")
        if stats is None:
            stats = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        df = np.zeros(len(places), np.int64)
        # a row a term of the pass
        for r in counted.select(F.explode("at").alias("at")).groupBy("at").count().collect():
            df[r["at"]] = r["count"]
        weights = np.array([weight(stats.documents, int(d)) for d in df], np.int64)
        found = _ranked(counted, list(own), kind, Tiles(list(own.values()), weights), stats.documents, stats.total, k)
        out = found if out is None else out.unionByName(found)
    return out
