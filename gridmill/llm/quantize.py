"""Vectors as short codes: parts of a vector replaced by the nearest entry of their codebook.

Distances are compared in whole numbers under the Walsh-Hadamard transform: with parts and entries
filled up with zeros to a power of two, n, squared distances grow by the factor n exactly. The
transform's numbers are ordered by sequency (sign changes of their pattern), so that the first ones
hold most of the distance, and an entry is left out as soon as what it has gathered is over the whole
distance of an entry that looks near."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.common import per_batch, saved

#: Sums of whole numbers of any size travel in digits of so many bits.
DIGIT = 62
#: Labels up to this number are broadcast with their sums; more are joined by shuffle.
BROADCAST_LABELS = 1 << 16
MOST_LONG = (1 << 63) - 1


def sequency(n: int) -> np.ndarray:
    """Walsh-Hadamard matrix of n = 2^k rows, by rising number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(1), kind="stable")]


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 * x): 64-bit numbers if all fit, else Python's."""
    if not x.size or np.abs(x).max() < 2.0**52:
        return np.floor(x * 256).astype(np.int64)
    big = [int(v) * 256 if abs(v) >= 2.0**53 else int(np.floor(v * 256)) for v in x.ravel().tolist()]
    return np.array(big, object).reshape(x.shape)


@dataclass(frozen=True)
class Codebooks:
    """entries: whole numbers [parts, entries, width]."""

    entries: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all numbers by part, entry and position, in decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (ties to the lower one) of every part of x [rows, parts, width], and its squared distance."""
        parts, count, width = self.entries.shape
        rows = len(x)
        if not rows or not width:
            return np.zeros((rows, parts), np.int64), np.zeros((rows, parts), np.int64)
        n = 1 << (width - 1).bit_length()
        most = max(abs(int(v)) for a in (x, self.entries) for v in (a.max(), a.min()))
        # n numbers of up to 2 * n * most, squared and summed
        kind = np.int64 if 4 * n**3 * most**2 < 1 << 62 else object
        turn = sequency(n)[:, :width].astype(kind)
        a, b = x.astype(kind) @ turn.T, self.entries.astype(kind) @ turn.T
        near = (a[:, :, None, 0] - b[None, :, :, 0]) ** 2  # [rows, parts, entries]
        guess = near.argmin(2)
        bound = ((a - b[np.arange(parts), guess]) ** 2).sum(2)
        r, p, e = np.nonzero(near <= bound[:, :, None])
        gathered = near[r, p, e]
        for s in range(1, n):
            gathered = gathered + (a[r, p, s] - b[p, e, s]) ** 2
            on = gathered <= bound[r, p]
            r, p, e, gathered = r[on], p[on], e[on], gathered[on]
        # what is left lies by row, part and entry; every part has its guess left at least
        first = np.flatnonzero(np.concatenate([[True], (np.diff(r) != 0) | (np.diff(p) != 0)]))
        least = np.minimum.reduceat(gathered, first)
        hit = gathered == np.repeat(least, np.diff(np.append(first, len(r))))
        at = np.flatnonzero(hit)
        _, one = np.unique(r[at] * parts + p[at], return_index=True)
        return e[at[one]].reshape(rows, parts), (least // n).reshape(rows, parts)


def _kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x of the vectors that take part."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    return vectors.where(F.coalesce(good, F.lit(False))).select("vec_id", label.alias("label"), F.col("embedding").cast("array<double>").alias("x"))


def _cut(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """Lists of numbers as whole numbers [rows, parts, width]; short parts end in zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(set(sizes.tolist())) == 1 and sizes[0] == parts * width:
        return whole(flat.reshape(len(sizes), parts, width))
    out, ends = np.zeros((len(sizes), parts, width)), np.cumsum(sizes)
    for size in set(sizes.tolist()) - {0}:
        mine, each = np.flatnonzero(sizes == size), -(-size // parts)
        rows = np.zeros((len(mine), parts * each))
        rows[:, :size] = flat[(ends[mine] - size)[:, None] + np.arange(size)]
        out[mine, :, :each] = rows.reshape(len(mine), parts, each)
    return whole(out)


def _moved(kept: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks with each entry at the floor of the mean of the parts nearest to it.

    A task sends one row of sums for every entry and position that it has met; the sums of all
    tasks, as many numbers as the codebooks have, come to the driver."""
    parts, count, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, count, width), object), np.zeros((parts, count), np.int64)
        for b in batches:
            x = _cut(b.column(0), parts, width)
            codes, _ = books.nearest(x)
            own = np.zeros((parts, count, width), x.dtype)
            np.add.at(own, (np.arange(parts), codes), x)
            np.add.at(counts, (np.arange(parts), codes), 1)
            sums += own
        found = []
        for p, e in zip(*np.nonzero(counts), strict=True):
            found.append((p, e, -1, 0, int(counts[p, e])))
            for at, v in enumerate(sums[p, e].tolist()):
                sign, digit, v = (-1 if v < 0 else 1), 0, abs(int(v))
                while v:
                    found.append((p, e, at, digit, sign * (v & (1 << DIGIT) - 1)))
                    v, digit = v >> DIGIT, digit + 1
        kinds = [pa.int32()] * 4 + [pa.decimal128(38)]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["part", "entry", "at", "digit", "total"])

    sums = per_batch(kept.select("x"), run, "part int, entry int, at int, digit int, total decimal(38,0)")
    total, size = np.zeros((parts, count, width), object), np.zeros((parts, count), object)
    for r in sums.groupBy("part", "entry", "at", "digit").agg(F.sum("total").alias("total")).collect():
        if r["at"] < 0:
            size[r.part, r.entry] = int(r.total)
        else:
            total[r.part, r.entry, r["at"]] += int(r.total) << DIGIT * r.digit
    out = books.entries.astype(object)
    for p, e in zip(*np.nonzero(size), strict=True):
        out[p, e] = [int(t) // int(size[p, e]) for t in total[p, e]]
    return Codebooks(_narrow(out))


def _narrow(x: np.ndarray) -> np.ndarray:
    """As 64-bit numbers if all fit."""
    return x.astype(np.int64) if all(abs(int(v)) < 1 << 62 for v in x.ravel()) else x


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks | None:
    """Codebooks of the vectors' parts, begun with the vectors of the smallest ids; None without vectors.

    Takes what encode() takes. The driver holds the codebooks: `entries` vectors."""
    kept = _kept(vectors)
    longest = kept.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return None
    begun = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").toArrow().column("x").combine_chunks()
    begun = begun.combine_chunks() if isinstance(begun, pa.ChunkedArray) else begun
    books = Codebooks(_narrow(_cut(begun, parts, -(-longest // parts)).swapaxes(0, 1).copy()))
    for _ in range(rounds):
        books = _moved(kept, books)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, codes (array of entry numbers in part order), error of every vector that takes part.

    vectors: vec_id, embedding and, if there is one, label; other columns are ignored. A null vector
    or one with a component that is null or not finite takes no part. Components count as
    floor(256 * x), whatever their size. A vector whose length is no multiple of the number of parts
    is cut as if zeros followed; shorter vectors have shorter parts, which end in zeros beside the
    longest ones'. Null ids come after all others, and rows of one id are ordered by their vectors;
    repeated rows each count. An error beyond a long is given as the largest long."""
    parts, _, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, gaps = books.nearest(_cut(b.column(2), parts, width))
            error = [min(v, MOST_LONG) for v in gaps.astype(object).sum(1).tolist()]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * parts), pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(error, pa.int64())], ["vec_id", "label", "codes", "error"])

    kept = _kept(vectors)
    kinds = dict(kept.dtypes)
    return per_batch(kept, run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long")


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id and the vector that its codes stand for, of a whole number of parts."""
    table = books.entries.astype(float) / 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(1).flatten().to_numpy().reshape(-1, len(table))
            x = table[np.arange(len(table)), codes].reshape(len(codes), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["vec_id", "embedding"])

    return per_batch(coded.select("vec_id", "codes"), run, f"vec_id {dict(coded.dtypes)['vec_id']}, embedding array<double>")


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of error over rows of an equal label; null labels are equal too.

    Sums are one row a label, made before the join, so a label of very many rows is no burden."""
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST_LONG)).cast("long").alias("label_error"))
    sums = saved(sums.withColumnRenamed("label", "of"), "label-errors")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def compressed(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """Codes of all vectors under codebooks fitted on them, as encode() says; an empty table gives no rows.

    Returns vec_id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    books = fit(vectors, parts, entries, rounds) or Codebooks(np.zeros((parts, 0, 0), np.int64))
    coded = saved(encode(vectors, books), "codes")
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return label_errors(coded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
