"""Toxicity scores from a factorization machine over hashed terms.

A text is the set of its hashed lower-cased words. Besides a weight, every bucket of terms has a
short vector; the products of two buckets' vectors are the weights of their pairs, so that a pair
such as an insult with the mention of a group can count for more than both terms alone. No term is
left out for being uneven on its own: every bucket of the training sample has both."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from gridmill.llm import words as text_words
from gridmill.llm.common import held_out, named, per_batch, private

#: Hash buckets of terms: this bounds the machine (36 bytes each), its fit and what is broadcast.
BUCKETS = 1 << 18
#: Labelled rows that the machine is fitted on at most: those with the smallest hashed ids.
SAMPLE = 20_000
#: STEPS: batches at least, however few the texts; RATE, PAIR_RATE: step sizes of weights and
#: vectors; SPREAD: first size of the vectors.
FACTORS, EPOCHS, STEPS, BATCH, RATE, PAIR_RATE, SPREAD = 4, 12, 1200, 64, 0.3, 0.02, 0.003
#: Standard errors that a bucket's weight, and a pair's vectors, must explain to leave zero.
LEAST, PAIR_LEAST = 3.0, 3.0


def terms(text: str | None) -> np.ndarray:
    """The text's distinct buckets, ascending."""
    return np.unique(text_words.of_text(text, digits=False) % np.uint64(BUCKETS)).astype(np.int32)


@dataclass
class Machine:
    """bias + sum of weights + sum over pairs of the products of their vectors."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def places(self, at: np.ndarray) -> np.ndarray:
        """Where the buckets that it knows have their weights."""
        if not len(self.buckets):
            return np.zeros(0, np.int64)
        where = np.minimum(np.searchsorted(self.buckets, at), len(self.buckets) - 1)
        return where[self.buckets[where] == at]

    def score(self, at: np.ndarray) -> float:
        """Of a text's buckets."""
        where = self.places(at)
        v = self.vectors[where]
        pairs = ((v.sum(0, dtype=float) ** 2).sum() - (v.astype(float) ** 2).sum()) / 2
        return float(_sigmoid(self.bias + self.weights[where].sum(dtype=float) + pairs))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class _Batch:
    """Some texts' terms in the order of texts and, by `turn`, in the order of buckets."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray):
        sizes = np.array([len(r) for r in rows])
        f = np.concatenate(rows)
        self.y, self.own, self.starts = y, np.repeat(np.arange(len(rows), dtype=np.int32), sizes), np.cumsum(sizes) - sizes
        self.turn = np.argsort(f, kind="stable").astype(np.int32)
        self.some, self.firsts = np.unique(f[self.turn], return_index=True)
        self.f = f

    def outputs(self, bias: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the sigmoid, the terms' vectors, and their sums by text."""
        rows = v[self.f]
        s = np.add.reduceat(rows, self.starts)
        q = np.add.reduceat((rows**2).sum(1), self.starts)
        return bias + np.add.reduceat(w[self.f], self.starts) + ((s**2).sum(1) - q) / 2, rows, s

    def by_bucket(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[self.turn], self.firsts)


def _fit(rows: list[np.ndarray], y: np.ndarray) -> Machine:
    """Machine of the texts given as bucket sets, by stochastic gradients of the log loss.

    A step touches the batch's buckets only, and step sizes fall with a bucket's own gradients. In
    the first half of the epochs weights are pulled to zero by LEAST standard errors of what the
    labels of their texts would add up to by chance, given all other terms; those that have left zero
    then go on without it. In the second half the vectors of all buckets learn what is left over,
    pulled by PAIR_LEAST of what the random vectors of a text's other terms would do. So rare terms
    don't learn their few texts by heart, and a pair grows from nothing if it explains enough."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(prior / (1 - prior)))
    some = [i for i, r in enumerate(rows) if len(r)]
    if not some or y.min() == y.max():
        return Machine(np.zeros(0, np.int32), bias, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    flat = np.unique(np.concatenate([rows[i] for i in some]))
    rng = np.random.default_rng(7)
    order = rng.permutation(some)
    batches = [_Batch([np.searchsorted(flat, rows[i]).astype(np.int32) for i in part], y[part]) for part in np.array_split(order, -(-len(order) // BATCH))]
    w, v = np.zeros(len(flat)), rng.normal(0, SPREAD, (len(flat), FACTORS))
    seen_w, seen_v, seen_b = np.ones(len(flat)), np.ones(len(flat)), 1.0
    texts = np.bincount(np.concatenate([b.f for b in batches]), minlength=len(flat))
    touched = np.bincount(np.concatenate([b.some for b in batches]), minlength=len(flat))
    pull = np.sqrt(texts * prior * (1 - prior)) / touched
    # what the random vectors of a text's other terms add up to by chance
    hold = PAIR_LEAST * SPREAD * np.sqrt(texts.sum() / len(order))
    epochs = max(EPOCHS, -(-STEPS // len(batches)))
    for epoch in range(epochs):
        # pairs are for what single terms leave over
        pairs = epoch >= epochs // 2
        for k in rng.permutation(len(batches)):
            b = batches[k]
            out, vectors, s = b.outputs(bias, w, v if pairs else np.zeros_like(v))
            e = _sigmoid(out) - b.y
            mine, at = e[b.own], b.some
            g = b.by_bucket(mine)
            seen_w[at] += g**2
            step = RATE / np.sqrt(seen_w[at])
            new = w[at] - step * g
            if pairs:  # weights that have left zero are pulled no more
                w[at] = np.where(w[at] != 0, new, 0.0)
            else:
                w[at] = np.sign(new) * np.maximum(0.0, np.abs(new) - step * LEAST * pull[at])
            seen_b += e.sum() ** 2
            bias -= RATE * e.sum() / np.sqrt(seen_b)
            if not pairs:
                continue
            gv = b.by_bucket(mine[:, None] * (s[b.own] - vectors))
            seen_v[at] += (gv**2).mean(1)
            step = PAIR_RATE / np.sqrt(seen_v[at])
            new = v[at] - step[:, None] * gv
            v[at] = new * np.maximum(0.0, 1 - step * hold * pull[at] / np.maximum(np.sqrt((new**2).sum(1)), 1e-12))[:, None]
    there = np.flatnonzero((np.abs(w) > 1e-6) | ((v**2).sum(1) > 1e-8))
    return Machine(flat[there].astype(np.int32), float(bias), w[there].astype(np.float32), v[there].astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Machine from labelled rows of the learning folds.

    It is fitted in one task on at most `sample` labelled rows, each a set of at most BUCKETS
    numbers. Copies of a text count once, with the mean of their labels. Null ids, labels and texts
    are left out; with no labels, or only one kind, every text scores the smoothed share of toxic
    ones."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # `sample` ids and labels at most: 16 bytes each
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [xxhash.xxh64_intdigest(t.as_py().encode("utf-8", "surrogatepass")) - (1 << 63) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), pa.array([terms(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], ["y", "copy", "at"])

    sets = per_batch(rows.select("y", "text"), hashed, "y double, copy long, at binary").groupBy("copy").agg(F.avg("y").alias("y"), F.first("at").alias("at"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("copy")
        m = _fit([np.frombuffer(x, np.int32) for x in group["at"]], group["y"].to_numpy())
        return pd.DataFrame([(m.buckets.tobytes(), m.bias, m.weights.tobytes(), m.vectors.tobytes())], columns=["buckets", "bias", "weights", "vectors"])

    # `sample` texts at most meet in one task
    got = sets.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(one, "buckets binary, bias double, weights binary, vectors binary").collect()
    if not got:
        return _fit([], np.zeros(0))
    m = got[0]
    return Machine(np.frombuffer(m.buckets, np.int32), m.bias, np.frombuffer(m.weights, np.float32), np.frombuffer(m.vectors, np.float32).reshape(-1, FACTORS))


def scored(docs: DataFrame, machine: Machine, name: str) -> DataFrame:
    """docs with the score of every row's whole text in one more column."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [machine.score(terms(t.as_py())) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*names, name])

    return per_batch(docs, run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """Score of every row's whole text.

    docs: doc_id, text; other columns are ignored. A null or empty text has no terms and gets the
    score of the bias alone; repeated rows each give a row; a null id counts as held out; an empty
    table gives no rows. Returns doc_id, held_out, score and predicted (1 from 0.5 on)."""
    out = scored(docs.select("doc_id", "text"), machine, "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast(IntegerType()).alias("predicted"))


def without_toxic(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows, with all their columns, whose text scores under 0.5."""
    (mark,) = private(docs, "score")
    return scored(docs, machine, mark).where(F.col(mark) < 0.5).select(*named(docs.columns))
