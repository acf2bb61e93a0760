"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs. Shifting the vectors of three letters in a row by their
place and multiplying them binds a letter trigram; adding up the trigrams of a text bundles it, and
adding up the texts of a language gives its prototype. A text is given the language whose prototype
has the largest cosine with it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gridmill.llm.common import held_out, named, per_batch, private

DIM = 1024
#: Letters are told apart by so many codes; a-z have their own, code 0 is a gap between words.
CODES = 1024
SEED = 20_240_501
#: Trigrams bound at once.
_AT_ONCE = 4096
UNKNOWN = "und"


@lru_cache(1)
def _codes() -> np.ndarray:
    """Letter code by code point, 0 where it is no letter."""
    out = np.zeros(0x110000, np.int64)
    letters = np.fromiter((c for c in range(0x110000) if chr(c).isalpha()), np.int64)
    out[letters] = 27 + (letters * 2_654_435_761 >> 7) % (CODES - 27)
    out[97:123] = np.arange(1, 27)
    return out


@lru_cache(1)
def _vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign vectors of the codes, shifted for the first, second and third place of a trigram."""
    base = np.random.default_rng(SEED).integers(0, 2, (CODES, DIM), np.int8) * 2 - 1
    return np.roll(base, 2, 1), np.roll(base, 1, 1), base


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of the lower-cased letters, gaps included, and how often each occurs."""
    codes = _codes()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([[0], codes, [0]])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = codes[keep]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique((codes[:-2] * CODES + codes[1:-1]) * CODES + codes[2:], return_counts=True)


def bundle(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the trigrams' bound vectors, each taken as often as it occurs."""
    first, second, third = _vectors()
    out = np.zeros(DIM)
    for i in range(0, len(grams), _AT_ONCE):
        g = grams[i : i + _AT_ONCE]
        bound = first[g // CODES**2] * second[g // CODES % CODES] * third[g % CODES]
        # float32 holds these sums exactly up to 2^24; longer texts are added up in parts
        c = counts[i : i + _AT_ONCE]
        out += c.astype(np.float32) @ bound.astype(np.float32) if c.sum() < 1 << 24 else c.astype(float) @ bound
    return out


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """Bundle of every language over all texts of the learning folds.

    Each task adds up its own texts, so one row per task and language is shuffled. The result is
    DIM numbers a language."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def fold(lang: str) -> None:
            parts = waiting.pop(lang) + ([sums[lang]] if lang in sums else [])
            grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            sums[lang] = grams, np.bincount(where, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                waiting.setdefault(lang, []).append(trigrams(text.as_py()))
                if len(waiting[lang]) >= 1024:
                    fold(lang)
        for lang in [*waiting]:
            fold(lang)
        langs = [*sums]
        vectors = [bundle(*sums[x]) for x in langs]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([v.tolist() for v in vectors], pa.list_(pa.float64()))], ["lang", "v"])

    fold = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    places = per_batch(fold, add, "lang string, v array<double>").select("lang", F.posexplode("v").alias("place", "x"))
    total = places.groupBy("lang", "place").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("v"))
    return {r.lang: np.array([p.x for p in r.v]) for r in total.collect()}


def marked(docs: DataFrame, learned: dict[str, np.ndarray], lang: str, score: str) -> DataFrame:
    """docs with the language of every row's whole text and its cosine in two more columns."""
    langs = sorted(learned)
    proto = np.array([learned[x] for x in langs]).reshape(len(langs), DIM)
    proto = proto / np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-300)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, scores = [], []
            for text in b.column(at):
                grams, counts = trigrams(text.as_py() or "")
                v = bundle(grams, counts) if len(grams) and langs else np.zeros(DIM)
                size = np.linalg.norm(v)
                cos = proto @ v / size if size else np.zeros(0)
                best = int(np.argmax(cos)) if len(cos) else -1
                found.append(langs[best] if best >= 0 else UNKNOWN)
                scores.append(min(1.0, max(0.0, float(cos[best]))) if best >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*names, lang, score])

    return per_batch(docs, run, StructType([*docs.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())]))


def identify(docs: DataFrame, learned: dict[str, np.ndarray]) -> DataFrame:
    """Language of every row's whole text by the learned prototypes.

    docs: doc_id, text; other columns are ignored. A text that is null or has no letter, and any text
    where nothing is learned, is 'und' with score 0; repeated rows each give a row; a null id counts
    as held out; equal cosines go to the first language by name; an empty table gives no rows.
    Returns doc_id, held_out, lang_pred and score (the cosine, 0 where it is negative)."""
    out = marked(docs.select("doc_id", "text"), learned, "lang_pred", "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, learned: dict[str, np.ndarray]) -> DataFrame:
    """The rows, with all their columns, whose text is in some language."""
    lang, score = private(docs, "lang", "score")
    return marked(docs, learned, lang, score).where(F.col(lang) != UNKNOWN).select(*named(docs.columns))
