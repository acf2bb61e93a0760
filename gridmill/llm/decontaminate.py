"""Finding benchmark items in training documents, edited copies included.

Seeds are ordered pairs of words that are next to each other or one word apart. A copy that scores
`share` of an item of n words has 2 * matches - penalties >= 2 * share * n, so at least share * n - 1
of its matches are followed by the next one with a penalty of one at most: such two matches are a
seed of the item and of the document. Of the n - 1 places where a seed of the item can begin, those
whose seeds the fewest documents hold are kept, as many as leave every copy HITS of them. Where a
document holds these, the stretch that could hold the item is cut out, joined to the item, and
aligned with it (Smith-Waterman). So no copy is lost before it is scored. Short items are easily met
by chance: from WHOLE_WORDS words on they count with one word edited, below that word for word."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm import words as text_words
from gridmill.llm.common import per_batch, saved

#: Places of an item whose seeds a stretch must hold (fewer if a copy is sure of fewer).
HITS = 2
#: Items of fewer words count with one word replaced, left out or put in.
SHORT_WORDS = 8
#: Items of fewer words count word for word.
WHOLE_WORDS = 4
#: Points of the alignment for a word that agrees, differs, or is left out or put in.
MATCH, DIFFER, GAP = 2.0, -1.0, -1.0
#: Least share of an item's full score that a copy has.
SHARE = 0.5
#: Seeds up to this number (16 bytes each) are sent to all tasks; more are joined by shuffle.
LOCAL_SEEDS = 1 << 20
#: Seeds that more than one part in HOT of all hits go to are joined in parts; fewer than HOT can be.
HOT = 10_000
#: Bits of the filter of seeds at most (32 MB); beyond a 16th of them in seeds it lets more through.
FILTER_BITS = 28


def hashed(text: str | None) -> np.ndarray:
    """Hashes of a text's lower-cased words."""
    return text_words.of_text(text).view(np.int64)


def _grams(h: np.ndarray, singles: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ordered pairs of words next to each other or one apart, and where each begins;
    with singles also of each word alone."""
    u = h.view(np.uint64)
    first = u * np.uint64(0x9E3779B97F4A7C15)
    out = [first[:-1] ^ u[1:], first[:-2] ^ u[2:]] + ([u * np.uint64(0xC2B2AE3D27D4EB4F) ^ (u >> np.uint64(7))] if singles else [])
    gram = np.concatenate(out) * np.uint64(0xC2B2AE3D27D4EB4F)
    gram ^= gram >> np.uint64(29)
    return gram.view(np.int64), np.concatenate([np.arange(len(x)) for x in out])


def _need(size: int, share: float) -> float:
    """Share of the full score that a copy of an item of so many words needs."""
    if size >= SHORT_WORDS:
        return share
    return 1.0 if size < WHOLE_WORDS else max(share, 1 - (MATCH - DIFFER) / (MATCH * size))


def _sure(size: int, share: float) -> int:
    """Places of an item at which every copy that scores enough has a seed."""
    return math.ceil(_need(size, share) * size - 1e-9) - 1


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """Best local alignment score of two word sequences, and where in the text it ends."""
    place = np.arange(len(text) + 1) * GAP
    row, best, end = np.zeros(len(text) + 1), 0.0, 0
    for w in item:
        step = np.maximum(row + GAP, 0.0)
        step[1:] = np.maximum(step[1:], row[:-1] + np.where(text == w, MATCH, DIFFER))
        # words put in: the best earlier place less a gap for each word since
        row = np.maximum.accumulate(step - place) + place
        at = int(row.argmax())
        if row[at] > best:
            best, end = float(row[at]), at
    return best, end


def start_of(item: np.ndarray, text: np.ndarray, end: int) -> int:
    """Where in the text the alignment begins that align() found to end there."""
    return end - align(item[::-1], text[:end][::-1])[1]


_PLACES = "text_id long, size long, slack long, least long, sure long, gram long, at long"


def _items(benchmark: DataFrame, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(item_id, text_id), (text_id, words) of the distinct texts, and every place of them that has a
    seed; slack: words that a copy can hold beside the item's; least: places that its stretch hits."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, hashed(t.as_py())) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            found = [(i, h) for i, h in found if len(h)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([h for _, h in found], pa.list_(pa.int64()))], ["item_id", "words"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, words in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = words.values.to_numpy()
                n, sure = len(h), _sure(len(h), share)
                about = i, n, max(0, int(2 * n * (1 - _need(n, share)))), max(1, min(HITS if n >= WHOLE_WORDS else 1, sure)), sure
                gram, at = _grams(h, n == 1)
                if n < WHOLE_WORDS:  # all neighbours are in a copy, words one apart need not be asked
                    gram, at = gram[: max(1, n - 1)], at[: max(1, n - 1)]
                rows += [(*about, *x) for x in zip(gram.tolist(), at.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(7)], ["text_id", "size", "slack", "least", "sure", "gram", "at"])

    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    each = per_batch(rows, items, "item_id long, words array<long>").withColumn("text_id", F.xxhash64("words"))
    texts = each.select("text_id", "words").dropDuplicates(["text_id"])
    return each.select("item_id", "text_id").distinct(), texts, saved(per_batch(texts, places, _PLACES), "places")


class _Table:
    """Sorted grams that texts are looked up in; most of a text's end at a table over the highest bits."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.shift = np.uint64(64 - min(24, 12 + int(len(grams)).bit_length() // 2 * 2))
        self.held = np.zeros(1 << (64 - int(self.shift)), bool)
        self.held[grams.view(np.uint64) >> self.shift] = True

    def find(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the given grams are in the table, and where."""
        near = np.flatnonzero(self.held[gram.view(np.uint64) >> self.shift])
        if not len(near):
            return near, near
        where = np.minimum(np.searchsorted(self.grams, gram[near]), len(self.grams) - 1)
        hit = self.grams[where] == gram[near]
        return near[hit], where[hit]


def _filter(grams: DataFrame, count: int) -> tuple[np.ndarray, np.uint64]:
    """One bit a hash of the grams, of a size that follows their count up to 2 ** FILTER_BITS."""
    bits = min(FILTER_BITS, max(12, (16 * count).bit_length()))
    place = F.shiftrightunsigned("gram", 64 - bits)
    words = grams.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - bits}) & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out, np.uint64(64 - bits)


def _held(gram: np.ndarray, bits: np.ndarray, shift: np.uint64) -> np.ndarray:
    """The distinct ones of a text's grams that the filter lets through."""
    place = gram.view(np.uint64) >> shift
    return np.unique(gram[(bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)])


def _hits(docs: DataFrame, grams: DataFrame, count: int, singles: bool) -> DataFrame:
    """(doc_id, gram): a document's distinct grams, those that are none of the given ones mostly left out."""
    bits, shift = _filter(grams, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                g = _held(_grams(hashed(text.as_py()), singles)[0], bits, shift)
                if len(g):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), doc_id)), pa.array(g)], ["doc_id", "gram"])

    return per_batch(docs, run, "doc_id long, gram long")


def _frequencies(docs: DataFrame, grams: DataFrame, count: int, local: bool, singles: bool) -> DataFrame:
    """(gram, docs): how many of the documents hold each of the grams that any holds."""
    if not local:
        # counted in every task before they move, so that a pair of every document is no hot key
        return _hits(docs, grams, count, singles).groupBy("gram").agg(F.count("*").alias("docs")).join(grams, "gram", "left_semi")
    known = np.sort(grams.toPandas()["gram"].to_numpy(np.int64))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = _Table(known), np.zeros(len(known), np.int64)
        for b in batches:
            for text in b.column(1):
                n[np.unique(table.find(_grams(hashed(text.as_py()), singles)[0])[1])] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(known[some]), pa.array(n[some])], ["gram", "docs"])

    return per_batch(docs, tally, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))


def _seeds(places: DataFrame, frequencies: DataFrame) -> DataFrame:
    """The places whose seeds the fewest documents hold, as many as no copy can miss."""
    per_gram = places.groupBy("gram").agg(F.countDistinct("text_id").alias("texts")).join(frequencies, "gram", "left")
    cost = places.join(per_gram, "gram").groupBy("text_id", "at").agg(F.sum(F.coalesce("docs", F.lit(0))).alias("docs"), F.sum("texts").alias("texts"))
    order = cost.select("text_id", "at", F.row_number().over(Window.partitionBy("text_id").orderBy("docs", "texts", "at")).alias("nth"))
    # a copy is sure of `sure` places: of all but that many it can miss every one
    kept = places.join(order, ["text_id", "at"]).where(F.col("nth") <= F.greatest(F.col("size") - 1, F.lit(1)) - F.least("sure", F.greatest(F.col("size") - 1, F.lit(1))) + F.col("least"))
    kept = kept.select("gram", "text_id", "at", "size", "slack", "least").distinct().join(frequencies, "gram", "left")
    return saved(kept.withColumn("docs", F.coalesce("docs", F.lit(0))), "seeds")


def _stretches(at: np.ndarray, end: int, text: np.ndarray, text_at: np.ndarray, size: np.ndarray, slack: np.ndarray, least: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, from, to): where in the document each hit's item can lie; overlapping ones merged.

    Only stretches that hit the item at `least` places; `end` is the document's number of words."""
    low, high = np.maximum(0, at - text_at - slack), np.minimum(end, at - text_at + size + slack)
    order = np.lexsort((low, text))
    out: list[list] = []
    for i, a, z, place, n in zip(*(x[order].tolist() for x in (text, low, high, text_at, least)), strict=True):
        if out and out[-1][0] == i and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], z)
            out[-1][3].add(place)
        else:
            out.append([i, a, z, {place}, n])
    return [(i, a, z) for i, a, z, places, n in out if len(places) >= n]


_PASSAGES = "doc_id long, text_id long, start long, passage array<long>"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], ["doc_id", "text_id", "start", "passage"])


def _by_broadcast(docs: DataFrame, seeds: DataFrame, singles: bool) -> DataFrame:
    """Passages by looking the seeds up in each task."""
    got = seeds.orderBy("gram").toPandas()
    gram, *seed = (got[x].to_numpy(np.int64) for x in ("gram", "text_id", "at", "size", "slack", "least"))
    distinct, first, number = np.unique(gram, return_index=True, return_counts=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(distinct)
        for b in batches:
            found = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = hashed(text.as_py())
                g, at = _grams(h, singles)
                hit, k = table.find(g)
                if len(hit):
                    n = number[k]
                    s = np.repeat(first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    found += [(doc_id, i, a, h[a:z]) for i, a, z in _stretches(np.repeat(at[hit], n), len(h), *(x[s] for x in seed))]
            yield _rows(found)

    return per_batch(docs, run, _PASSAGES)


def _by_join(docs: DataFrame, seeds: DataFrame, singles: bool) -> DataFrame:
    """The same by joining the documents' pairs with the seeds.

    Only pairs of document and item with `least` places are met again; each takes the item's seeds
    along, which its length bounds, and looks them up once more."""
    each = seeds.select("gram", "docs").distinct()
    share = each.agg(F.greatest(F.sum("docs"), F.lit(1)).alias("all"))
    # a seed of many documents is met in as many parts as it has HOT-ths of all hits: below 2 * HOT rows
    hot = each.crossJoin(F.broadcast(share)).where(F.col("docs") * HOT > F.col("all")).select("gram", F.ceil(F.col("docs") * HOT / F.col("all")).cast("int").alias("parts"))
    hot = F.broadcast(saved(hot, "hot"))
    hits = _hits(docs, each.select("gram"), each.count(), singles).join(hot, "gram", "left")
    hits = hits.select("doc_id", "gram", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts"))).cast("int").alias("part"))
    dealt = seeds.join(hot, "gram", "left").select("gram", "text_id", "at", "least", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))).alias("part"))
    met = hits.join(dealt, ["gram", "part"]).groupBy("doc_id", "text_id").agg(F.countDistinct("at").alias("places"), F.max("least").alias("least"))
    met = met.where("places >= least").select("doc_id", "text_id")
    of_text = seeds.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("gram", "at", "size", "slack", "least"))).alias("seeds"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text, item, own in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3), strict=True):
                h = hashed(text.as_py())
                g, at = _grams(h, singles)
                gram, *seed = (own.values.field(k).to_numpy() for k in range(5))
                low, high = np.searchsorted(gram, g, "left"), np.searchsorted(gram, g, "right")
                n = high - low
                s = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                yield _rows([(doc_id, i, a, h[a:z]) for i, a, z in _stretches(np.repeat(at, n), len(h), np.full(len(s), item), *(x[s] for x in seed))])

    pairs = met.join(of_text, "text_id").join(docs, "doc_id").select("doc_id", "text", "text_id", "seeds")
    return per_batch(pairs, cut, _PASSAGES)


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, local_seeds: int = LOCAL_SEEDS) -> DataFrame:
    """Documents that hold a benchmark item or an edited copy of one.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Words are runs of
    letters, digits and underscores, lower-cased. Items under SHORT_WORDS words are found with one word
    replaced, left out or put in, those under WHOLE_WORDS only as they are. Null ids and texts without words match nothing; repeated rows
    or ids give one row with their best score; either table empty gives none. `share` has to be over
    1 / SHORT_WORDS.
    Returns doc_id, item_id, similarity (of the item's full score, at least `share`) and start (the
    document's word, from 0, where the aligned copy begins; the first of equal ones)."""
    if share * SHORT_WORDS <= 1:
        raise ValueError("a copy of so small a share need not hold a pair of words")
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    items, texts, places = _items(benchmark, share)
    grams = saved(places.select("gram").distinct(), "grams")
    count = grams.count()
    singles = bool(places.where("size = 1").limit(1).count())
    seeds = _seeds(places, saved(_frequencies(docs, grams, count, count <= local_seeds, singles), "frequencies"))
    passages = (_by_broadcast if seeds.count() <= local_seeds else _by_join)(docs, seeds, singles)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, scores = [], []
            for start, words, passage in zip(b.column(2).to_pylist(), b.column(3), b.column(4), strict=True):
                item, text = words.values.to_numpy(), passage.values.to_numpy()
                least, best, end = _need(len(item), share) - 1e-12, 0.0, 0
                # no score passes that of the item's words which the passage holds at all
                if np.isin(item, text).sum() / len(item) >= least:
                    best, end = align(item, text)
                good = best / (MATCH * len(item)) >= least
                scores.append(best / (MATCH * len(item)) if good else 0.0)
                starts.append(start + start_of(item, text, end) if good else start)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(starts, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "text_id", "start", "similarity"])

    both = passages.join(texts, "text_id").select("doc_id", "text_id", "start", "words", "passage")
    scored = per_batch(both, score, "doc_id long, text_id long, start long, similarity double").where(F.col("similarity") > 0).join(items, "text_id")
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.similarity").alias("similarity"), (-F.col("m.s")).alias("start"))
