"""Near-duplicate groups of documents by MinHash, confirmed on the full shingle sets.

One hash pass fills all bins of a signature (one permutation); empty bins take the value of a full
bin picked by a hash of the bin and the attempt (optimal densification). Bands of bins are bucket
keys. Documents with equal sets are one node from the start. In a bucket each node is tied to the
smallest one only, so the candidates are stars, and every candidate is confirmed on the full sets.
What a star can miss, a link between two nodes neither of which is the centre, matters only in
buckets that still hold several components; there the nodes outside a bucket's largest component are
held against the others, but for those whose set sizes, own shingles or distances to the common
centre rule a link out. The nodes of such a bucket are dealt out over tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.common import per_batch, saved
from gridmill.llm.graph import components
from gridmill.llm.words import mix, of_bytes

#: Chance that a pair just at the threshold shares no bucket.
MISS = 1e-8
#: Ids up to this number (16 bytes each) are broadcast to pick texts; more are joined by shuffle.
BROADCAST_IDS = 1 << 20
#: Parts, a power of two, over which two sets' common shingles are bounded.
PARTS = 256
#: Nodes of one bucket that one task holds against the bucket's other nodes.
SPLIT = 1024

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def bands_for(percent: int, rows: int) -> int:
    """Bands of so many rows that a pair of the threshold's similarity misses all with MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows)))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, width: int):
        self.width = width
        self.odd = np.array([int(_ODD[i % len(_ODD)]) + 2 * (i // len(_ODD)) & (1 << 64) - 1 for i in range(width)], np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        # ASCII letters are lowered and ASCII blanks cut, other characters stay
        h = of_bytes(text)
        n = len(h)
        if not n:
            return h
        if n < self.width:
            return np.array([xxhash.xxh64_intdigest(h.tobytes(), n)], np.uint64)
        mixed = np.zeros(n - self.width + 1, np.uint64)
        for i in range(self.width):
            mixed += mix(h * self.odd[i])[i : n - self.width + 1 + i]
            mixed = mix(mixed)
        return np.unique(mixed)


@lru_cache(16)
def _attempts(bins: int, first: int, n: int) -> np.ndarray:
    """Bins that each bin asks in attempts first..first+n."""
    at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(0x100000001B3) + np.arange(first, first + n, dtype=np.uint64)[None, :]
    return (mix(at * _ODD[0] + np.uint64(1)) % np.uint64(bins)).astype(np.int64)


def signature(h: np.ndarray, bins: int) -> np.ndarray:
    """Least value in each bin; empty bins densified."""
    where = mix(h ^ _ODD[5])
    value = mix(h * _ODD[6]) >> np.uint64(11)
    own = (where % np.uint64(bins)).astype(np.int64)
    order = np.lexsort((value, own))
    own, value = own[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    out, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[own[first]], full[own[first]] = value[first], True
    empty, at = np.flatnonzero(~full), 0
    while len(empty):
        asked = _attempts(bins, at, 64)[empty]
        hit = full[asked]
        some = hit.any(1)
        out[empty[some]] = out[asked[some, hit[some].argmax(1)]]
        empty, at = empty[~some], at + 64
    return out


def bands(h: np.ndarray, rows: int, n: int) -> np.ndarray:
    """Bucket keys, one a band."""
    parts = signature(h, rows * n).reshape(n, rows)
    key = np.arange(n, dtype=np.uint64) * _ODD[1]
    for i in range(rows):
        key = mix(key ^ (parts[:, i] * _ODD[i % len(_ODD)]))
    return key.view(np.int64)


def _digest(h: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None


def _sketches(docs: DataFrame, width: int, rows: int, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for b in batches:
            sizes, digests, keys = [], [], []
            for text in b.column(1):
                h = shingles(text.as_py())
                sizes.append(len(h))
                digests.append(_digest(h))
                keys.append(bands(h, rows, n) if len(h) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "bands"])

    return per_batch(docs.select("doc_id", "text"), run, "doc_id long, n long, digest binary, bands array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """Full shingle sets of the nodes named in ids, and how many shingles fall to each of PARTS."""
    wanted = nodes.select("doc_id", "digest").join(ids, "doc_id", "left_semi")
    wanted = F.broadcast(wanted) if ids.count() <= BROADCAST_IDS else wanted
    texts = docs.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "text", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for b in batches:
            found = [(i, h) for i, t, d in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True) if _digest(h := shingles(t.as_py())) == d]
            parts = [np.bincount((h & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS) for _, h in found]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([h.view(np.int64) for _, h in found], pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32()))], ["doc_id", "items", "parts"])

    return saved(per_batch(texts, run, "doc_id long, items array<long>, parts array<int>").dropDuplicates(["doc_id"]), "shingles", "none")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) with the size of their common part."""
    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("of_b")), "b")
    both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("of_a")), "a")
    return saved(both.select("a", "b", "na", "nb", F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("common")), "confirmed")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = 6) -> DataFrame:
    """Groups of documents linked by 100 * intersection >= percent * union of their shingle sets.

    docs: doc_id, text; other columns are ignored. Words are what ASCII white space separates,
    with A-Z lowered; a text of fewer than `width` words has all of them as its one shingle. A text
    that is null or has no word has an empty set, n_shingles 0, and is linked with nothing. Rows with
    equal ids are one document: of their texts the one with the smallest set digest is compared, and
    all rows get its group. A null id is linked with nothing: its component_id is null and it is
    kept. An empty table gives no rows.
    rows: bins in a band; the number of bands follows from the threshold and MISS.
    Returns a row for each row of docs: doc_id, n_shingles, component_id (smallest id reachable) and
    kept (doc_id = component_id)."""
    n_bands = bands_for(percent, rows)
    sketches = saved(_sketches(docs, width, rows, n_bands), "sketches")
    one = sketches.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("digest").alias("digest"))
    same = saved(one.groupBy("digest").agg(F.min("doc_id").alias("node")), "same")
    # both columns are keys, so a digest with a third of the rows is no hot key here
    own = same.select(F.col("node").alias("doc_id"), "digest")
    nodes = saved(sketches.join(own, ["doc_id", "digest"]).select("doc_id", "digest", "n", "bands").dropDuplicates(["doc_id"]), "nodes")

    keys = nodes.select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    shared = keys.groupBy("bucket").agg(F.min("doc_id").alias("centre"), F.count("*").alias("size")).where("size > 1")
    members = saved(keys.join(shared, "bucket").select("bucket", "band", "doc_id", "centre"), "members")
    sizes = nodes.select("doc_id", "n")

    def sized(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), "a")
        return with_a.join(sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb")), "b")

    # the smaller set bounds the common part, the larger one the union
    can_fit = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    linked = f"100 * common >= {percent} * (na + nb - common)"
    stars = members.where("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = saved(sized(stars).where(can_fit), "stars")
    named = saved(stars.select(F.col("a").alias("doc_id")).unionByName(stars.select(F.col("b").alias("doc_id"))).distinct(), "named")
    tested = _confirmed(stars, _sets(docs, nodes, named, width))
    first = components(tested.where(linked).select("a", "b"))

    labelled = members.join(first.select(F.col("id").alias("doc_id"), "label"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    labelled = saved(labelled, "labelled")
    by_label = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    open_ = by_label.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"), F.sum("n").alias("size")).where("labels > 1 and size > 2")
    far = tested.select(F.col("a").alias("centre"), F.col("b").alias("doc_id"), (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("far"))
    rest = labelled.join(open_.select("bucket", "main", F.ceil(F.col("size") / SPLIT).cast("int").alias("salts")), "bucket").where("doc_id <> centre").join(far, ["centre", "doc_id"], "left")
    open_ids = saved(rest.select("doc_id").distinct(), "open")
    sets = _sets(docs, nodes, open_ids, width)
    # shingles that no other of these documents has are common to no pair: an edit's own ones
    holders = sets.select("doc_id", F.explode("items").alias("item")).groupBy("item").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("docs"))
    alone = holders.where("docs = 1").groupBy("doc_id", F.col("item").bitwiseAND(PARTS - 1).cast("int").alias("part")).agg(F.count("*").cast("int").alias("n"))
    alone = alone.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("alone"))
    shared_parts = F.transform("parts", lambda n, i: n - F.coalesce(F.try_element_at("alone", i), F.lit(0)))
    parts = sets.select("doc_id", "parts").join(alone, "doc_id", "left").select("doc_id", shared_parts.alias("parts"))
    parts = parts.withColumn("shared", F.aggregate("parts", F.lit(0), lambda a, x: a + x))
    about = nodes.join(open_ids, "doc_id", "left_semi").select("doc_id", "n", "bands").join(parts, "doc_id")
    rest = saved(rest.join(about, "doc_id"), "rest")
    # all nodes on one side, dealt out; those outside the largest component on the other, in every part
    x = rest.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).alias("x")
    y = rest.where("label <> main").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("y")
    within = 1 - percent / 100 + 1e-9
    across = x.join(y, F.expr(
        "x.bucket = y.bucket and x.salt = y.salt and x.label <> y.label and (x.label = x.main or x.doc_id < y.doc_id)"
        f" and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
        # what can be common: shared shingles, in all and part by part
        f" and 100 * least(x.shared, y.shared) >= {percent} * (x.n + y.n - least(x.shared, y.shared))"
        # distances of sets obey the triangle inequality
        f" and (x.far is null or y.far is null or abs(x.far - y.far) <= {within})"
        # a pair is made in the first band that it shares
        " and x.band = array_position(zip_with(x.bands, y.bands, (p, q) -> p = q), true) - 1"
        f" and {100 + percent} * aggregate(zip_with(x.parts, y.parts, (p, q) -> least(p, q)), 0, (s, v) -> s + v) >= {percent} * (x.n + y.n)"
    ))
    across = across.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
    # a pair can be made in buckets with different largest components: once either way round
    across = saved(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb")), "across")
    more = _confirmed(across, sets).where(linked).select("a", "b")
    ties = first.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))
    last = components(ties.unionByName(more))

    # digest -> node -> component, then back to every row by its id
    groups = same.join(last.select(F.col("id").alias("node"), "label"), "node", "left").select("digest", F.coalesce("label", "node").alias("component_id"))
    by_id = one.join(groups, "digest").select("doc_id", "component_id")
    out = sketches.select("doc_id", F.col("n").alias("n_shingles")).join(by_id, "doc_id", "left")
    # an id without words stands alone
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
