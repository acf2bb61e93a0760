"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors are whole numbers. Vectors near the same pivot are put into the same blocks, and a block
keeps a sorted list for each component; a query reads it from the end where its component's products
are largest. What no list has shown yet scores at most the sum of the values last read, so reading
goes on until that is under the k-th best score known (a query starts with that of its own block).
Only candidates seen by then can qualify: their upper bounds (the value last read where a list hasn't
shown them) are held against it, and those that remain are resolved to exact scores. Both are dealt
out once over a grid of tasks; a task holds its queries, however many blocks it reads."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from gridmill.llm.common import per_batch, saved

#: Candidates in a block and queries in a slot, fewer where they are more than NUMBERS numbers.
BLOCK, SLOT, NUMBERS = 4096, 512, 1 << 19
#: Vectors to whose nearest one a vector is assigned: those with the smallest hashed ids, by so many components.
PIVOTS, WIDE = 256, 1024
#: Numbers of queries that a task holds; tasks of the search for each core, if the session has as many partitions.
HELD, WAVES = 1 << 25, 8
#: Candidates times k of a query from which equal scores of a block are cut to those of the smallest ids.
MANY = 8
#: Whole numbers under this are added up exactly by floats.
FLOAT = 1 << 24
#: Shares of the lists at which bounds are looked at.
DEPTHS = (*(i / 32 for i in range(1, 9)), 3 / 8, 1 / 2, 1)
#: Share of candidates that is resolved at once, and of how many one is asked first whether more are left.
FEW, ASKED = 0.02, 64

_LONG = (-(1 << 63), (1 << 63) - 1)


def _limit(dim: int) -> float:
    """Whole numbers up to this size have products that doubles add up exactly."""
    return min(2.0**30, math.floor(math.sqrt(2.0**53 / dim)) / 2)


def _size(most: int, dim: int) -> int:
    return max(1, min(most, NUMBERS // dim))


def _signed(q: np.ndarray) -> np.ndarray:
    """Positive and negative components side by side."""
    return np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], 1)


class Block:
    """Sorted lists of one block of candidates, by ascending ids; rank[c, j] is c's place in the falling list of component j."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rank: np.ndarray | None = None):
        self.ids, self.x = ids, x
        self.lists = -np.sort(-x, axis=0)
        self._shown: dict[tuple[int, bool], np.ndarray] = {}
        if rank is not None:
            self.rank = rank

    @cached_property
    def rank(self) -> np.ndarray:
        return self.ranks(self.x)

    @staticmethod
    def ranks(x: np.ndarray) -> np.ndarray:
        order = np.argsort(-x, axis=0, kind="stable")
        rank = np.empty(x.shape, np.int16)
        np.put_along_axis(rank, order, np.arange(len(x), dtype=np.int16)[:, None], 0)
        return rank

    def unseen(self, depth: int | np.ndarray, q: np.ndarray) -> np.ndarray:
        """For each query (and depth), the most that a candidate can score that `depth` entries haven't shown."""
        return (np.maximum(q, 0) @ self.lists[depth - 1].T + np.minimum(q, 0) @ self.lists[-depth].T).T

    def bounds(self, depth: int, q: np.ndarray, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds [candidates, queries] after `depth` entries of each list."""
        return self.shown(depth, False)[rows] @ _signed(q).T, self.shown(depth, True)[rows] @ _signed(q).T

    def shown(self, depth: int, most: bool) -> np.ndarray:
        """What `depth` entries of the lists have shown, for positive and for negative components of
        queries side by side; what they haven't counts as the most, or the least, that it can be."""
        if (depth, most) not in self._shown:
            high, low = (self.lists[depth - 1], self.lists[-depth]) if most else (self.lists[-1], self.lists[0])
            self._shown[depth, most] = np.concatenate([np.where(self.rank < depth, self.x, high), np.where(self.rank >= len(self.x) - depth, self.x, low)], 1)
        return self._shown[depth, most]

    def _all(self, rows: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """With all lists read: rows, queries and scores that reach `need`; of very many equal scores those of the smallest ids."""
        score = (self.x if len(rows) == len(self.x) else self.x[rows]) @ q.T
        alive = score >= need
        if len(rows) > k and np.count_nonzero(alive) > MANY * k * len(q):
            score[self.ids[rows, None] == query_ids] = -np.inf
            kth = np.maximum(need, np.partition(score, len(rows) - k, 0)[len(rows) - k])
            above, equal = score > kth, score == kth
            alive = above | (equal & (equal.cumsum(0, dtype=np.int32) <= k - above.sum(0)))
        c, j = np.divmod(np.flatnonzero(alive), len(q))
        other = self.ids[rows[c]] != query_ids[j]
        c, j = c[other], j[other]
        return rows[c], j, score[c, j]

    def best(self, query_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Every (query, candidate, score) that can be among the k best, and the share of the lists
        that was read; floor: what the k-th best of the others scores."""
        n, m = self.x.shape[0], len(q)
        depths = np.unique(np.maximum(1, np.ceil(np.array(DEPTHS) * n)).astype(int))
        over = self.unseen(depths, q) >= floor  # [depths, queries]
        # a query is through once nothing unseen can qualify; with all lists read nothing is unseen
        first = np.where(over.all(0), len(depths) - 1, over.argmin(0))
        at, ids, score, read = [], [], [], 0
        # what is unseen at the first entry bounds the block: queries above it need nothing here
        skip = self.unseen(1, q) < floor
        # of the block's own kind, so that large comparisons are: what floats round is beyond all scores of a block that has them
        floor = floor.astype(self.x.dtype)
        signed = _signed(q)
        for d in np.unique(first[~skip]):
            mine = np.flatnonzero((first == d) & ~skip)
            rows, need = np.arange(n), floor[mine]
            # reading goes on while more than a few of the candidates that are asked are left
            while d < len(depths) - 1 and np.mean(self.shown(int(depths[d]), True)[::ASKED] @ signed[mine].T >= need) > FEW:
                d += 1
            if (depth := int(depths[d])) < n:
                upper = self.shown(depth, True) @ signed[mine].T
                alive = upper >= need
                if np.count_nonzero(alive) > FEW * n * len(mine) and n > k:
                    lower = self.shown(depth, False) @ signed[mine].T
                    lower[self.ids[:, None] == query_ids[mine]] = -np.inf
                    need = np.maximum(need, np.partition(lower, n - k, 0)[n - k])
                    alive = upper >= need
                if np.count_nonzero(alive) <= FEW * n * len(mine):
                    c, j = np.divmod(np.flatnonzero(alive), len(mine))
                    exact = np.einsum("ij,ij->i", self.x[c], q[mine[j]])
                    good = (exact >= need[j]) & (self.ids[c] != query_ids[mine[j]])
                    at, ids, score, read = [*at, mine[j[good]]], [*ids, self.ids[c[good]]], [*score, exact[good]], read + depth * len(mine)
                    continue
                keep, left = alive.any(1), alive.any(0)
                read += depth * int((~left).sum())
                rows, mine, need = rows[keep], mine[left], need[left]
            c, j, exact = self._all(rows, query_ids[mine], q[mine], k, need)
            at, ids, score, read = [*at, mine[j]], [*ids, self.ids[c]], [*score, exact], read + n * len(mine)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0)
        return join(at).astype(np.int64), join(ids).astype(np.int64), join(score).astype(float), read / (n * m)


def _whole(x: np.ndarray) -> list[list[int]]:
    """floor(256 * x) of any finite numbers, exactly."""
    return [[int(v) * 256 if abs(v) >= 2.0**53 else math.floor(v * 256) for v in row] for row in x.tolist()]


def _exact(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best in whole numbers of any size, query by query."""
    out, rows = [], _whole(x)
    for at, (qid, query) in enumerate(zip(query_ids.tolist(), _whole(q), strict=True)):
        scores = ((-sum(map(int.__mul__, row, query)), i) for i, row in zip(ids.tolist(), rows, strict=True) if i != qid)
        out += [(at, i, -s) for s, i in heapq.nsmallest(k, scores)]
    return out


def _top(at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, at))
    at, ids, score = at[order], ids[order], score[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], ids[keep], score[keep]


def _floors(at: np.ndarray, score: np.ndarray, k: int, floor: np.ndarray) -> np.ndarray:
    """floor, raised to the k-th score of the queries that have k (sorted as _top returns them)."""
    last = np.arange(len(at)) - np.searchsorted(at, at) == k - 1
    out = floor.copy()
    out[at[last]] = np.maximum(out[at[last]], score[last])
    return out


def _key(score: int) -> str:
    """Orders scores beyond a long among each other; empty for others."""
    if _LONG[0] <= score <= _LONG[1]:
        return ""
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):04}{digits}"
    return f"{9999 - len(digits):04}" + "".join(str(9 - int(c)) for c in digits)


_BLOCKS = "kind int, dim int, huge boolean, code int, ids binary, x binary, vec_id long, q array<double>, floor double"


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold them all."""
    return x.astype(np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int32)


def _numbers(raw: bytes, n: int, dim: int, huge: bool) -> np.ndarray:
    """n vectors as _narrow made them, or doubles."""
    return np.frombuffer(raw, float if huge else {2: np.int16, 4: np.int32}[len(raw) // (n * dim)]).reshape(n, dim)


def _coded(vectors: DataFrame) -> DataFrame:
    """Vectors with their length, whether doubles are too short for their products, and nearest pivot."""
    good = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    kind = vectors.schema["embedding"].dataType
    number = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    rows = vectors.select("vec_id", F.col("embedding").cast(f"array<{number}>").alias("x")).where(F.coalesce(good, F.lit(False)))
    # PIVOTS vectors, whatever the input: saved, as of a sorted limit that is collected at once each task sends its own to the driver
    starts = rows.select("vec_id", F.size("x").alias("dim"), F.slice("x", 1, WIDE).alias("x"))
    chosen = saved(starts.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS), "pivots").collect()
    pivots: dict[int, np.ndarray] = {}
    for d in {r.dim for r in chosen}:
        p = np.array([r.x for r in chosen if r.dim == d])
        pivots[d] = (p / np.maximum(np.abs(p).max(1, keepdims=True), 1e-300)).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, values = b.column(1), b.column(1).flatten().to_numpy()
            dims = np.diff(lists.offsets.to_numpy())
            ends = np.cumsum(dims)
            huge, code = np.zeros(len(dims), bool), np.zeros(len(dims), np.int32)
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                x = values[(ends[mine] - d)[:, None] + np.arange(d)].astype(float)
                most = np.abs(x).max(1, keepdims=True)
                huge[mine] = most[:, 0] >= _limit(int(d)) / 256 - 1
                if d in pivots:
                    code[mine] = (x[:, :WIDE] / np.maximum(most, 1e-300) @ pivots[d]).argmax(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(huge), pa.array(code), lists], ["vec_id", "dim", "huge", "code", "x"])

    return per_batch(rows, run, f"vec_id long, dim int, huge boolean, code int, x array<{number}>")


def _packed(coded: DataFrame, k: int, every: int) -> DataFrame:
    """Blocks (kind 0) of at most BLOCK vectors of one length in the order that they come in, and
    the queries among their vectors (kind 1) with the k-th best score in their own block."""

    def block(dim: int, huge: bool, code: int, ids: list, xs: list) -> Iterator[pa.RecordBatch]:
        ids, x = np.array(ids, np.int64), np.array(xs, float)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        asked = np.flatnonzero(ids % every == 0)
        floor = np.full(len(asked), -np.inf)
        if not huge:
            x = np.floor(256 * x)
            if len(asked) and len(ids) > k:
                scores = x @ x[asked].T
                scores[ids[:, None] == ids[asked]] = -np.inf
                floor = np.partition(scores, len(ids) - k, 0)[len(ids) - k]
        yield _rows([(0, dim, huge, code, ids.tobytes(), (x if huge else _narrow(x)).tobytes(), None, None, None)])
        yield _rows([(1, dim, huge, code, None, None, int(ids[i]), v.tolist(), float(f)) for i, v, f in zip(asked, x[asked], floor, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, xs = None, [], []
        for b in batches:
            for i, dim, huge, code, x in zip(*(b.column(c).to_pylist() for c in range(4)), b.column(4), strict=True):
                if ids and (now[:2] != (dim, huge) or len(ids) >= _size(BLOCK, dim)):
                    yield from block(*now, ids, xs)
                    ids, xs = [], []
                if not ids:
                    now = dim, huge, code
                ids.append(i)
                xs.append(x.values.to_numpy())
        if ids:
            yield from block(*now, ids, xs)

    return per_batch(coded, run, _BLOCKS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.float64()), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["kind", "dim", "huge", "code", "ids", "x", "vec_id", "q", "floor"])


_SLOTS = "dim int, huge boolean, code int, ids binary, x binary, floors binary"


def _slots(queries: DataFrame, salts: int) -> DataFrame:
    """Queries in slots of at most SLOT, alike ones together."""

    def slot(key: tuple, code: int, rows: list) -> pa.RecordBatch:
        ids, q, floors = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
        arrays = [pa.array([key[0]], pa.int32()), pa.array([key[1]]), pa.array([code], pa.int32()), *(pa.array([a.tobytes()]) for a in (ids, q if key[1] else _narrow(q), floors))]
        return pa.RecordBatch.from_arrays(arrays, ["dim", "huge", "code", "ids", "x", "floors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held = None, 0, []
        for b in batches:
            for dim, huge, code, i, f, x in zip(*(b.column(c).to_pylist() for c in range(5)), b.column(5), strict=True):
                if held and (now != (dim, huge) or len(held) >= _size(SLOT, dim)):
                    yield slot(now, first, held)
                    held = []
                if not held:
                    now, first = (dim, huge), code
                held.append((i, x.values.to_numpy(), f))
        if held:
            yield slot(now, first, held)

    rows = queries.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).repartition("code", "salt").sortWithinPartitions("dim", "huge", "code")
    return per_batch(rows.select("dim", "huge", "code", "vec_id", "floor", "q"), run, _SLOTS)


class _Slot:
    """Queries that a task holds, and the best that it has found for them."""

    def __init__(self, huge: bool, ids: np.ndarray, q: np.ndarray, floor: np.ndarray):
        self.huge, self.ids, self.q, self.floor = huge, ids, q, floor
        self.most = float(np.abs(q).max())
        self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def read(self, block: Block, k: int) -> None:
        *new, _ = block.best(self.ids, self.q.astype(block.x.dtype), k, self.floor)
        if len(new[0]):
            self.found = _top(*(np.concatenate([a, n]) for a, n in zip(self.found, new, strict=True)), k)
            self.floor = _floors(self.found[0], self.found[2], k, self.floor)


def _joined(held: dict[tuple[int, bool], list]) -> dict[int, list[_Slot]]:
    """By length of vectors, the slots that came filled up to SLOT, alike queries together."""
    slots: dict[int, list[_Slot]] = {}
    for dim, huge in list(held):
        parts = sorted(held.pop((dim, huge)), key=lambda p: p[0])
        ids, q, floor = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        size = _size(SLOT, dim)
        slots.setdefault(dim, []).extend(_Slot(huge, ids[i : i + size], q[i : i + size], floor[i : i + size]) for i in range(0, len(ids), size))
    return slots


def _found(query_ids: np.ndarray | list, ids: np.ndarray | list, scores: np.ndarray | list, beyond: list[str]) -> pa.RecordBatch:
    arrays = [*(pa.array(a, pa.int64()) for a in (query_ids, ids, scores)), pa.array(beyond, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score", "beyond"])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The k vectors with the highest inner products for each query, exactly.

    vectors: vec_id, embedding; other columns are ignored. Each component x counts as floor(256 * x).
    Queries are the rows whose vec_id is divisible by `every`; candidates all rows with another id
    and as many components. A null id, a null or empty vector, or one with a component that is null
    or not finite takes no part. Equal scores go to the smaller vec_id; repeated rows each count as
    a candidate, and a repeated query id is answered once, for its smallest vector. A query with
    fewer than k candidates gets all of them, one with none no rows. Scores beyond a long are ranked
    by their true size and shown as the nearest long.
    Returns query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    coded = _coded(vectors)
    # a pivot with a third of all vectors is spread over as many tasks as its share asks for
    salts = max(1, math.ceil(vectors.count() / (PIVOTS * BLOCK)))
    coded = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).repartition("code", "salt")
    packed = saved(_packed(coded.sortWithinPartitions("dim", "huge", "code").drop("salt"), k, every), "blocks")

    # a grid of `groups` of blocks by `parts` of queries: each block is sent to every part, each query
    # to every group, which moves least where the two amounts are alike; a part is what a task holds
    asked, numbers = packed.where("kind = 1").agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), WAVES * spark.sparkContext.defaultParallelism)
    parts = max(1, round(math.sqrt(tasks / every)), math.ceil(numbers / HELD))
    groups = max(1, tasks // parts)
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = packed.where("kind = 1").groupBy("vec_id", "huge").agg(F.min(F.struct("q", "floor", "code", "dim")).alias("m")).select("vec_id", "huge", "m.*")
    # of a repeated id the smallest vector, whichever kind it is
    order = Window.partitionBy("vec_id").orderBy(F.when(F.col("huge"), F.transform("q", lambda v: v * 256)).otherwise(F.col("q")))
    queries = queries.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    slots = _slots(queries, max(1, math.ceil(asked / (PIVOTS * SLOT)))).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    blocks = packed.where("kind = 0").withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    columns = "dim", "huge", "code", "ids", "x"
    rows = slots.select(F.lit(0).alias("nth"), *columns, "floors", "part", every_one(groups).alias("group"))
    rows = rows.unionByName(blocks.select(F.lit(1).alias("nth"), *columns, F.lit(None).cast("binary").alias("floors"), "group", every_one(parts).alias("part")))
    # queries come first and are held; the blocks are read one by one. No join: a side that is copied
    # for a grid looks small to the planner, which would send it whole through the driver
    rows = rows.repartitionById(groups * parts, F.col("group") * parts + F.col("part")).sortWithinPartitions("nth")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list] = {}
        slots: dict[int, list[_Slot]] = {}
        for b in batches:
            for nth, dim, huge, code, ids, raw, floors in zip(*(b.column(i).to_pylist() for i in range(4)), *(b.column(i) for i in range(4, 7)), strict=True):
                ids = np.frombuffer(ids.as_py(), np.int64)
                if nth == 0:
                    held.setdefault((dim, huge), []).append((code, ids, _numbers(raw.as_py(), len(ids), dim, huge), np.frombuffer(floors.as_py())))
                    continue
                if held:
                    slots = _joined(held)
                if dim not in slots:
                    continue
                x = _numbers(raw.as_py(), len(ids), dim, huge)
                most, made = float(np.abs(x).max()), {}
                for s in slots[dim]:
                    if huge or s.huge:
                        found = _exact(ids, x if huge else x / 256, s.ids, s.q if s.huge else s.q / 256, k)
                        yield _found([int(s.ids[r[0]]) for r in found], [r[1] for r in found], [min(max(r[2], _LONG[0]), _LONG[1]) for r in found], [_key(r[2]) for r in found])
                        continue
                    number = np.float32 if dim * most * s.most < FLOAT else np.float64
                    if number not in made:
                        made[number] = Block(ids, x.astype(number))
                    s.read(made[number], k)
        for s in (s for same in slots.values() for s in same if len(s.found[0])):
            at, ids, score = s.found
            yield _found(s.ids[at], ids, score.astype(np.int64), [""] * len(at))

    best = per_batch(rows.select("nth", *columns, "floors"), search, "query_id long, vec_id long, score long, beyond string")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
