import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridmill.llm import lexical, quantize, sharding


# vector codes
def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, v) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((-(-len(v) // parts) for _, _, v in kept), default=0)

    def cut(v):
        each = -(-len(v) // parts)
        v = [int(x) * 256 if abs(x) >= 2**53 else math.floor(x * 256) for x in v] + [0] * (each * parts - len(v))
        return [v[p * each : (p + 1) * each] + [0] * (width - each) for p in range(parts)]

    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    xs = [cut(v) for _, _, v in kept]
    books = [[x[p] for x in xs[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        codes = [[nearest(x[p], books[p])[1] for p in range(parts)] for x in xs]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x[p] for x, c in zip(xs, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out, by_label = [], Counter()
    for (i, label, _), x in zip(kept, xs, strict=True):
        near = [nearest(x[p], books[p]) for p in range(parts)]
        error = min(sum(d for d, _ in near), 2**63 - 1)
        by_label[label] += error
        out.append([i, "".join(f"{c:02x}" for _, c in near), error, label, digest])
    return sorted(((i, c, e, min(by_label[label], 2**63 - 1), d) for i, c, e, label, d in out), key=str)


def codes(spark, rows, kind="float"):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, label int, embedding array<{kind}>, code string, error int")
    return sorted((tuple(r) for r in quantize.compressed(df).collect()), key=str)


def exact(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [None, 1, 2][i % 3], exact((rng.normal(size=32) * [1, 5, 0.01][i % 3]).tolist())) for i in range(150)]
    rows += [(200 + i, 1, [0.25] * 32) for i in range(30)] + [(7, 2, [0.5] * 32), (7, 2, [0.5] * 32), (None, None, [1.0] * 32)]
    rows += [(300, 1, None), (301, 1, [1.0, None] * 16), (302, 1, [float("nan")] * 32), (303, 1, [float("-inf")] * 32)]
    assert codes(spark, rows) == brute_codes(rows)


def test_codes_of_few_short_and_empty_vectors(spark):
    rows = [(1, 1, [0.5, -0.25, 1.0]), (2, 1, [0.25] * 40), (3, None, []), (4, None, [1.0] * 16)]
    assert codes(spark, rows) == brute_codes(rows)
    assert codes(spark, [(1, 1, []), (2, None, [])]) == brute_codes([(1, 1, []), (2, None, [])])
    assert codes(spark, []) == [] and codes(spark, [(1, 1, None)]) == []


def test_codes_of_components_of_any_size(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 1, rng.normal(size=16).tolist()) for i in range(70)]
    rows += [(70 + i, 2, (rng.normal(size=16) * 10.0**s).tolist()) for i, s in enumerate((6, 9, 15, 18, 40, 300))]
    rows += [(90, 2, [1.7e308] * 16), (91, 3, [-1.7e308, 1.0] * 8), (-1, 3, [1e12] * 16)]
    assert codes(spark, rows, "double") == brute_codes(rows)


@pytest.mark.parametrize("width", [1, 3, 4, 7, 8])
def test_elimination_keeps_the_nearest_and_the_lower_of_equals(width):
    rng = np.random.default_rng(width)
    books = quantize.Codebooks(rng.integers(-3, 4, size=(4, 20, width)))
    x = rng.integers(-4, 5, size=(300, 4, width))
    d = ((x[:, :, None, :] - books.entries[None]) ** 2).sum(3)
    got, gap = books.nearest(x)
    assert np.array_equal(got, d.argmin(2)) and np.array_equal(gap, d.min(2))


def test_sequency_order():
    for n in (1, 2, 8, 16):
        h = quantize.sequency(n)
        assert np.array_equal(h @ h.T, n * np.eye(n)) and [(np.diff(r) != 0).sum() for r in h] == list(range(n))


def test_decoded_vectors_are_near(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, exact(rng.normal(size=16).tolist())) for i in range(40)], "vec_id long, embedding array<float>")
    books = quantize.fit(df)
    got = {r.vec_id: r.embedding for r in quantize.decode(quantize.encode(df, books), books).collect()}
    # fewer vectors than entries: each is an entry of its own, but for the floor
    assert all(np.abs(np.array(got[r.vec_id]) - r.embedding).max() <= 1 / 256 for r in df.collect())


# shards
def brute_shards(rows, shards):
    order = sorted(((i is not None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows))
    whole, before, slots, out = sum(r[2] for r in order), 0, Counter(), []
    for place, (some, i, size, crc) in enumerate(order):
        shard = (2 * before + size) * shards // (2 * whole)
        out.append((i if some else None, size, crc, "bytes", shard, slots[shard], None, place))
        slots[shard] += 1
        before += size
    return out


def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, shard string, size int")


def test_shards_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(400), rng.choice([None, "", "ä" * rng.randrange(50), "word " * rng.randrange(200)])) for _ in range(500)]
    rows += [(5, "the same row")] * 700 + [(None, "no id"), (None, None), (None, None), (999, "x" * 40_000)]
    got = [tuple(r) for r in sharding.assigned(docs(spark, rows).repartition(7)).orderBy("place").collect()]
    assert got == brute_shards(rows, 40)
    assert sharding.assigned(docs(spark, [])).count() == 0
    assert [r.shard for r in sharding.assigned(docs(spark, [(1, "a")])).collect()] == [20]


def test_shards_are_near_equal_and_contiguous(spark):
    rng = random.Random(2)
    rows = [(i, "x" * int(rng.paretovariate(1.2) * 50)) for i in range(3000)]
    sizes, largest = Counter(), max(len(t) + 16 for _, t in rows)
    got = sharding.assigned(docs(spark, rows)).orderBy("doc_id").collect()
    for r in got:
        sizes[r.shard] += r["size"]
    target = sum(sizes.values()) / 40
    assert all(abs(sizes[s] - target) < largest for s in range(40))
    assert [r.shard for r in got] == sorted(r.shard for r in got)


def test_written_shards_hold_whole_rows(spark, tmp_path):
    rows = [(i // 2, f"text {i}" * (i % 9)) for i in range(200)] + [(None, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, `a.b` int")
    sharding.write_shards(df, f"file://{tmp_path}/out", 5)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    want = Counter((r.doc_id, r.shard, r.slot) for r in sharding.assigned(df, 5).collect())
    assert Counter((r.doc_id, r.shard, r.slot) for r in back.collect()) == want
    assert sorted((r["a.b"], r.doc_id, r.text) for r in back.collect()) == sorted((i, *r) for i, r in enumerate(rows))
    with pytest.raises(ValueError):
        sharding.write_shards(docs(spark, rows), f"file://{tmp_path}/no", 5)


# lexical search
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(rows, items, k=10):
    held = [(i, Counter(PATTERN.findall((t or "").translate(LOWER)))) for i, t in rows]
    n_docs, total = sum(1 for _, c in held if c), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(PATTERN.findall((t or "").translate(LOWER)))
    out = []
    for item, found in asked.items():
        scores = []
        for i, c in held:
            n = c.total()
            m = 100 - 90 + 90 * n * n_docs // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in found if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(scores[:k])]
    return sorted(out, key=str)


def search(spark, rows, items, k=10):
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, rank int, term string")
    asked = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, score int")
    return sorted((tuple(r) for r in lexical.search(df, asked, k).collect()), key=str)


WORDS = ["Alpha", "beta", "ÄÖ", "äö", "x1", "1", "γ", "KelvinK", "it's", "a_b", "semi;colon", "zeta", "日本", "tab\tbed", " ", "é"]


def corpus(seed, n):
    rng = random.Random(seed)
    rows = [(i, rng.choice([" ", "\n", "-"]).join(rng.choices(WORDS, range(1, len(WORDS) + 1), k=rng.randrange(30)))) for i in range(n)]
    rows += [(1000 + i, "zeta beta zeta") for i in range(40)] + [(3, "alpha"), (3, "alpha"), (None, "alpha zeta"), (None, None), (5000, None), (5001, ""), (5002, "...")]
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 9)))) for i in range(12)]
    return rows, [*items, (50, None), (51, ""), (52, "unheard of"), (53, "zeta"), (53, "alpha zeta"), (None, "alpha ALPHA"), (54, "beta")]


@pytest.mark.parametrize(("small", "k"), [(False, 10), (True, 10), (True, 3)])
def test_search_equals_brute_force(spark, monkeypatch, small, k):
    if small:
        for name, n in (("DOCS", 7), ("ITEMS", 3), ("TERMS", 2), ("STRETCH", 5), ("PASS_TERMS", 20)):
            monkeypatch.setattr(lexical, name, n)
    rows, items = corpus(k, 200)
    got = search(spark, rows, items, k)
    assert got == brute_search(rows, items, k) and {r[0] for r in got} >= {53, 54, None} and not {r[0] for r in got} & {50, 51, 52}


def test_search_of_empty_tables(spark):
    rows, items = corpus(1, 5)
    assert search(spark, [], items) == [] and search(spark, rows, []) == [] and search(spark, [(1, None)], items) == []


def test_long_texts_are_read_by_stretches(monkeypatch):
    text = ("Some wörds; 日本 and_more " * 400).encode()
    monkeypatch.setattr(lexical, "STRETCH", 13)
    assert [t.decode() for part in lexical.terms(text) for t in part] == PATTERN.findall(text.decode().translate(LOWER))


def test_tiles_keep_sums_exact():
    weights = np.full(50, 1 << 31)
    tiles = lexical.Tiles([list(range(50))], weights)
    assert tiles.width == 4 and tiles.width * (1 << 31) * (lexical.IMPACT // lexical.TF) < 1 << 53
    impact = np.full(50, 999_999)
    ((_, got),) = tiles.scores(np.zeros(50, int), np.arange(50), impact, 1)
    assert got.tolist() == [[50 * 999_999 << 31]]


def test_damping_of_very_large_tables():
    n = np.array([10**7, 3])
    assert lexical.damping(n, 10**12, 10**15).tolist() == [10 + 90 * 10**7 * 10**12 // 10**15, 10]
