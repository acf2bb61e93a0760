import random
import time
import tracemalloc

import numpy as np
import pytest

from gridmill.functions import seeded
from gridmill.operators import sampling


def plain_fingerprint(rows):
    h = seeded.FNV_BASIS
    for i in rows:
        for byte in int(i).to_bytes(8, "little", signed=True):
            h = (h ^ byte) * seeded.FNV_PRIME & (1 << 64) - 1
    return f"{h:016x}"


def plain_subset(population, n, seed):
    """The rule on a whole list."""
    draws, order = seeded._draws(seed, 1), list(range(population))
    for i in range(min(n, population - 1)):
        left = population - i
        limit = (1 << 64) - 1 - ((1 << 64) - 1) % left
        r = next(x for x in draws if x < limit)
        order[i], order[i + r % left] = order[i + r % left], order[i]
    return sorted(order[:n])


def test_subsets_equal_the_rule_on_a_list():
    for population, n in [(0, 0), (1, 1), (2, 2), (7, 7), (50, 49), (50, 50), (1000, 300), (999, 0)]:
        for seed in (0, 1, 2**40):
            assert seeded.subset(population, n, seed) == plain_subset(population, n, seed)


def test_subset_of_a_huge_population():
    tracemalloc.start()
    began = time.perf_counter()
    rows = seeded.subset(10**9, 10**5, 3)
    took, (_, most) = time.perf_counter() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(set(rows)) == 10**5 and rows == sorted(rows) and 0 <= rows[0] and rows[-1] < 10**9 and most < 60e6 and took < 60
    assert set(seeded.subset(10**9, 10**4, 3)) <= set(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000])
def test_fingerprints_of_blocks(n):
    rng = random.Random(n)
    rows = sorted(rng.randrange(-(2**63), 2**63) if i % 5 == 0 else rng.randrange(10**6) for i in range(n))
    want = plain_fingerprint(rows)
    assert seeded.fingerprint(rows) == want
    for cut in {0, n // 3, n}:
        assert seeded.Fnv.of(np.array(rows[:cut], np.int64)).then(seeded.Fnv.of(np.array(rows[cut:], np.int64))).digest() == want


def test_fingerprints_of_groups(spark):
    rng = random.Random(0)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.randrange(500)) for _ in range(3000)] + [("hot", 1, i) for i in range(4000)] + [("same", 1, 5)] * 900 + [("one", 2, -7), ("none", 1, None), ("a", 1, None)]
    df = spark.createDataFrame(rows, "g string, h int, sample long").repartition(6)
    want = {}
    for g, h, i in rows:
        if i is not None:
            want.setdefault((g, h), []).append(i)
    got = {(r.g, r.h): (r.n, r.hash) for r in sampling.fingerprints(df, "sample", "g", "h").collect()}
    assert got == {k: (len(v), plain_fingerprint(sorted(v))) for k, v in want.items()}
    (one,) = sampling.fingerprints(spark.range(5000).repartition(5), "id").collect()
    assert tuple(one) == (5000, plain_fingerprint(range(5000))) and sampling.fingerprints(df.limit(0), "sample").count() == 0


def test_records_and_tables_of_subsets(spark):
    record = sampling.subset_record(1000, 25, 0)
    assert record["hash"] == "65104831155be79e"
    assert [r.sample for r in sampling.verified_subset(spark, record, 25, 1000).orderBy("sample").collect()] == seeded.subset(1000, 25, 0)
    assert sampling.exact_subset(spark, 10, 0, 1).count() == 0
    table = sampling.exact_subset(spark, 10**9, 5000, 9)
    (row,) = sampling.fingerprints(table, "sample").collect()
    assert row.hash == sampling.subset_record(10**9, 5000, 9)["hash"]
