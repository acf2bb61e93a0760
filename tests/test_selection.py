import math
import random

import pytest
from pyspark.sql import functions as F

from gridmill.operators import runs, selection


def brute(rows):
    groups = {}
    for g, x in rows:
        groups.setdefault(g, []).append(x)
    out = {}
    for g, xs in groups.items():
        xs = sorted((x for x in xs if x is not None), key=lambda x: (math.isnan(x), 0.0 if math.isnan(x) else x))
        out[g] = (len(xs), xs[len(xs) // 2] if xs else None)
    return out


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b)


@pytest.mark.parametrize(("few", "bits"), [(1 << 16, 12), (3, 12), (1, 5), (0, 63)])
def test_medians_equal_sorting(spark, monkeypatch, few, bits):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "BITS", bits)
    rng = random.Random(few)
    rows = [("a", rng.gauss(0, 1)) for _ in range(301)] + [("b", float(rng.randrange(4))) for _ in range(200)] + [("c", 2.5)] * 50
    rows += [("d", rng.choice([1e-300, -1e300, 1e300, -1e-310, 0.0, -0.0, 5e-324])) for _ in range(77)] + [("e", None)] * 9 + [(None, float(i)) for i in range(10)]
    rows += [("f", x) for x in (float("nan"), float("inf"), float("-inf"), 1.0, float("nan"), None)] + [("g", float("nan"))] * 3 + [("h", -1.5), ("i", 1.0), ("i", 2.0)] + [("j", -float(i)) for i in range(40)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: (r.n, r.median) for r in selection.upper_medians(df, "x", "g").collect()}
    want = brute(rows)
    assert got.keys() == want.keys() and all(got[g][0] == want[g][0] and same(got[g][1], want[g][1]) for g in want)


def test_one_group_of_all_and_none(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 10)
    df = spark.range(1001).select((F.col("id") * 7919 % 1001).cast("double").alias("x"))
    assert [tuple(r) for r in selection.upper_medians(df, "x").collect()] == [(1001, 500.0)]
    assert selection.upper_medians(df.limit(0), "x").count() == 0
    assert [tuple(r) for r in selection.upper_medians(df.limit(8).withColumn("x", F.lit(3.5)), "x").collect()] == [(8, 3.5)]


def test_no_group_is_gathered(spark, monkeypatch):
    """With few rows allowed a task, no list of a group's values is made for large groups."""
    monkeypatch.setattr(selection, "FEW", 4)
    rows = [(load, d, float(i % 13 + d), 5 + i % 46) for load in (0, 1) for d in (1, 2, 4) for i in range(100)] + [(0, 8, None, 7), (1, 2, 100.0, 60)]
    df = spark.createDataFrame(rows, "load int, devices int, epoch_time_s double, epoch int")
    got = {(r.load, r.devices): r for r in runs.device_scaling(df).collect()}
    want = brute([((a, d), x) for a, d, x, e in rows if 5 <= e <= 50])
    assert {k: r.median for k, r in got.items()} == {k: m for k, (_, m) in want.items()}
    assert got[0, 2].speedup == want[0, 1][1] / want[0, 2][1] and got[0, 8].speedup is None and got[1, 4].efficiency == got[1, 4].speedup / 4
