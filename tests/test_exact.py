import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.functions import blocks, exact
from gridmill.operators import errors, generate, normalize, pod, transfer


@pytest.mark.parametrize("scale", [1.0, 1e-150, 1e140, 1e-300])
def test_sums_are_exact_in_any_order(scale):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(400, 3)) * 10.0 ** rng.integers(-12, 12, (400, 3)) * scale
    a[::7] = 0.0
    bits = set()
    for order in (np.arange(400), rng.permutation(400), np.arange(399, -1, -1)):
        whole = exact.Sums(3)
        for part in np.array_split(a[order], 7):
            s = exact.Sums(3)
            s.add(part)
            whole.merge(s)
        v, shift = whole.whole()
        assert [Fraction(x) * Fraction(2) ** shift for x in v] == [sum(map(Fraction, col)) for col in a.T.tolist()]
        bits.add(str([exact._quotient(x, 400, shift) for x in v]))
    assert len(bits) == 1 and eval(bits.pop()) == [float(sum(map(Fraction, col)) / 400) for col in a.T.tolist()]


def test_moments_are_rounded_once():
    rng = np.random.default_rng(1)
    a = 1e6 + rng.normal(size=(1000, 5)) * 1e-4
    m = exact.Moments(5)
    m.add(a)
    m = exact.Moments.load(*m.dump(), 5)
    mean, std = m.mean_and_std()
    for j, col in enumerate(a.T.tolist()):
        x = [Fraction(v) for v in col]
        want = sum(x) / 1000
        assert mean[j] == float(want) and math.isclose(std[j], math.sqrt(sum((v - want) ** 2 for v in x) / 999), rel_tol=1e-15)


def test_odd_numbers():
    m = exact.Moments(4)
    with np.errstate(all="ignore"):
        m.add(np.array([[1.0, np.nan, np.inf, 1e200], [2.0, 1.0, -np.inf, 1e200], [3.0, 1.0, 1.0, -1e200]]))
    mean, std = m.mean_and_std()
    assert mean[0] == 2 and std[0] == 1 and np.isnan(mean[1:3]).all() and np.isnan(std[1:]).all() and mean[3] == 1e200 / 3


@pytest.mark.parametrize("kind", ["array", "packed"])
def test_statistics_have_equal_bits_for_any_tasks(spark, kind):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(300, 12)) * 10.0 ** rng.integers(-8, 8, (300, 12))
    df = spark.createDataFrame([(int(i), "ab"[i % 2], x.tolist()) for i, x in enumerate(a)] + [(-1, "a", None)], "sample long, g string, v array<double>")
    if kind == "packed":
        df = df.withColumn("v", blocks.pack("v", (12,)))
    seen = set()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got = normalize.moments(df.repartition(parts, F.xxhash64("sample", F.lit(parts))), "v", "g").orderBy("g").collect()
            seen.add(str([(r.g, r.n, r["mean"], r["std"]) for r in got]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(seen) == 1
    assert np.allclose(got[0]["mean"], a[::2].mean(0), rtol=1e-12) and np.allclose(got[1]["std"], a[1::2].std(0, ddof=1), rtol=1e-12) and got[0].n == 150


def test_fields_of_different_sizes_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "sample long, v array<double>").repartition(2)
    with pytest.raises(Exception, match="fields of"):
        normalize.moments(df, "v").collect()


def test_packed_fields_give_what_arrays_give(spark):
    rows = generate.split(spark, 9, 40, 3, k_max=4, parts=3)
    both = rows.withColumn("p", blocks.pack("f", (9, 9)))
    made = generate.labelled(spark.range(40).withColumnRenamed("id", "sample"), 9, 3, 4, packed=True)
    plain = {r["sample"]: r for r in both.select("sample", "f", transfer.to_uniform("f", 9, 5).alias("a"), transfer.to_uniform("p", 9, 5).alias("b"), blocks.unpack(transfer.to_uniform("p", 9, 5, packed=True), (5, 5)).alias("c")).collect()}
    for r in plain.values():
        assert r.a == r.b == r.c
    assert all(r.x == plain[r["sample"]].f for r in made.select("sample", blocks.unpack("f", (9, 9)).alias("x")).collect())
    with_null = both.select(F.when(F.col("sample") % 3 != 0, F.col("p")).alias("p"), "sample")
    got = {r["sample"]: r.c for r in with_null.select("sample", blocks.unpack(transfer.to_uniform("p", 9, 5, packed=True), (5, 5)).alias("c")).collect()}
    assert all(got[i] == (plain[i].a if i % 3 else None) for i in got)
    w = pod.grid_weights(9, "chebyshev")
    one, two = pod.fit(both, "f", w), pod.fit(both, "p", w)
    pod.check(two, both, "p")
    assert np.allclose(one.sigma, two.sigma, rtol=1e-12)
    with pytest.raises(Exception, match="are expected"):
        both.select(transfer.to_uniform("p", 8, 5).alias("x")).collect()


def test_errors_by_resolution(spark):
    rows = None
    for n in (9, 17):
        part = generate.split(spark, n, 60, 3, k_max=4).select(F.lit(n).alias("n"), F.when(F.col("sample") < 40, "train").otherwise("test").alias("split"), "sample", "f", F.col("f").alias("u"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.unionByName(rows.limit(1).withColumn("u", F.lit(None).cast("array<double>")).withColumn("split", F.lit("test")))
    got = {r.n: r for r in errors.resolution_errors(rows, lambda x: x, 9).collect()}
    # the input is the target, and so is what the model gives: what is left is the round trip
    for n, r in got.items():
        assert r.n_test == 20 and r.s == n - 1 and r.model_worst < 1e-6 and math.isclose(r.total_mean, r.transfer_mean, rel_tol=1e-3) and 0 < r.transfer_mean <= r.transfer_worst
    assert got[17].transfer_mean < got[9].transfer_mean and got[9].ratio == 1
    last = spark.createDataFrame([(got[9].model_mean,)], "test_l2 double")
    assert {r.n: r.agrees for r in errors.resolution_errors(rows, lambda x: x, 9, last).collect()} == {9: True, 17: None}
