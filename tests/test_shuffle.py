import pytest
from pyspark.sql import functions as F

from gridmill.functions import shuffle
from gridmill.operators import sampling


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 100, 1009])
def test_places_are_a_permutation_that_can_be_undone(spark, n):
    p = shuffle.Permutation.of(n)
    assert p.a * p.b >= n
    rows = spark.range(n).withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(3)))).withColumn("place", p.place(F.col("id"), 5, F.col("epoch")))
    got = rows.withColumn("back", p.number(F.col("place"), 5, F.col("epoch"))).collect()
    for e in (0, 3):
        mine = [r for r in got if r.epoch == e]
        assert sorted(r.place for r in mine) == list(range(n)) and all(r.back == r.id for r in mine)
        assert all(r.place == shuffle.plain(p, r.id, 5, e) for r in mine)
    if n > 90:
        orders = {tuple(shuffle.plain(p, x, s, e) for x in range(n)) for s in (1, 2) for e in (0, 1)}
        assert len(orders) == 4
        # no place goes with its number: correlation over all numbers is small
        x = [r.place for r in sorted((r for r in got if r.epoch == 0), key=lambda r: r.id)]
        mean = (n - 1) / 2
        assert abs(sum((i - mean) * (v - mean) for i, v in enumerate(x)) / sum((i - mean) ** 2 for i in range(n))) < 0.35


def test_large_sizes_have_a_small_excess():
    for n in (10**6 + 1, 10**9, 10**12 + 39, 2**50 - 27):
        p = shuffle.Permutation.of(n)
        assert 0 <= p.walks < n**0.5 / 500 + 2 and 0 <= shuffle.plain(p, n - 1, 7, 1) < n


def test_large_numbers(spark):
    n = 2**50 - 27
    p = shuffle.Permutation.of(n)
    ids = [0, 1, n - 1, n // 2, 2**49 + 1]
    df = spark.createDataFrame([(i,) for i in ids], "id long").withColumn("place", p._rounds(F.col("id"), 7, F.lit(2)))
    got = df.withColumn("back", p._undone(F.col("place"), 7, F.lit(2))).collect()
    assert all(r.back == r.id and (r.place == shuffle.plain(p, r.id, 7, 2) or r.place >= n) for r in got)


def test_batches_of_epochs(spark):
    samples = spark.createDataFrame([(i * 3 + 1,) for i in range(103)], "sample long").repartition(5)
    rows = sampling.batches(samples, 3, 10, 4).collect()
    ids = sorted(r.sample for r in samples.collect())
    for e in range(3):
        mine = sorted((r for r in rows if r.epoch == e), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(103)) and sorted(r.sample for r in mine) == ids and [r.batch for r in mine] == [p // 10 for p in range(103)]
    assert [r.sample for r in sorted(rows, key=lambda r: (r.epoch, r.place))][:103] != [r.sample for r in sorted(rows, key=lambda r: (r.epoch, r.place))][103:206]
    places = spark.range(103).select(sampling.sample_number(F.col("id"), 103, 4, F.lit(1)).alias("n")).collect()
    assert [ids[r.n] for r in places] == [r.sample for r in sorted((r for r in rows if r.epoch == 1), key=lambda r: r.place)]
    # the epochs are not exchanged: ids are, to be numbered
    plan = sampling.batches(samples, 50, 10, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Exchange")
