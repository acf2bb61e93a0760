import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.functions import grids
from gridmill.operators import errors, fields, generate, losses, normalize, pod, runs, sampling, tracking, transfer


def frame(spark, arrays, **more):
    rows = [(i, [float(x) for x in np.ravel(a)]) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "sample long, values array<double>")


def test_strided_points(spark):
    a = np.add.outer(10 * np.arange(6), np.arange(8))
    got = frame(spark, [a]).select(fields.strided("values", 3, 8).alias("v")).first().v
    assert got == [0, 3, 6, 30, 33, 36]
    assert fields.points_left(8, 3) == 3 and fields.line_points(8) == 1024 and fields.plane_points(3) == 141
    with pytest.raises(ValueError):
        fields.strided("values", 0)


def test_validation(spark):
    df = frame(spark, np.ones((4, 9)))
    assert fields.check_shape(df, "values", 3, 4) is df and fields.check_points(df, "values", 9) is df
    with pytest.raises(ValueError):
        fields.check_shape(df, "values", 3, 5)
    with pytest.raises(ValueError):
        fields.check_points(df, "values", 8)
    nodes = spark.createDataFrame([(grids.chebyshev(9).tolist(),)], "x array<double>")
    assert fields.check_nodes(nodes, "x", 9) is nodes
    for bad in (grids.uniform(9).tolist(), [float("nan"), *grids.chebyshev(9)[1:].tolist()], grids.chebyshev(9)[:8].tolist()):
        with pytest.raises(ValueError):
            fields.check_nodes(spark.createDataFrame([(bad,)], "x array<double>"), "x", 9)
    with pytest.raises(ValueError):
        fields.pairs(df, df.where("sample < 3"))
    with pytest.raises(ValueError):
        fields.first_and_last(df, 3, 2)
    split = df.withColumn("split", F.lit("train"))
    with pytest.raises(ValueError):
        fields.prefixes(split, {"train": 5})


def test_normalizer_values(spark):
    df = frame(spark, [[1, 3], [3, 7]])
    got = normalize.moments(df.repartition(2), "values").first()
    assert got.n == 2 and np.allclose(got["mean"], [2, 5]) and np.allclose(got["std"], [2**0.5, 8**0.5])
    with pytest.raises(Exception, match="two samples"):
        normalize.moments(df.limit(1), "values").collect()
    saved = normalize.record(normalize.moments(df, "values"), [2])
    with pytest.raises(ValueError):
        normalize.loaded(saved, [3])


def test_losses(spark):
    df = spark.createDataFrame([([2.0, 0.0], [1.0, 0.0]), ([3.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [0.0, 0.0]), ([0.0, 0.0], [0.0, 0.0])], "p array<double>, t array<double>")
    got = [r[0] for r in df.select(losses.relative("p", "t")).collect()]
    assert got[:3] == [1.0, 2.0, float("inf")] and np.isnan(got[3])
    l1 = spark.createDataFrame([([2.0, 3.0], [1.0, 1.0])], "p array<double>, t array<double>").select(losses.relative("p", "t", 1)).first()[0]
    assert l1 == 1.5
    with pytest.raises(ValueError):
        losses.relative("p", "t", 0.5)
    with pytest.raises(ValueError):
        losses.absolute("p", "t", [1, 3])


def test_weighted_error_at_extremes():
    w = grids.clenshaw_curtis(5)
    b = np.ones((1, 5, 5))
    for scale in (1e-200, 1.0, 1e200):
        assert np.isclose(losses.cc_rel(b * 1.5 * scale, b * scale, w)[0], 0.5)
    assert np.isnan(losses.cc_rel(0 * b, 0 * b, w)[0]) and np.isinf(losses.cc_rel(b, 0 * b, w)[0])


def test_epoch_means_have_two_denominators(spark):
    rows = spark.createDataFrame([(0, 0, 1.0, 1.0), (0, 0, 3.0, 3.0), (0, 1, 5.0, 6.0)], "epoch int, batch int, mse double, l2 double")
    got = losses.epoch_means(rows).first()
    assert got.mse == 3.5 and np.isclose(got.l2, 10 / 3)


def test_exact_prediction_has_transfer_error_only(spark):
    x = grids.chebyshev(17)
    u = [(1 + k) * np.outer(1 - x**2, (1 - x**2) * np.cos(x)) for k in range(3)]
    df = frame(spark, u).withColumn("pred", transfer.to_uniform("values", 17, 12))
    got = df.select(errors.sample_errors("pred", "values", 12, 17).alias("e")).select("e.*").collect()
    for r in got:
        assert r.model == 0 and np.isclose(r.transfer, r.total) and r.boundary_ratio < 1e-12


def test_boundary_counts_corners_twice():
    u = np.zeros((1, 3, 3))
    u[0, 0, 0] = 1.0
    w = grids.clenshaw_curtis(3)
    ratio, rms = errors.boundary(u, np.ones((1, 3, 3)), w)
    assert ratio[0] == 1 and np.isclose(rms[0], np.sqrt(2 * w[0] / 8))


def test_stats(spark):
    def of(*values):
        df = spark.createDataFrame([(x,) for x in values], "x double")
        return df.agg(errors.stats(F.col("x")).alias("s")).first().s

    assert of(1.0, 3.0, 2.0) == (2.0, 3.0)
    assert all(np.isnan(x) for x in of(1.0, float("nan"))) and all(np.isnan(x) for x in of())
    rows = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, float("nan"))], "sample long, e double")
    assert errors.worst_sample(rows, "e").first().worst_sample == 1


def test_pod_of_rank_three(spark):
    x, y = np.meshgrid(grids.chebyshev(8), grids.chebyshev(8), indexing="ij")
    c = np.sin(np.outer(np.arange(40), [1.1, 1.8, 2.5]) + np.arange(3))
    family = [1 + x + a * (x**2 + y) + b * np.sin(np.pi * x) * np.cos(y) + d * np.exp(x * y) for a, b, d in c]
    df = frame(spark, family).repartition(3)
    fitted = pod.fit(df, "values", pod.grid_weights(8, "chebyshev"))
    pod.check(fitted)
    assert fitted.sigma[2] > 1e-3 and fitted.sigma[3] < 1e-10
    worst = {r["rank"]: r.worst for r in pod.by_rank(df, "values", fitted, 8, [1, 3]).collect()}
    assert worst[3] < 1e-12 < worst[1]
    m = (np.array(family).reshape(40, -1) - fitted.mean) * np.sqrt(fitted.weights)
    assert np.allclose(np.linalg.svd(m, compute_uv=False)[:3], fitted.sigma[:3])
    with pytest.raises(ValueError):
        pod.fit(df.limit(1), "values", pod.grid_weights(8, "chebyshev"))
    with pytest.raises(ValueError):
        fitted.sigma = fitted.sigma * 1.1
        pod.check(fitted)


def test_generated_split(spark):
    rows = generate.split(spark, 65, 4, 7, k_max=16, parts=2)
    got = rows.select("sample", "seed", "label_error", "transfer").orderBy("sample").collect()
    assert [r.seed for r in got] == [7, 8, 9, 10] and max(r.label_error for r in got) < 1e-8
    assert np.array_equal(generate.draw(3, 8), generate.draw(3, 16)[:8, :8])
    again = generate.split(spark, 65, 4, 7, k_max=16, parts=1)
    assert rows.select("sample", "f").orderBy("sample").first() == again.select("sample", "f").orderBy("sample").first()
    many = generate.split(spark, 9, 400, 0)
    assert abs(generate.point_moments(many).agg(F.avg("mean_square")).first()[0] - 1) < 0.6


def test_spectrum(spark):
    rows = generate.spectrum(spark, 8).orderBy("i").collect()
    assert [r.q for r in rows] == sorted(r.q for r in rows) and np.isclose(sum(r.f for r in rows), 4)
    assert all(a.f >= b.f - 1e-15 and a.u >= b.u - 1e-15 for a, b in zip(rows, rows[1:], strict=False))
    eps = generate.tail(spark, 32).first().eps_k
    assert abs(eps - 4.9e-3) < 5e-5
    assert [generate.default_truncation(n) for n in (33, 65, 129, 257)] == [16, 32, 64, 64]


def test_manufactured_pairs_are_solved(spark):
    rows = generate.manufactured(spark, 25).orderBy("name", "i", "j").toPandas()
    for name, g in rows.groupby("name"):
        u, f = g.u.to_numpy().reshape(1, 25, 25), g.f.to_numpy().reshape(1, 25, 25)
        assert np.abs(grids.Poisson(25, 25)(f) - u).max() < 1e-8, name


def test_scoring_checks_modes():
    rng = np.random.default_rng(0)
    layer = (np.zeros((2, 2, 2, 3, 3), complex), np.eye(3), np.zeros(3))
    model = errors.FourierModel((rng.normal(size=(3, 3)), np.zeros(3)), [layer], [(np.ones((3, 1)), np.zeros(1))])
    x = rng.normal(size=(2, 5, 5))
    y, z = np.meshgrid(np.arange(5) / 4, np.arange(5) / 4, indexing="ij")
    want = np.stack([x, np.broadcast_to(z, x.shape), np.broadcast_to(y, x.shape)], -1) @ model.lift[0]
    assert np.allclose(model(x), want.sum(-1))
    with pytest.raises(ValueError):
        model(rng.normal(size=(1, 3, 3)))


def test_shards_and_batches(spark):
    rows = spark.range(11).select(F.col("id").alias("sample"))
    got = rows.select(sampling.shard(F.col("sample"), F.lit(11), 4)).collect()
    assert [r[0] for r in got] == [0] * 3 + [1] * 3 + [2] * 3 + [3] * 2
    b = sampling.batches(rows, 2, 4, 5).collect()
    for epoch in (0, 1):
        own = sorted((r for r in b if r.epoch == epoch), key=lambda r: r.place)
        assert [r.place for r in own] == [*range(11)] and sorted(r.sample for r in own) == [*range(11)]
        assert [r.batch for r in own] == [0] * 4 + [1] * 4 + [2] * 3
    small, large = ({r.sample for r in sampling.hashed_subset(rows, n, 1).collect()} for n in (3, 7))
    assert small < large and len(large) == 7
    record = sampling.subset_record(100, 10, 3)
    assert sampling.verified_subset(spark, record, 10, 100).count() == 10
    with pytest.raises(ValueError):
        sampling.verified_subset(spark, record | {"hash": "0"}, 10, 100)
    with pytest.raises(ValueError):
        sampling.verified_subset(spark, record, 10, 99)


def test_run_rules(spark):
    v = spark.createDataFrame([(0.3,), (0.1,), (0.2,), (None,)], "x double").agg(runs.spread(F.col("x")).alias("s")).first().s
    assert np.isclose(v["mean"], 0.2) and (v.low, v.high) == (0.1, 0.3)
    rows = spark.createDataFrame([(25, 0.3), (25, 0.2), (100, 0.03), (100, 0.01), (1000, 0.011), (1000, 0.010), (1000, 0.012)], "n int, e double")
    sizes = runs.by_size(rows, "e")
    least = runs.smallest_size(sizes).first()
    assert least.n == 100 and not least.all_meet
    steps = runs.steps_between(spark.createDataFrame([(25, 0.25, 80.0), (50, 0.15, 95.0), (100, 0.16, None)], "n int, mean double, time double")).orderBy("n").collect()
    assert np.isclose(steps[0].fall, 0.1) and steps[0].more_time == 15 and steps[1].samples_per is None and steps[1].more_time is None
    means = {(r.by, r.key): r["mean"] for r in runs.means_by(spark.createDataFrame([(1, 1, 0, 0.2), (1, None, 1, 0.5), (1, 1, 2, 0.4)], "n int, subset_seed long, seed long, e double"), "e").collect()}
    assert np.isclose(means["subset_seed", 1], 0.3) and means["subset_seed", None] == 0.5
    with pytest.raises(ValueError):
        runs.assert_alike(spark.createDataFrame([("a",), (None,)], "backend string"), "backend")


def test_assembly_needs_all_but_costs(spark):
    data = spark.createDataFrame([("a", 8, 40), ("b", 8, 40)], "run string, s int, n_train int")
    training = spark.createDataFrame([("a", 20, 2), ("b", 20, 2)], "run string, batch_size int, epochs int")
    model = spark.createDataFrame([("a", 0), ("b", 4)], "run string, padding int")
    metrics = spark.createDataFrame([("a", 0, 0.5, 0.6, 9.0), ("a", 1, 0.4, 0.5, 2.0), ("a", 2, 0.3, 0.5, 3.0), ("b", 0, 0.1, 0.2, None)], "run string, epoch int, train_l2 double, test_l2 double, epoch_time_s double")
    faults = spark.createDataFrame([("a", 8, 0.1), ("b", 8, 0.2)], "run string, s int, total double")
    costs = spark.createDataFrame([("a", 7, 1, None)], "run string, optimisation_steps long, forward_passes long, backward_passes long")
    got = {r.run: r for r in runs.assembled(data, training, model, metrics, faults, costs).collect()}
    assert (got["a"].median_time, got["a"].steps, got["a"].passes, got["a"].epoch) == (3.0, 7, None, 2)
    assert (got["b"].median_time, got["b"].steps) == (None, 4)
    for m, e, said in ((metrics.where("run = 'a'"), faults, "no metrics of run b"), (metrics, faults.where("run = 'a'"), "no errors of run b"), (metrics, faults.withColumn("s", F.lit(9)), "different grids")):
        with pytest.raises(Exception, match=said):
            runs.assembled(data, training, model, m, e, costs).select("run").collect()


def test_export_rules(spark):
    rows = spark.createDataFrame([("r_5", float("nan")), ("r_5", float("inf")), ("r_5", 1.5)], "run string, x double")
    assert [r[0] for r in rows.select(tracking.as_text(F.col("x"))).collect()] == ["NaN", "Infinity", "1.5"]
    with pytest.raises(ValueError):
        tracking.check_lengths(spark.createDataFrame([("r", "k", "v" * 251)], "run string, key string, value string"))
    many = spark.range(2500).select(F.lit("r").alias("run"), F.lit("loss").alias("key"), F.col("id").alias("step"), F.lit(1.0).alias("value"))
    sizes = sorted(r.n for r in tracking.request_batches(many, tracking.MOST_METRICS, "step").collect())
    assert sizes == [500, 1000, 1000]


def test_restriction_choice(spark):
    sweep = spark.createDataFrame([("plain", 5, 2, 1.05), ("cell mean", 5, 2, 1.0), ("plain", 6, 2, 2.0), ("cell mean", 6, 2, 1.0)], "restriction string, s int, degree int, mean double")
    got = {r.s: r.restriction for r in transfer.best_restriction(sweep).collect()}
    assert got == {5: "plain", 6: "cell mean"}
    rows = spark.createDataFrame([(65, 2, 0.1), (129, 2, 0.3), (65, 3, 0.1), (129, 3, 0.2), (33, 3, 9.0)], "n int, degree int, worst double")
    assert transfer.best_degree(rows, 0.2).first().degree == 3


def test_decomposition_of_a_large_grid_with_few_samples(spark):
    from gridmill.operators import pod

    n, k = 129, 12
    a = np.random.default_rng(0).normal(size=(k, n * n))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)], "sample long, values array<double>").repartition(3)
    w = pod.grid_weights(n, "chebyshev")
    fitted = pod.fit(df, "values", w)
    pod.check(fitted)
    centred = (a - a.mean(0)) * np.sqrt(w)
    want = np.linalg.svd(centred, compute_uv=False)
    assert fitted.samples == k and np.allclose(fitted.sigma[: k - 1], want[: k - 1], rtol=1e-10) and fitted.modes.shape[1] == n * n


def test_covariance_of_generated_fields(spark):
    from gridmill.operators import generate

    rows = generate.split(spark, 17, 600, 5_000, k_max=8)
    pairs = [((8, 8), (8, 8)), ((8, 8), (4, 8)), ((4, 4), (12, 12)), ((0, 3), (8, 8))]
    got = generate.covariance_check(rows, 17, pairs, 8).orderBy("pair").collect()
    assert [r.n for r in got] == [600] * 4
    assert all(abs(r.covariance - r.expected) <= 4 * r.scatter + 1e-12 for r in got)
    assert got[0].expected > got[1].expected > 0 and abs(got[3].expected) < 1e-12


def test_line_model_and_null_fields(spark):
    from gridmill.operators import errors

    rng = np.random.default_rng(2)
    h, m, n = 3, 4, 16
    layers = [(rng.normal(size=(m, h, h)) + 1j * rng.normal(size=(m, h, h)), rng.normal(size=(h, h)), rng.normal(size=h)) for _ in range(2)]
    model = errors.FourierModel((rng.normal(size=(2, h)), rng.normal(size=h)), layers, [(rng.normal(size=(h, 1)), rng.normal(size=1))], padding=2)
    x = rng.normal(size=(5, n))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, None)]
    got = {r.sample: r.pred for r in errors.scored(spark.createDataFrame(rows, "sample long, values array<double>"), "values", (n,), model).collect()}
    assert got[5] is None
    # the same model layer by layer, with sums in place of transforms
    k = np.arange(n + 2)
    a = np.stack([x, np.broadcast_to(np.arange(n) / (n - 1), x.shape)], -1) @ model.lift[0] + model.lift[1]
    a = np.pad(a, ((0, 0), (0, 2), (0, 0)))
    for i, (s, mix, b) in enumerate(layers):
        f = np.einsum("kxi,px->kpi", a, np.exp(-2j * np.pi * np.outer(np.arange(m), k) / (n + 2)))
        g = np.einsum("kpi,pio->kpo", f, s)
        back = np.exp(2j * np.pi * np.outer(k, np.arange(m)) / (n + 2)) * np.where(np.arange(m) == 0, 1, 2) / (n + 2)
        a = np.real(np.einsum("kpo,xp->kxo", np.concatenate([np.real(g[:, :1]), g[:, 1:]], 1), back)) + a @ mix + b
        a = np.maximum(a, 0) if i == 0 else a
    want = (a[:, :n] @ model.project[0][0] + model.project[0][1])[..., 0]
    assert np.allclose([got[i] for i in range(5)], want)


def test_moments_of_many_tasks(spark):
    from gridmill.operators import normalize

    a = np.random.default_rng(3).normal(size=(400, 5))
    df = spark.createDataFrame([(i % 3, x.tolist()) for i, x in enumerate(a)] + [(1, None)], "g int, values array<double>").repartition(40)
    whole = normalize.moments(df, "values").first()
    assert whole.n == 400 and np.allclose(whole["mean"], a.mean(0)) and np.allclose(whole["std"], a.std(0, ddof=1))
    for r in normalize.moments(df, "values", "g").collect():
        own = a[np.arange(400) % 3 == r.g]
        assert r.n == len(own) and np.allclose(r["mean"], own.mean(0)) and np.allclose(r["std"], own.std(0, ddof=1))
