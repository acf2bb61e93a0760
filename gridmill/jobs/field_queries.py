"""Registered queries over field tables, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridmill.functions import grids, shuffle
from gridmill.jobs import tables as t
from gridmill.operators import errors, fields, generate, losses, normalize, pod, sampling, transfer

#: Registered by `query`: name -> (function, SQL or None).
QUERIES: dict = {}
N, S = t.SIDE, 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _points(df, *keep):
    """Rounded long form, so that results compare as numbers."""
    return fields.long_form(df, "values", *keep).withColumn("value", F.round("value", 8))


@query(f"WITH {t.POINTS} SELECT sample, CAST(pos // 8 AS INTEGER) AS i, CAST(pos % 8 AS INTEGER) AS j, CAST(pos AS INTEGER) AS pos, round(x, 8) AS value FROM p")
def field_long_form(spark, d):
    return fields.long_form(t.fields(spark, d), "values", "sample", width=N).withColumn("value", F.round("value", 8))


@query(f"WITH {t.POINTS} SELECT sample, count(*) AS points, round(sum(x * (pos + 1)), 6) AS digest FROM p GROUP BY sample")
def field_array_form(spark, d):
    back = fields.array_form(fields.long_form(t.fields(spark, d), "values", "sample"), "sample")
    digest = F.aggregate(F.transform("values", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return back.select("sample", F.size("values").cast("long").alias("points"), F.round(digest, 6).alias("digest"))


@query(f"WITH {t.POINTS} SELECT sample, CAST(row_number() OVER (PARTITION BY sample ORDER BY pos) - 1 AS INTEGER) AS pos, round(x, 8) AS value FROM p WHERE pos // 8 % 3 = 0 AND pos % 8 % 3 = 0")
def subsample_plane(spark, d):
    return _points(t.fields(spark, d).withColumn("values", fields.strided("values", 3, N)), "sample")


@query(f"WITH {t.POINTS} SELECT sample, CAST(row_number() OVER (PARTITION BY sample ORDER BY pos) - 1 AS INTEGER) AS pos, round(x, 8) AS value FROM p WHERE pos % 5 = 0")
def subsample_line(spark, d):
    return _points(t.fields(spark, d).withColumn("values", fields.strided("values", 5)), "sample")


@query(f"WITH {t.FIELDS}, r AS (SELECT unnest([1, 2, 4, 7]) AS rate) SELECT rate, CAST(8192 // rate AS BIGINT) AS line_points, CAST(420 // rate + 1 AS BIGINT) AS plane_points, count(*) FILTER (len(v) <> (7 // rate + 1) * (7 // rate + 1)) AS other FROM r, f GROUP BY rate")
def resolution_rule(spark, d):
    rate = F.explode(F.array(*map(F.lit, (1, 2, 4, 7)))).alias("rate")
    rows = t.fields(spark, d).select(rate, F.size("values").alias("size"))
    rule = lambda f, *a: F.element_at(F.create_map(*(F.lit(x).cast("long") for r in (1, 2, 4, 7) for x in (r, f(r, *a)))), F.col("rate").cast("long"))
    side = rule(fields.plane_points, N)
    return rows.groupBy("rate").agg(
        F.first(rule(fields.line_points)).alias("line_points"), F.first(rule(fields.plane_points)).alias("plane_points"),
        F.count_if(F.col("size") != side * side).alias("other"),
    )


@query("WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT vec_id AS sample, CASE WHEN vec_id < 100 THEN 'train' ELSE 'test' END AS split FROM embeddings, n WHERE vec_id < 100 OR vec_id >= n - 50")
def split_first_last(spark, d):
    return fields.first_and_last(t.fields(spark, d), 100, 50).select("sample", "split")


@query("WITH s AS (SELECT vec_id // 2 AS sample, CASE WHEN vec_id % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM embeddings) SELECT sample, split FROM s WHERE split = 'train' AND sample < 90 OR split = 'test' AND sample < 40")
def split_prefixes(spark, d):
    rows = t.fields(spark, d).select(F.floor(F.col("sample") / 2).alias("sample"), F.when(F.col("sample") % 2 == 0, "train").otherwise("test").alias("split"))
    return fields.prefixes(rows, {"train": 90, "test": 40})


@query(f"WITH {t.FIELDS} SELECT sample, round(v[1], 8) AS first, round(v[64], 8) AS last FROM f WHERE label = 3 AND sample < 400")
def raw_field(spark, d):
    rows = t.fields(spark, d).select("sample", "values", F.lit(N).alias("n"), F.col("label").alias("k"), F.lit("train").alias("split"))
    got = fields.raw_field(rows, "values", N, 3, "train", 400)
    return got.select("sample", F.round(F.element_at("values", 1), 8).alias("first"), F.round(F.element_at("values", -1), 8).alias("last"))


@query(f"WITH {t.FIELDS} SELECT count(*) AS samples, count(*) FILTER (len(v) <> 64) AS bad FROM f")
def shape_check(spark, d):
    rows = fields.check_shape(t.fields(spark, d), "values", N, 1)
    return rows.agg(F.count("*").alias("samples"), F.count_if(F.size("values") != N * N).alias("bad"))


@query(f"WITH {t.FIELDS}, c AS (SELECT j, sin(pi() * (2 * j - 63) / 126) AS x FROM (SELECT unnest(range(64)) AS j)), p AS (SELECT sample, unnest(range(64)) AS j, unnest(v) AS v FROM f) SELECT sample, round(max(abs(v - x)), 8) AS gap FROM p JOIN c USING (j) GROUP BY sample")
def node_check(spark, d):
    return fields.node_gap(t.fields(spark, d), "values", N * N, "sample").select("sample", F.round("gap", 8).alias("gap"))


@query(f"WITH {t.FIELDS} SELECT sample, 3 AS rank, CAST(CAST(v[5] AS FLOAT) AS DOUBLE) AS fifth FROM f")
def channel_and_cast(spark, d):
    rows = fields.with_channel(t.fields(spark, d).withColumn("shape", F.array(F.lit(N), F.lit(N))), "values")
    return rows.select("sample", F.size("shape").alias("rank"), F.element_at("values", 5).cast("double").alias("fifth"))


@query(f"WITH {t.POINTS} SELECT sample, CAST(pos AS INTEGER) AS pos, round(x, 8) AS v, round(pos % 8 / 7, 8) AS x2, round(pos // 8 / 7, 8) AS x1 FROM p")
def coordinate_channels(spark, d):
    rows = t.fields(spark, d).select("sample", F.posexplode(fields.with_coordinates("values", N, N)).alias("pos", "c"))
    return rows.select("sample", "pos", *(F.round(F.element_at("c", i + 1), 8).alias(n) for i, n in enumerate(("v", "x2", "x1"))))


@query("SELECT vec_id AS sample, CASE WHEN vec_id % 10 <> 0 THEN true END AS has_input, CASE WHEN vec_id % 15 <> 0 THEN true END AS has_target FROM embeddings WHERE (vec_id % 10 = 0) <> (vec_id % 15 = 0)")
def pair_check(spark, d):
    rows = t.fields(spark, d)
    return fields.one_sided(rows.where("sample % 10 <> 0"), rows.where("sample % 15 <> 0"))


@query(f"WITH {t.FIELDS}, g AS (SELECT a.sample, a.v AS coarse, b.v AS fine FROM f a JOIN f b ON b.sample = a.sample // 2 * 2) SELECT sample, round(greatest(abs(coarse[1] - fine[1]), abs(coarse[8] - fine[8]), abs(coarse[57] - fine[57]), abs(coarse[64] - fine[64])), 8) AS gap FROM g")
def common_nodes(spark, d):
    """Corners of every field against those of the even sample before it, on the grid of both ends."""
    rows = t.fields(spark, d).select("sample", "values")
    even = (F.floor(F.col("sample") / 2) * 2).alias("even")
    fine = rows.select("sample", even).join(rows.withColumnRenamed("sample", "even"), "even").select("sample", "values")
    return fields.common_nodes(rows.withColumn("values", fields.strided("values", 7, N)), fine, 2, 7).withColumn("gap", F.round("gap", 8))


@query(f"WITH {t.POINTS} SELECT CAST(pos AS INTEGER) AS pos, count(*) AS n, round(avg(x), 8) AS mean, round(stddev_samp(x), 8) AS std FROM p GROUP BY pos")
def normalizer_fit(spark, d):
    return normalize.fit_points(t.fields(spark, d), "values").select("pos", "n", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


@query(f"WITH {t.POINTS} SELECT label, CAST(pos AS INTEGER) AS pos, count(*) AS n, round(avg(x), 8) AS mean, round(stddev_samp(x), 8) AS std FROM p GROUP BY label, pos")
def normalizer_moments(spark, d):
    got = normalize.moments(t.fields(spark, d), "values", "label")
    rows = got.select("label", "n", F.posexplode(F.arrays_zip("mean", "std")).alias("pos", "z"))
    return rows.select("label", "pos", "n", F.round("z.mean", 8).alias("mean"), F.round("z.std", 8).alias("std"))


_STATS = f"{t.POINTS}, z AS (SELECT pos, avg(x) AS mean, stddev_samp(x) AS std FROM p WHERE sample % 5 <> 0 GROUP BY pos)"


def _split(spark, d):
    return t.fields(spark, d).select("sample", F.when(F.col("sample") % 5 != 0, "train").otherwise("test").alias("split"), F.col("values").alias("x"), F.col("values").alias("y"))


@query(f"WITH {_STATS} SELECT sample, CASE WHEN sample % 5 <> 0 THEN 'train' ELSE 'test' END AS split, CAST(pos AS INTEGER) AS pos, round((x - mean) / (std + 1e-5), 7) AS value FROM p JOIN z USING (pos)")
def normalizer_encode(spark, d):
    encoded, _ = normalize.split_pair(_split(spark, d))
    return encoded.select("sample", "split", F.posexplode("x").alias("pos", "value")).withColumn("value", F.round("value", 7))


@query(f"WITH {_STATS} SELECT sample, CAST(pos AS INTEGER) AS pos, round(x * (std + 1e-5) + mean, 8) AS value FROM p JOIN z USING (pos)")
def normalizer_decode(spark, d):
    _, target = normalize.split_pair(_split(spark, d))
    rows = _split(spark, d).crossJoin(F.broadcast(target.select("mean", "std")))
    return rows.select("sample", F.posexplode(normalize.decode("y", "mean", "std")).alias("pos", "value")).withColumn("value", F.round("value", 8))


@query(f"WITH {_STATS} SELECT sample, CAST(pos AS INTEGER) AS pos, round((x - mean) / (std + 1e-5), 7) AS value FROM p JOIN z USING (pos) WHERE sample % 5 = 0")
def normalizer_saved(spark, d):
    rows = _split(spark, d)
    saved = normalize.record(normalize.moments(rows.where("split = 'train'"), "x"), [N, N])
    got = normalize.encode_saved(rows.where("split = 'test'"), saved, [N, N])
    return got.select("sample", F.posexplode("x").alias("pos", "value")).withColumn("value", F.round("value", 7))


@query(f"WITH {t.POINTS}, {t.GRID} SELECT label, CAST(a.j AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, round(a.x, 9) AS x, round(b.x, 9) AS y, round(-1 + 2.0 * a.j / 7, 9) AS uniform_x, round(avg(p.x), 8) AS mean FROM p JOIN c a ON a.j = pos // 8 JOIN c b ON b.j = pos % 8 GROUP BY label, a.j, b.j, a.x, b.x")
def node_tables(spark, d):
    """Mean field of each group at its nodes' coordinates."""
    rows = fields.long_form(t.fields(spark, d), "values", "label", width=N).groupBy("label", "i", "j").agg(F.round(F.avg("value"), 8).alias("mean"))
    x = fields.nodes_table(spark, N).join(fields.uniform_table(spark, N).withColumnRenamed("x", "u"), "j").select(F.col("j").alias("i"), F.round("x", 9).alias("x"), F.round("u", 9).alias("uniform_x"))
    y = fields.nodes_table(spark, N).select("j", F.round("x", 9).alias("y"))
    return rows.join(F.broadcast(x), "i").join(F.broadcast(y), "j").select("label", "i", "j", "x", "y", "uniform_x", "mean")


@query(f"WITH {t.POINTS}, {t.GRID} SELECT sample, round(sum(a.w * b.w * x * x), 8) AS norm_sq FROM p JOIN w a ON a.j = pos // 8 JOIN w b ON b.j = pos % 8 GROUP BY sample")
def quadrature_norm(spark, d):
    return t.fields(spark, d).select("sample", F.round(losses.cc_norm_sq("values", N), 8).alias("norm_sq"))


@query(f"WITH {t.POINTS}, {t.GRID} SELECT sample, round(sum(w.w * x), 8) AS integral FROM p JOIN w ON w.j = pos // 8 WHERE pos % 8 = 0 GROUP BY sample")
def quadrature_edge(spark, d):
    rows = fields.long_form(t.fields(spark, d), "values", "sample", width=N).where("j = 0")
    return rows.join(F.broadcast(fields.weights_table(spark, N).withColumnRenamed("j", "i")), "i").groupBy("sample").agg(F.round(F.sum(F.col("w") * F.col("value")), 8).alias("integral"))


_DOWN = f"{t.POINTS}, {t.GRID}, d1 AS (SELECT sample, m.i, pos % 8 AS j, sum(m.c * x) AS x FROM p JOIN down m ON m.k = pos // 8 GROUP BY ALL), d2 AS (SELECT sample, d1.i, m.i AS j, sum(m.c * x) AS x FROM d1 JOIN down m ON m.k = d1.j GROUP BY ALL)"
_BACK = f"{_DOWN}, b1 AS (SELECT sample, m.i, d2.j, sum(m.c * x) AS x FROM d2 JOIN up m ON m.k = d2.i GROUP BY ALL), b2 AS (SELECT sample, b1.i, m.i AS j, sum(m.c * x) AS x FROM b1 JOIN up m ON m.k = b1.j GROUP BY ALL)"


@query(f"WITH {_DOWN} SELECT sample, CAST(i * 6 + j AS INTEGER) AS pos, round(x, 8) AS value FROM d2")
def to_uniform(spark, d):
    return _points(t.fields(spark, d).withColumn("values", transfer.to_uniform("values", N, S)), "sample")


@query(f"WITH {_DOWN} SELECT sample, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(x, 8) AS value FROM d2")
def to_uniform_by_join(spark, d):
    points = fields.long_form(t.fields(spark, d), "values", "sample", width=N)
    got = transfer.by_join(points, transfer.matrix_table(spark, grids.to_uniform(N, S)))
    return got.withColumn("value", F.round("value", 8))


@query(f"WITH {_BACK} SELECT sample, CAST(i * 8 + j AS INTEGER) AS pos, round(x, 8) AS value FROM b2")
def to_chebyshev(spark, d):
    rows = t.fields(spark, d).withColumn("values", transfer.to_uniform("values", N, S))
    return _points(rows.withColumn("values", transfer.to_chebyshev("values", S, N)), "sample")


_ERROR2 = f"{_BACK}, q AS (SELECT p.sample, label, sqrt(sum(a.w * c.w * (b2.x - p.x) * (b2.x - p.x)) / sum(a.w * c.w * p.x * p.x)) AS e FROM p JOIN b2 ON b2.sample = p.sample AND b2.i * 8 + b2.j = pos JOIN w a ON a.j = pos // 8 JOIN w c ON c.j = pos % 8 GROUP BY p.sample, label)"


@query(f"WITH {_ERROR2} SELECT label, 'plain' AS restriction, 6 AS s, 2 AS degree, round(avg(e), 8) AS mean, round(max(e), 8) AS worst FROM q GROUP BY label")
def transfer_floor(spark, d):
    got = transfer.floor_sweep(t.fields(spark, d), "values", N, [("plain", S, grids.DEGREE)], "label")
    return got.withColumn("mean", F.round("mean", 8)).withColumn("worst", F.round("worst", 8))


def _matrix_sql(m: np.ndarray) -> str:
    return "(VALUES " + ", ".join(f"({i}, {k}, {float(m[i, k])!r}::DOUBLE)" for i in range(m.shape[0]) for k in range(m.shape[1])) + ") AS m(i, k, c)"


def _sweep_sql(cases) -> str:
    """Round trips of every case through its matrix, both axes one after the other."""
    trips = [grids.to_chebyshev(s, N, d) @ grids.restriction(r, N, s) for r, s, d in cases]
    named = ", ".join(f"({k}, '{r}', {s}, {d})" for k, (r, s, d) in enumerate(cases))
    entries = ", ".join(f"({k}, {i}, {j}, {float(m[i, j])!r}::DOUBLE)" for k, m in enumerate(trips) for i in range(N) for j in range(N))
    return f"""{t.POINTS}, {t.GRID}, cases(k, restriction, s, degree) AS (VALUES {named}), m(k, i, j, c) AS (VALUES {entries}),
t1 AS (SELECT m.k, sample, m.i, pos % 8 AS col, sum(c * x) AS x FROM p JOIN m ON m.j = pos // 8 GROUP BY ALL),
t2 AS (SELECT t1.k, sample, t1.i, m.i AS j, sum(c * x) AS y FROM t1 JOIN m ON m.k = t1.k AND m.j = t1.col GROUP BY ALL),
e AS (SELECT k, p.sample, sqrt(sum(a.w * b.w * (y - x) * (y - x)) / sum(a.w * b.w * x * x)) AS e FROM t2 JOIN p ON p.sample = t2.sample AND p.pos = t2.i * 8 + t2.j JOIN w a ON a.j = t2.i JOIN w b ON b.j = t2.j GROUP BY ALL),
sweep AS (SELECT restriction, CAST(s AS INTEGER) AS s, CAST(degree AS INTEGER) AS degree, avg(e) AS mean, max(e) AS worst FROM e JOIN cases USING (k) GROUP BY ALL)"""


_SWEEP = [(r, s, g) for r in grids.RESTRICTIONS for s in (4, 5, 6, 7) for g in (1, 2, 3)]
_CHOICE = [(r, s, 2) for r in grids.RESTRICTIONS for s in (5, 6, 7)]
_ORDER = ", ".join(f"('{r}', {i})" for i, r in enumerate(grids.RESTRICTIONS))


@query(f"WITH {_sweep_sql(_SWEEP)} SELECT restriction, s, degree, round(mean, 7) AS mean, round(worst, 7) AS worst FROM sweep")
def transfer_sweep(spark, d):
    got = transfer.floor_sweep(t.fields(spark, d), "values", N, _SWEEP)
    return got.withColumn("mean", F.round("mean", 7)).withColumn("worst", F.round("worst", 7))


@query(f"WITH {_sweep_sql(_CHOICE)}, o(restriction, nth) AS (VALUES {_ORDER}), near AS (SELECT *, mean <= 1.1 * min(mean) OVER (PARTITION BY degree, s) AS near FROM sweep) SELECT degree, s, arg_min(restriction, nth) AS restriction FROM near JOIN o USING (restriction) WHERE near GROUP BY degree, s")
def restriction_choice(spark, d):
    return transfer.best_restriction(transfer.floor_sweep(t.fields(spark, d), "values", N, _CHOICE))


_FILTER = transfer.filter_matrix(N, "smooth s-2", S)


@query(f"""WITH {t.POINTS}, {t.GRID}, fm AS (SELECT * FROM {_matrix_sql(_FILTER)}),
t1 AS (SELECT sample, label, fm.i, pos % 8 AS col, sum(c * x) AS x FROM p JOIN fm ON fm.k = pos // 8 GROUP BY ALL), t2 AS (SELECT sample, label, t1.i, fm.i AS j, sum(c * x) AS y FROM t1 JOIN fm ON fm.k = t1.col GROUP BY ALL),
e AS (SELECT p.sample, p.label, sum(a.w * b.w * (y - x) * (y - x)) / sum(a.w * b.w * x * x) AS e FROM t2 JOIN p ON p.sample = t2.sample AND p.pos = t2.i * 8 + t2.j JOIN w a ON a.j = t2.i JOIN w b ON b.j = t2.j GROUP BY ALL)
SELECT label, round(avg(e), 8) AS mean, round(max(e), 8) AS worst FROM e GROUP BY label""")
def filtered_energy(spark, d):
    share = transfer.filtered_energy("values", N, "smooth s-2", S)
    return t.fields(spark, d).select("label", share.alias("e")).groupBy("label").agg(F.round(F.avg("e"), 8).alias("mean"), F.round(F.max("e"), 8).alias("worst"))


@query(f"WITH {t.POINTS}, d AS (SELECT * FROM {_matrix_sql(grids.derivative(N))}) SELECT sample, CAST(d.i * 8 + pos % 8 AS INTEGER) AS pos, round(sum(c * x), 7) AS value FROM p JOIN d ON d.k = pos // 8 GROUP BY ALL")
def derivative_rows(spark, d):
    return fields.long_form(t.fields(spark, d).withColumn("values", transfer.derivative("values", N, 0)), "values", "sample").withColumn("value", F.round("value", 7))


_REL = "sqrt(sum((y - x) * (y - x))) / sqrt(sum(x * x))"


@query(f"WITH {t.PREDICTED} SELECT sample, round(sum(abs(y - x)) / sum(abs(x)), 8) AS l1, round({_REL}, 8) AS l2, round(cbrt(sum(power(abs(y - x), 3))) / cbrt(sum(power(abs(x), 3))), 8) AS l3 FROM e GROUP BY sample")
def relative_loss(spark, d):
    return t.predictions(spark, d).select("sample", *(F.round(losses.relative("pred", "values", p), 8).alias(f"l{p}") for p in (1, 2, 3)))


@query(f"WITH {t.PREDICTED} SELECT sample, round(sqrt(sum((y - x) * (y - x))) / 7, 8) AS l2 FROM e GROUP BY sample")
def absolute_loss(spark, d):
    return t.predictions(spark, d).select("sample", F.round(losses.absolute("pred", "values", [N, N]), 8).alias("l2"))


@query(f"WITH {t.PREDICTED}, q AS (SELECT sample, label, {_REL} AS l2 FROM e GROUP BY sample, label) SELECT label, round(avg(l2), 8) AS mean, round(sum(l2), 7) AS total FROM q GROUP BY label")
def loss_reductions(spark, d):
    rows = t.predictions(spark, d).select("label", losses.relative("pred", "values").alias("l2"))
    mean, total = losses.reduced(rows, "l2", "mean", "label"), losses.reduced(rows, "l2", "sum", "label")
    return mean.withColumnRenamed("l2", "mean").join(total.withColumnRenamed("l2", "total"), "label").select("label", F.round("mean", 8).alias("mean"), F.round("total", 7).alias("total"))


@query(f"WITH {t.PREDICTED}, {t.GRID} SELECT sample, round(sqrt(sum(a.w * b.w * (y - x) * (y - x)) / sum(a.w * b.w * x * x)), 8) AS e FROM e JOIN w a ON a.j = pos // 8 JOIN w b ON b.j = pos % 8 GROUP BY sample")
def weighted_error(spark, d):
    return t.predictions(spark, d).select("sample", F.round(losses.cc_relative("pred", "values", N), 8).alias("e"))


@query(f"""WITH {t.PREDICTED}, q AS (SELECT sample, avg((y - x) * (y - x)) AS mse, {_REL} AS l2 FROM e GROUP BY sample),
b AS (SELECT *, sample // 128 AS epoch, sample % 128 // 20 AS batch FROM q), g AS (SELECT epoch, batch, avg(mse) AS mse, sum(l2) AS l2, count(*) AS n FROM b GROUP BY ALL)
SELECT epoch, round(avg(mse), 9) AS mse, round(sum(l2) / sum(n), 8) AS l2 FROM g GROUP BY epoch""")
def epoch_means(spark, d):
    sq = F.aggregate(F.zip_with("pred", "values", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x) / F.size("values")
    rows = t.predictions(spark, d).select(F.floor(F.col("sample") / 128).alias("epoch"), F.floor(F.col("sample") % 128 / 20).alias("batch"), sq.alias("mse"), losses.relative("pred", "values").alias("l2"))
    return losses.epoch_means(rows).select("epoch", F.round("mse", 9).alias("mse"), F.round("l2", 8).alias("l2"))


@query(f"WITH {t.PREDICTED}, z AS (SELECT sample, sum((y - x) * (y - x)) / sum(x * x) AS r FROM e GROUP BY sample) SELECT sample // 32 AS batch, round(sum(r) / count(*) / 2, 9) AS loss FROM z GROUP BY batch")
def residual_loss(spark, d):
    rows = t.predictions(spark, d).withColumn("batch", F.floor(F.col("sample") / 32))
    sizes = rows.groupBy("batch").agg(F.count("*").alias("size"))
    r = losses.residual("pred", "values", F.col("size"))
    both = rows.join(sizes, "batch").select("batch", F.aggregate(r, F.lit(0.0), lambda a, x: a + x * x).alias("half"))
    return both.groupBy("batch").agg(F.round(F.sum("half") / 2, 9).alias("loss"))


def _scored(spark, d):
    """Errors of a coarse prediction: the restricted field, put off by a known rule."""
    rows = t.fields(spark, d).withColumn("pred", transfer.to_uniform("values", N, S))
    off = F.transform("pred", lambda x, i: x + (i % 5 - 2) * 0.01 * (1 + F.col("sample") % 7))
    return rows.withColumn("pred", off).select("sample", "label", errors.sample_errors("pred", "values", S, N).alias("e")).select("sample", "label", "e.*")


_SCORED = _DOWN + """, y AS (SELECT sample, i, j, x, x + ((i * 6 + j) % 5 - 2) * 0.01 * (1 + sample % 7) AS y FROM d2),
y1 AS (SELECT sample, m.i, y.j, sum(m.c * y) AS y FROM y JOIN up m ON m.k = y.i GROUP BY ALL), y2 AS (SELECT sample, y1.i, m.i AS j, sum(m.c * y) AS y FROM y1 JOIN up m ON m.k = y1.j GROUP BY ALL),
e3 AS (SELECT sample, sqrt(sum((y - x) * (y - x))) / sqrt(sum(x * x)) AS model FROM y GROUP BY sample),
h AS (SELECT p.sample, label, y2.i, y2.j, x, y, a.w AS wi, b.w AS wj FROM p JOIN y2 ON y2.sample = p.sample AND y2.i * 8 + y2.j = pos JOIN w a ON a.j = y2.i JOIN w b ON b.j = y2.j),
e4 AS (SELECT sample, label, sqrt(sum(wi * wj * (y - x) * (y - x)) / sum(wi * wj * x * x)) AS total, sqrt(sum(wi * wj * x * x)) AS u_norm,
  max(CASE WHEN i IN (0, 7) OR j IN (0, 7) THEN abs(y) ELSE 0 END) / max(abs(x)) AS ratio,
  sqrt(sum(CASE WHEN i IN (0, 7) THEN wj * y * y ELSE 0 END + CASE WHEN j IN (0, 7) THEN wi * y * y ELSE 0 END) / 8) / sqrt(sum(wi * wj * x * x) / 4) AS rms FROM h GROUP BY sample, label),
er AS (SELECT e4.*, model FROM e4 JOIN e3 USING (sample))"""


@query(f"WITH {_SCORED} SELECT sample, label, round(model, 8) AS model, round(total, 8) AS total, round(u_norm, 8) AS u_norm, round(ratio, 8) AS boundary_ratio, round(rms, 8) AS boundary_rms FROM er")
def sample_errors(spark, d):
    names = ("model", "total", "u_norm", "boundary_ratio", "boundary_rms")
    return _scored(spark, d).select("sample", "label", *(F.round(n, 8).alias(n) for n in names))


@query(f"WITH {_SCORED} SELECT label, round(avg(total), 8) AS mean, round(max(total), 8) AS worst, arg_max(sample, row(total, -sample)) AS worst_sample, count(*) AS n_test, round(corr(ln(total), ln(u_norm)), 6) AS log_correlation, avg(rms) / avg(total) >= 0.1 AS boundary_matters FROM er GROUP BY label")
def evaluation(spark, d):
    got = errors.evaluation(_scored(spark, d), "label", arrays=False)
    return got.select("label", F.round("total.mean", 8).alias("mean"), F.round("total.worst", 8).alias("worst"), "worst_sample", "n_test", F.round("log_correlation", 6).alias("log_correlation"), "boundary_matters")


@query(f"WITH {_SCORED} SELECT label, round(avg(model), 8) AS model_mean, round(max(model), 8) AS model_worst, round(avg(total), 8) AS total_mean, round(max(total), 8) AS total_worst FROM er GROUP BY label")
def errors_by_group(spark, d):
    got = errors.by_group(_scored(spark, d), "label").drop("transfer_mean", "transfer_worst")
    return got.select("label", *(F.round(c, 8).alias(c) for c in got.columns if c != "label"))


@query(f"""WITH {t.POINTS}, s AS (SELECT unnest([1, 2, 3, 7]) AS step),
g AS (SELECT 7 // step + 1 AS n, sample, sample % 5 <> 0 AS train, pos, x, x * x + 0.25 * x AS y FROM p, s WHERE pos // 8 % step = 0 AND pos % 8 % step = 0),
z AS (SELECT n, pos, avg(x) AS xm, stddev_samp(x) AS xs, avg(y) AS ym, stddev_samp(y) AS ys FROM g WHERE train GROUP BY n, pos),
q AS (SELECT n, sample, y, (0.9 * (x - xm) / (xs + 1e-5) + 0.05) * (ys + 1e-5) + ym AS pred FROM g JOIN z USING (n, pos) WHERE NOT train),
e AS (SELECT n, sample, sqrt(sum((pred - y) * (pred - y))) / sqrt(sum(y * y)) AS e FROM q GROUP BY n, sample),
m AS (SELECT n, count(*) AS n_test, avg(e) AS mean, max(e) AS worst FROM e GROUP BY n)
SELECT CAST(n AS INTEGER) AS n, n_test, round(mean, 7) AS mean, round(worst, 7) AS worst, round(mean / (SELECT mean FROM m WHERE n = 8), 7) AS ratio, CASE WHEN n = 8 THEN true END AS agrees FROM m""")
def resolution_study(spark, d):
    """One map between encoded fields, scored on four grids whose statistics are fitted anew."""
    rows = t.fields(spark, d).select("sample", F.when(F.col("sample") % 5 != 0, "train").otherwise("test").alias("split"), F.col("values").alias("x"))
    rows = rows.withColumn("y", F.transform("x", lambda x: x * x + 0.25 * x))
    grids_ = F.explode(F.array(*(F.struct(F.lit(fields.plane_points(s, N)).alias("n"), fields.strided("x", s, N).alias("x"), fields.strided("y", s, N).alias("y")) for s in (1, 2, 3, 7))))
    study = rows.select("sample", "split", grids_.alias("g")).select("sample", "split", "g.*")
    model = lambda x: F.transform(x, lambda v: 0.9 * v + 0.05)
    # the run's last loss is that of the same data as it was trained on
    last = errors.resolution_study(study.where(F.col("n") == N), model, N).select(F.col("mean").alias("test_l2"))
    got = errors.resolution_study(study, model, N, last)
    return got.select("n", "n_test", *(F.round(c, 7).alias(c) for c in ("mean", "worst", "ratio")), "agrees")


_SIDES = (8, 6, 4)


def _sided_sql(name: str, m) -> str:
    """A matrix for each number of nodes as a table (n, i, k, c)."""
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, {i}, {k}, {float(c)!r}::DOUBLE)" for n in _SIDES for i, row in enumerate(m(n)) for k, c in enumerate(row)) + ") AS m(n, i, k, c))"


@query(f"""WITH {t.POINTS}, {_sided_sql("down_", lambda n: grids.to_uniform(n, n - 1))}, {_sided_sql("up_", lambda n: grids.to_chebyshev(n - 1, n))}, {_sided_sql("weight", lambda n: [grids.clenshaw_curtis(n)])},
g AS (SELECT n, sample, sample % 5 <> 0 AS train, pos // 8 AS i, pos % 8 AS j, x, x * x + 0.25 * x AS u FROM p, (SELECT unnest([8, 6, 4]) AS n) WHERE pos // 8 < n AND pos % 8 < n),
r AS MATERIALIZED (SELECT g.n, sample, train, a.i AS i, b.i AS j, sum(a.c * b.c * x) AS x, sum(a.c * b.c * u) AS y FROM g JOIN down_ a ON a.n = g.n AND a.k = g.i JOIN down_ b ON b.n = g.n AND b.k = g.j GROUP BY ALL),
z AS (SELECT n, i, j, avg(x) AS xm, stddev_samp(x) AS xs, avg(y) AS ym, stddev_samp(y) AS ys FROM r WHERE train GROUP BY ALL),
q AS MATERIALIZED (SELECT n, sample, i, j, y, (0.9 * (x - xm) / (xs + 1e-5) + 0.05) * (ys + 1e-5) + ym AS pred FROM r JOIN z USING (n, i, j) WHERE NOT train),
e3 AS (SELECT n, sample, sqrt(sum((pred - y) * (pred - y))) / sqrt(sum(y * y)) AS model FROM q GROUP BY ALL),
h AS (SELECT q.n, sample, a.i AS i, b.i AS j, sum(a.c * b.c * pred) AS uh, sum(a.c * b.c * y) AS back FROM q JOIN up_ a ON a.n = q.n AND a.k = q.i JOIN up_ b ON b.n = q.n AND b.k = q.j GROUP BY ALL),
e24 AS (SELECT g.n, sample, sqrt(sum(a.c * b.c * (back - u) * (back - u))) / sqrt(sum(a.c * b.c * u * u)) AS transfer, sqrt(sum(a.c * b.c * (uh - u) * (uh - u))) / sqrt(sum(a.c * b.c * u * u)) AS total
  FROM h JOIN g USING (n, sample, i, j) JOIN weight a ON a.n = g.n AND a.k = g.i JOIN weight b ON b.n = g.n AND b.k = g.j GROUP BY ALL),
m AS (SELECT n, count(*) AS n_test, avg(transfer) AS e2, max(transfer) AS w2, avg(model) AS e3, max(model) AS w3, avg(total) AS e4, max(total) AS w4 FROM e3 JOIN e24 USING (n, sample) GROUP BY n)
SELECT CAST(n AS INTEGER) AS n, CAST(n - 1 AS INTEGER) AS s, n_test, round(e2, 7) AS transfer_mean, round(w2, 7) AS transfer_worst, round(e3, 7) AS model_mean, round(w3, 7) AS model_worst, round(e4, 7) AS total_mean, round(w4, 7) AS total_worst,
  round(e3 / (SELECT e3 FROM m WHERE n = 8), 7) AS ratio FROM m""")
def resolution_errors(spark, d):
    """Transfer, model and total error of one map on three grids of Chebyshev nodes."""
    rows = t.fields(spark, d).select("sample", F.when(F.col("sample") % 5 != 0, "train").otherwise("test").alias("split"), F.col("values").alias("f"))
    part = lambda n: F.filter("f", lambda x, i: (F.floor(i / N) < n) & (i % N < n))
    rows = rows.select("sample", "split", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), part(n).alias("f")) for n in _SIDES))).alias("g")).select("sample", "split", "g.*")
    rows = rows.withColumn("u", F.transform("f", lambda x: x * x + 0.25 * x))
    got = errors.resolution_errors(rows, lambda x: F.transform(x, lambda v: 0.9 * v + 0.05), N)
    return got.select("n", "s", "n_test", *(F.round(c, 7).alias(c) for c in got.columns if c.endswith(("_mean", "_worst"))), F.round("ratio", 7).alias("ratio"))


@query(f"WITH {t.PREDICTED}, r AS (SELECT unnest([1, 2, 4]) AS rate), q AS (SELECT rate, sample, {_REL} AS l2 FROM e, r WHERE pos // 8 % rate = 0 AND pos % 8 % rate = 0 GROUP BY ALL), m AS (SELECT rate, avg(l2) AS l2 FROM q GROUP BY rate) SELECT rate, round(l2, 8) AS l2, round(l2 / (SELECT l2 FROM m WHERE rate = 1), 8) AS ratio FROM m")
def resolution_ratio(spark, d):
    rows, parts = t.predictions(spark, d), None
    for rate in (1, 2, 4):
        loss = losses.relative(fields.strided("pred", rate, N), fields.strided("values", rate, N))
        part = rows.select(F.lit(rate).alias("rate"), loss.alias("l2"))
        parts = part if parts is None else parts.unionByName(part)
    got = errors.to_trained(parts.groupBy("rate").agg(F.avg("l2").alias("l2")), "rate", "l2", 1)
    return got.select("rate", F.round("l2", 8).alias("l2"), F.round("ratio", 8).alias("ratio"))


@query()
def batch_scoring(spark, d):
    rng = np.random.default_rng(3)
    h, m = 4, 2
    layers = [((rng.normal(size=(2, m, m, h, h)) + 1j * rng.normal(size=(2, m, m, h, h))) / 8, rng.normal(size=(h, h)) / 2, rng.normal(size=h) / 4) for _ in range(2)]
    model = errors.FourierModel((rng.normal(size=(3, h)), rng.normal(size=h)), layers, [(rng.normal(size=(h, h)), rng.normal(size=h)), (rng.normal(size=(h, 1)), rng.normal(size=1))], padding=2)
    rows = errors.scored(t.fields(spark, d), "values", (N, N), model)
    return rows.select("sample", F.round(losses.relative("pred", "values"), 6).alias("l2"))


def _pod(spark, d):
    return pod.fit(t.fields(spark, d), "values", pod.grid_weights(N, "chebyshev"))


@query(f"WITH {t.POINTS}, {t.GRID}, z AS (SELECT pos, avg(x) AS mean FROM p GROUP BY pos) SELECT count(DISTINCT sample) AS samples, round(sum(a.w * b.w * (x - mean) * (x - mean)), 6) AS energy FROM p JOIN z USING (pos) JOIN w a ON a.j = pos // 8 JOIN w b ON b.j = pos % 8")
def pod_energy(spark, d):
    rows, fitted = t.fields(spark, d), _pod(spark, d)
    pod.check(fitted, rows, "values")
    return pod.spectrum(spark, fitted).agg(F.lit(fitted.samples).cast("long").alias("samples"), F.round(F.sum(F.col("sigma") * F.col("sigma")), 6).alias("energy"))


@query()
def pod_energy_ranks(spark, d):
    return pod.energy_ranks(pod.spectrum(spark, _pod(spark, d), field="f"), [0.9, 0.99, 0.999], "field")


@query()
def pod_reconstruction(spark, d):
    got = pod.by_rank(t.fields(spark, d), "values", _pod(spark, d), N, [1, 4, 16, 64])
    return got.select("rank", F.round("mean", 7).alias("mean"), F.round("worst", 7).alias("worst"))


# covariances of the weighted fields on the Chebyshev grid and on two learning grids; traces of their
# powers are sums of powers of the eigenvalues
_GRIDS = (6, 4)
_COVARIANCES = ", ".join([
    f"{t.POINTS}, {t.GRID}, r0 AS (SELECT 'cgl' AS grid, sample, pos, x * sqrt(a.w * b.w) AS x FROM p JOIN w a ON a.j = pos // 8 JOIN w b ON b.j = pos % 8)",
    *(f"g{s} AS (SELECT * FROM {_matrix_sql(grids.to_uniform(N, s))}), r{s} AS (SELECT 's={s}' AS grid, sample, a.i * {s} + b.i AS pos, sum(a.c * b.c * x) * {2 / (s - 1)!r} AS x FROM p JOIN g{s} a ON a.k = pos // 8 JOIN g{s} b ON b.k = pos % 8 GROUP BY ALL)" for s in _GRIDS),
    "r AS (" + " UNION ALL ".join(f"SELECT * FROM r{s}" for s in (0, *_GRIDS)) + ")",
    "z AS MATERIALIZED (SELECT grid, sample, pos, x - avg(x) OVER (PARTITION BY grid, pos) AS x FROM r)",
    "cov AS MATERIALIZED (SELECT a.grid, a.pos AS i, b.pos AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM z a JOIN z b ON a.grid = b.grid AND a.sample = b.sample GROUP BY ALL)",
    "mom AS (SELECT grid, sum(CASE WHEN i = j THEN c END) AS trace, sum(c * c) AS squares FROM cov GROUP BY grid)",
    "q AS (SELECT a.grid, sum(a.c * b.c * d.c) AS cubes FROM cov a JOIN cov b ON b.grid = a.grid AND b.i = a.j JOIN cov d ON d.grid = a.grid AND d.i = b.j AND d.j = a.i GROUP BY a.grid)",
])


@query(f"WITH {_COVARIANCES} SELECT grid, round(trace, 7) AS trace, round(squares, 7) AS squares, round(cubes, 7) AS cubes, round(trace / (SELECT trace FROM mom WHERE grid = 'cgl'), 8) AS ratio FROM mom JOIN q USING (grid)")
def pod_by_grid(spark, d):
    """Spectra of fits on the Chebyshev grid and on learning grids: their power sums and trace ratios."""
    rows = t.fields(spark, d)
    fits = pod.grid_fits(rows, "values", N, list(_GRIDS))
    for fitted in fits.values():
        pod.check(fitted)
    spectra = pod.grid_spectra(spark, fits)
    powers = spectra.groupBy("grid").agg(F.sum(F.pow("eigenvalue", F.lit(2))).alias("squares"), F.sum(F.pow("eigenvalue", F.lit(3))).alias("cubes"))
    got = pod.grid_summary(spectra, "cgl", fits["cgl"].samples).join(powers, "grid")
    return got.select("grid", F.round("trace", 7).alias("trace"), F.round("squares", 7).alias("squares"), F.round("cubes", 7).alias("cubes"), F.round("ratio", 8).alias("ratio"))


# eigenvalue tables of the labels: variances of the points, in falling order
_VARS = f"{t.POINTS}, v AS (SELECT label, pos, var_samp(x) AS eigenvalue FROM p GROUP BY label, pos), g AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY eigenvalue DESC, pos) - 1 AS i, eigenvalue FROM v)"


def _variances(spark, d):
    from pyspark.sql import Window

    points = fields.long_form(t.fields(spark, d), "values", "label")
    v = points.groupBy("label", "pos").agg(F.var_samp("value").alias("eigenvalue"))
    return v.withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("eigenvalue"), "pos")) - 1).drop("pos")


@query(f"WITH {_VARS}, c AS (SELECT *, sum(eigenvalue) OVER (PARTITION BY label ORDER BY i) / sum(eigenvalue) OVER (PARTITION BY label) AS share FROM g), fr AS (SELECT unnest([0.5, 0.9, 0.99]) AS fraction) SELECT label, CAST(fraction AS DOUBLE) AS fraction, coalesce(min(CASE WHEN share >= fraction THEN i + 1 END), count(*)) AS rank FROM c, fr GROUP BY label, fraction")
def energy_ranks(spark, d):
    return pod.energy_ranks(_variances(spark, d), [0.5, 0.9, 0.99], "label").withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_VARS} SELECT label, CAST(i AS INTEGER) AS i, round(sum(eigenvalue) OVER (PARTITION BY label ORDER BY i) / sum(eigenvalue) OVER (PARTITION BY label), 8) AS share FROM g")
def cumulative_energy(spark, d):
    return pod.cumulative(_variances(spark, d), "label").select("label", "i", F.round("share", 8).alias("share"))


@query(f"WITH {_VARS}, a AS (SELECT label, sum(eigenvalue) AS trace FROM g GROUP BY label), b AS (SELECT sum(eigenvalue) AS population, sum(eigenvalue * eigenvalue) AS squares FROM g WHERE label = 0) SELECT label, round(trace, 8) AS trace, round(population, 8) AS population, round(trace / population, 8) AS ratio, round(sqrt(2 * squares / 49) / population, 8) AS scatter FROM a, b")
def trace_check(spark, d):
    rows = _variances(spark, d)
    base = rows.where("label = 0").drop("label")
    labels = rows.select("label").distinct()
    got = pod.trace_check(rows, base.crossJoin(F.broadcast(labels)), 50, "label")
    return got.select("label", *(F.round(n, 8).alias(n) for n in ("trace", "population", "ratio", "scatter")))


@query(f"WITH {_VARS}, b AS (SELECT i, i // 4 AS q, eigenvalue FROM g WHERE label = 0), s AS (SELECT label, q, count(*) AS g, sum(a.eigenvalue) AS own, sum(b.eigenvalue) AS whole FROM g a JOIN b USING (i) GROUP BY label, q) SELECT label, q, g, round(own / whole, 8) AS ratio, abs(own / whole - 1) > 3 * sqrt(2.0 / (50 * g)) AS off FROM s")
def equal_groups(spark, d):
    rows = _variances(spark, d)
    base = rows.where("label = 0").withColumn("q", F.floor(F.col("i") / 4))
    return pod.equal_groups(rows, base, 50, "label").select("label", "q", "g", F.round("ratio", 8).alias("ratio"), "off")


@query(f"WITH {_VARS} SELECT a.label AS grid, CAST(i AS INTEGER) AS i, round(a.eigenvalue / b.eigenvalue, 8) AS ratio FROM g a JOIN g b USING (i) WHERE b.label = 0")
def grid_comparison(spark, d):
    rows = _variances(spark, d).withColumnRenamed("label", "grid")
    return pod.against_grid(rows, 0, ).select("grid", "i", F.round("ratio", 8).alias("ratio"))


@query(f"WITH {_VARS} SELECT a.label, CAST(a.i AS INTEGER) AS i, round(a.eigenvalue, 8) AS eigenvalue, round(b.eigenvalue, 8) AS population FROM g a JOIN g b ON a.i = b.i AND b.label = 0 WHERE a.i < 20")
def leading_eigenvalues(spark, d):
    rows = _variances(spark, d)
    got = pod.leading(rows, rows.where("label = 0"), 20, "label")
    return got.select("label", "i", F.round("eigenvalue", 8).alias("eigenvalue"), F.round("population", 8).alias("population"))


_SOLVED = grids.Poisson(N, N)(np.eye(N * N).reshape(-1, N, N)).reshape(N * N, N * N).T


@query(f"WITH {t.POINTS}, a AS (SELECT * FROM {_matrix_sql(_SOLVED)}), u AS (SELECT sample, a.i, sum(c * x) AS u FROM p JOIN a ON a.k = pos GROUP BY ALL) SELECT sample, round(sqrt(sum(u * u)), 7) AS u_norm FROM u GROUP BY sample")
def solved_labels(spark, d):
    rows = t.fields(spark, d).withColumn("u", generate.solve("values", N))
    return rows.select("sample", F.round(losses.norm(F.col("u")), 7).alias("u_norm"))


@query()
def generated_split(spark, d):
    """A labelled random field for every sample of the table, errors by group of ten."""
    rows = generate.labelled(t.fields(spark, d), 17, 10_000, s=12)
    return rows.groupBy(F.floor(F.col("sample") / 10).alias("part")).agg(F.count("*").alias("n"), F.round(F.max("transfer"), 6).alias("transfer"), (F.max("label_error") < 1e-2).alias("near"))



@query()
def exact_subset(spark, d):
    rows = t.fields(spark, d)
    n = rows.count()
    return sampling.chosen(rows, sampling.exact_subset(spark, n, n // 4, 0)).select("sample", "label")


@query()
def hashed_subset(spark, d):
    return sampling.hashed_subset(t.fields(spark, d), 100, 7)


@query("""WITH g AS (SELECT label, count(*) AS n, flatten(list(list_transform(range(8), lambda i: CAST((vec_id >> CAST(8 * i AS BIGINT)) & 255 AS HUGEINT)) ORDER BY vec_id)) AS bytes FROM embeddings GROUP BY label)
SELECT label, n, lpad(lower(hex(CAST(list_reduce(bytes, lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT) AS UBIGINT))), 16, '0') AS hash FROM g""")
def subset_fingerprints(spark, d):
    return sampling.fingerprints(t.fields(spark, d), "sample", "label")


@query("SELECT e AS epoch, (row_number() OVER (PARTITION BY e ORDER BY vec_id) - 1) // 20 AS batch, row_number() OVER (PARTITION BY e ORDER BY vec_id) - 1 AS place, vec_id AS sample FROM embeddings, (SELECT unnest(range(3)) AS e)")
def sequential_batches(spark, d):
    return sampling.batches(t.fields(spark, d), 3, 20, 0, shuffle=False).withColumn("epoch", F.col("epoch").cast("long"))


@query(f"""WITH RECURSIVE n AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS root FROM embeddings),
c AS (SELECT n, unnest(range(root, root + least(2048, root))) AS a FROM n),
s AS (SELECT any_value(n) AS n, arg_min(a, row(a * ((n + a - 1) // a) - n, a)) AS a FROM c),
k AS (SELECT n, a, (n + a - 1) // a AS b FROM s),
o AS (SELECT vec_id AS sample, row_number() OVER (ORDER BY vec_id) - 1 AS x FROM embeddings), i AS (SELECT *, e AS epoch FROM o, (SELECT unnest(range(2)) AS e)),
w AS (SELECT sample, epoch, y, n, a, b FROM {shuffle.sql("(SELECT * FROM i, k)", 11)}
  UNION ALL SELECT sample, epoch, y, n, a, b FROM {shuffle.sql("(SELECT sample, epoch, n, a, b, y AS x FROM w WHERE y >= n)", 11)})
SELECT CAST(epoch AS INTEGER) AS epoch, y // 20 AS batch, y AS place, sample FROM w WHERE y < n""")
def shuffled_batches(spark, d):
    return sampling.batches(t.fields(spark, d), 2, 20, 11)


@query("WITH b AS (SELECT vec_id // 50 AS batch, vec_id % 50 AS place, vec_id AS sample FROM embeddings), n AS (SELECT *, count(*) OVER (PARTITION BY batch) AS size FROM b) SELECT batch, sample, ntile(8) OVER (PARTITION BY batch ORDER BY place) - 1 AS shard FROM n")
def shards(spark, d):
    rows = t.fields(spark, d).select(F.floor(F.col("sample") / 50).alias("batch"), (F.col("sample") % 50).alias("place"), "sample")
    sizes = rows.groupBy("batch").agg(F.count("*").alias("size"))
    return rows.join(sizes, "batch").select("batch", "sample", sampling.shard(F.col("place"), F.col("size"), 8).cast("long").alias("shard"))
