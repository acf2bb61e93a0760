"""Registered queries over run tables and their export, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridmill.jobs import tables as t
from gridmill.operators import errors, runs, sampling, tracking
from gridmill.sources import readers

#: Registered by `query`: name -> (function, SQL or None).
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _r(rows, digits, *names):
    """Rows with the named columns rounded."""
    return rows.withColumns({n: F.round(n, digits) for n in names})


@query(f"WITH {t.EPOCHS} SELECT run, epoch, event_type, value FROM m QUALIFY row_number() OVER (PARTITION BY run ORDER BY epoch DESC) = 1")
def run_last_epoch(spark, d):
    return runs.last_epoch(t.epochs(spark, d), "epoch", "event_type", "value").withColumn("epoch", F.col("epoch").cast("long"))


@query(f"WITH {t.EPOCHS}, q AS (SELECT run, list(CASE WHEN epoch > 1 THEN epoch_time_s END ORDER BY epoch_time_s) FILTER (epoch > 1 AND epoch_time_s IS NOT NULL) AS v FROM m GROUP BY run) SELECT run, v[len(v) // 2 + 1] AS median_time FROM q")
def run_median_time(spark, d):
    return runs.median_epoch_time(t.epochs(spark, d))


_ARM = "CASE WHEN optimizer IS NULL OR optimizer = 'adam' THEN 'Adam' WHEN optimizer = 'hybrid' THEN 'Hybrid' ELSE 'GN' || batch_size || CASE WHEN diagonal THEN '-D' ELSE '' END END"


def _armed(spark, d):
    return t.runs(spark, d).withColumn("arm", runs.optimizer_arm(F.col("optimizer"), F.col("batch_size"), F.col("diagonal"))).withColumn("gap", F.col("test_l2") - F.col("train_l2"))


@query(f"WITH {t.RUNS} SELECT run, {_ARM} AS arm FROM r")
def optimizer_arms(spark, d):
    return _armed(spark, d).select("run", "arm")


@query(f"WITH {t.RUNS}, l AS (SELECT run, list(epoch_time_s ORDER BY epoch_time_s) FILTER (epoch > 1 AND epoch_time_s IS NOT NULL) AS v FROM m GROUP BY run) SELECT r.run, r.epoch, s, n, round(test_l2 - train_l2, 9) AS gap, v[len(v) // 2 + 1] AS median_time, coalesce(CASE WHEN r.run % 3 <> 0 THEN CAST(num_params AS BIGINT) END, CAST(epoch * ceil(n / batch_size) AS BIGINT)) AS steps, CASE WHEN r.run % 3 <> 0 THEN r.run + 2 * r.run END AS passes FROM r JOIN l USING (run)")
def run_assembly(spark, d):
    rows = t.runs(spark, d)
    data = rows.select("run", "s", "n", F.col("n").alias("n_train"))
    training = rows.select("run", "batch_size", F.col("epoch").alias("epochs"))
    model = rows.select("run", "padding")
    metrics = t.epochs(spark, d).join(rows.select("run"), "run", "left_semi").select("run", "epoch", "train_l2", "test_l2", "epoch_time_s")
    faults = rows.select("run", "s", F.col("value").alias("total"))
    costs = rows.where("run % 3 <> 0").select("run", F.col("num_params").cast("long").alias("optimisation_steps"), F.col("run").alias("forward_passes"), (2 * F.col("run")).alias("backward_passes"))
    got = runs.assembled(data, training, model, metrics, faults, costs)
    return got.select("run", F.col("epoch").cast("long").alias("epoch"), "s", "n", F.round("gap", 9).alias("gap"), "median_time", F.col("steps").cast("long").alias("steps"), "passes")


@query(f"WITH {t.RUNS} SELECT padding, s, count(*) AS runs, CAST(max(seed) AS BIGINT) AS last_seed, round(avg(test_l2), 9) AS mean, min(test_l2) AS low, max(test_l2) AS high, string_agg(DISTINCT peak, ',' ORDER BY peak) AS peaks, arg_min(num_params, row(seed, num_params)) FILTER (num_params IS NOT NULL) AS num_params FROM r GROUP BY padding, s")
def cells(spark, d):
    rows = t.runs(spark, d)
    got = runs.cells(rows, "test_l2")
    return got.select("padding", "s", "runs", F.element_at("seeds", -1).alias("last_seed"), F.round("test_l2.mean", 9).alias("mean"), "test_l2.low", "test_l2.high", F.array_join("peaks", ",").alias("peaks"), "num_params")


_SIZES = f"{t.RUNS}, z AS (SELECT n, count(*) AS runs, avg(value / 1000) AS mean, min(value / 1000) AS low, max(value / 1000) AS high, avg(value / 1000) <= 0.05 AS mean_meets, bool_and(value / 1000 <= 0.05) AS all_meet, avg(CASE WHEN n < 200 THEN value END) AS time FROM r GROUP BY n)"


def _sizes(spark, d):
    return t.runs(spark, d).withColumn("error", F.col("value") / 1000)


@query(f"WITH {_SIZES} SELECT n, runs, round(mean, 9) AS mean, low, high, mean_meets, all_meet FROM z")
def errors_by_size(spark, d):
    got = runs.by_size(_sizes(spark, d), "error", 0.05)
    return got.select("n", "runs", F.round("spread.mean", 9).alias("mean"), "spread.low", "spread.high", "mean_meets", "all_meet")


@query(f"WITH {_SIZES} SELECT n, round(mean, 9) AS mean FROM z WHERE mean_meets ORDER BY n LIMIT 1")
def smallest_size(spark, d):
    return runs.smallest_size(runs.by_size(_sizes(spark, d), "error", 0.05)).select("n", F.round("spread.mean", 9).alias("mean"))


@query(f"WITH {t.RUNS} SELECT n, 'subset_seed' AS \"by\", subset_seed AS key, round(avg(value), 8) AS mean FROM r GROUP BY ALL UNION ALL SELECT n, 'seed', seed, round(avg(value), 8) FROM r GROUP BY ALL")
def means_by_seed(spark, d):
    return _r(runs.means_by(t.runs(spark, d), "value"), 8, "mean")


@query(f"WITH {_SIZES}, l AS (SELECT n, lag(n) OVER w AS from_n, lag(mean) OVER w - mean AS fall, time - lag(time) OVER w AS more_time FROM z WINDOW w AS (ORDER BY n)) SELECT n, from_n, round(fall, 9) AS fall, round(more_time, 7) AS more_time, n - from_n AS more_samples, round((n - from_n) / CASE WHEN fall > 0 THEN fall * 1000 END, 5) AS samples_per, round(more_time / CASE WHEN fall > 0 THEN fall * 1000 END, 5) AS time_per FROM l WHERE from_n IS NOT NULL")
def steps_between_sizes(spark, d):
    sizes = _sizes(spark, d).groupBy("n").agg(F.avg("error").alias("mean"), F.avg(F.when(F.col("n") < 200, F.col("value"))).alias("time"))
    got = runs.steps_between(sizes).select("n", "from_n", "fall", "more_time", "more_samples", "samples_per", "time_per")
    return _r(_r(_r(got, 9, "fall"), 7, "more_time"), 5, "samples_per", "time_per")


@query(f"WITH {t.RUNS} SELECT count(DISTINCT row(padding, s)) AS grids, count(DISTINCT coalesce(optimizer, '-')) AS optimizers FROM r")
def homogeneity(spark, d):
    rows = t.runs(spark, d)
    return rows.agg(runs.distinct_values(rows, "padding", "s").alias("grids"), runs.distinct_values(rows, "optimizer").alias("optimizers"))


@query(f"WITH {t.RUNS}, a AS (SELECT *, {_ARM} AS arm FROM r) SELECT arm, count(*) AS runs, count(DISTINCT seed) AS seeds, round(avg(test_l2 - train_l2), 9) AS gap, round(avg(value), 8) AS value FROM a GROUP BY arm")
def runs_by_arm(spark, d):
    got = runs.by_arm(_armed(spark, d), "gap", "value")
    return got.select("arm", "runs", F.size("seeds").cast("long").alias("seeds"), F.round("gap.mean", 9).alias("gap"), F.round("value.mean", 8).alias("value"))


@query("WITH s AS (SELECT l_orderkey AS run, sum(l_linenumber) AS forward, sum(l_linenumber * 2) AS backward, count(*) AS steps FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey AS run, CAST(forward AS BIGINT) AS forward, CAST(backward AS BIGINT) AS backward, steps, CAST(forward + steps AS BIGINT) AS training_forward FROM orders LEFT JOIN s ON run = o_orderkey")
def pass_totals(spark, d):
    lines = t.read(spark, d, "lineitem")
    steps = lines.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("long").alias("forward_passes"), (F.col("l_linenumber") * 2).cast("long").alias("backward_passes"))
    return runs.pass_totals(steps, t.read(spark, d, "orders").select(F.col("o_orderkey").alias("run")))


@query(f"WITH {t.EPOCHS} SELECT run, value AS u_norm, value + k AS error FROM m WHERE run % 4 = 0 AND event_id IS NOT NULL")
def sample_scatter(spark, d):
    rows = t.epochs(spark, d)
    records = rows.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", "value", "k"))).alias("p"))
    records = records.select("run", (F.col("run") % 4).alias("s"), F.col("p.value").alias("u_norm_per_sample"), F.transform("p", lambda p: p["value"] + p["k"]).alias("total_per_sample"))
    return runs.scatter(records, 0)


@query(f"WITH {t.EPOCHS} SELECT run, CAST(epoch AS INTEGER) AS epoch, value FROM m WHERE run % 2 = 1 OR epoch < run % 10 + 1")
def resume_truncation(spark, d):
    rows = t.epochs(spark, d)
    resume = rows.where("run % 2 = 0").select("run", (F.col("run") % 10 + 1).alias("next_epoch")).distinct()
    return runs.truncated(rows.select("run", "epoch", "value"), resume)


@query(f"WITH {t.RUNS} SELECT run, padding, value FROM r WHERE value <= 1.02 * (SELECT min(value) FROM r) ORDER BY padding, value LIMIT 1")
def sweep_winner(spark, d):
    return runs.sweep_winner(t.runs(spark, d), "value").select("run", "padding", "value")


@query(f"WITH {t.RUNS}, g AS (SELECT s, avg(value) AS mean FROM r GROUP BY s) SELECT s, round(mean, 8) AS mean FROM g WHERE mean <= 1.10 * (SELECT mean FROM g WHERE s = 128) ORDER BY s LIMIT 1")
def baseline_grid(spark, d):
    return runs.baseline_grid(t.runs(spark, d), "value").select("s", F.round("mean", 8).alias("mean"))


@query(f"WITH {t.EPOCHS}, e AS (SELECT run % 2 AS load, run // 2 % 3 + 1 AS devices, epoch_time_s FROM m WHERE epoch BETWEEN 5 AND 50), g AS (SELECT load, devices, list(epoch_time_s ORDER BY epoch_time_s) FILTER (epoch_time_s IS NOT NULL) AS v, min(epoch_time_s) AS low, max(epoch_time_s) AS high FROM e GROUP BY ALL), q AS (SELECT *, v[len(v) // 2 + 1] AS median FROM g) SELECT q.load, q.devices, q.median, q.low, q.high, round(o.median / q.median, 8) AS speedup, round(o.median / q.median / q.devices, 8) AS efficiency FROM q LEFT JOIN q o ON o.load = q.load AND o.devices = 1")
def device_scaling(spark, d):
    rows = t.epochs(spark, d).withColumn("load", F.col("run") % 2).withColumn("devices", F.floor(F.col("run") / 2) % 3 + 1)
    return _r(runs.device_scaling(rows), 8, "speedup", "efficiency")


@query(f"WITH {t.EPOCHS} SELECT event_type, round(regr_intercept(value, k), 7) AS base, round(regr_slope(value, k), 9) AS per_sample FROM m GROUP BY event_type")
def cost_fit(spark, d):
    return _r(_r(runs.cost_fit(t.epochs(spark, d), "k", "value", "event_type"), 7, "base"), 9, "per_sample")


@query(f"WITH {t.RUNS} SELECT run, CAST(n * s * s * 2 * 4 AS BIGINT) AS bytes FROM r")
def upload_volume(spark, d):
    return t.runs(spark, d).select("run", runs.upload_bytes(F.col("n").cast("long"), F.col("s"), F.lit(2)).alias("bytes"))


@query(f"WITH {t.RUNS} SELECT run, CAST(ceil(n / batch_size) AS BIGINT) AS steps_per_epoch, CAST(ceil(n / batch_size) * epoch AS BIGINT) AS total_steps, CAST(ceil(n / batch_size) * coalesce(CASE WHEN optimizer = 'hybrid' THEN 10 END, epoch) AS BIGINT) AS schedule_steps, coalesce(value >= CASE WHEN seed > 2 THEN 50 END, false) AS spent FROM r")
def step_counts(spark, d):
    rows = t.runs(spark, d).select("run", F.col("n").alias("n_train"), "batch_size", F.col("epoch").cast("long").alias("epochs"), F.when(F.col("optimizer") == "hybrid", 10).alias("adam_epochs"), sampling.budget_spent(F.col("value"), F.when(F.col("seed") > 2, 50)).alias("spent"))
    return sampling.step_counts(rows).select("run", "steps_per_epoch", "total_steps", "schedule_steps", "spent")


@query(f"WITH {t.EPOCHS} SELECT event_type, round(corr(ln(value + 1), ln(k + 1)), 7) AS correlation FROM m GROUP BY event_type")
def log_correlation(spark, d):
    rows = t.epochs(spark, d).select("event_type", (F.col("value") + 1).alias("value"), (F.col("k") + 1).alias("k"))
    return rows.groupBy("event_type").agg(F.round(errors.log_correlation(F.col("value"), F.col("k").cast("double")), 7).alias("correlation"))


@query(f"WITH {t.EPOCHS} SELECT run, round(avg(value), 8) AS mean, max(value) AS worst, arg_max(epoch, row(value, -epoch)) AS worst_epoch FROM m GROUP BY run")
def error_summary(spark, d):
    rows = t.epochs(spark, d).withColumn("sample", F.col("epoch").cast("long"))
    got = rows.groupBy("run").agg(errors.stats(F.col("value")).alias("e")).join(errors.worst_sample(rows, "value", "run"), "run")
    return got.select("run", F.round("e.mean", 8).alias("mean"), "e.worst", F.col("worst_sample").alias("worst_epoch"))


@query(f"WITH {t.RUNS} SELECT run, s = 64 AND n = 100 AS compared, CASE WHEN s = 64 AND n = 100 THEN run % 2 = 0 AND value <> 0 ELSE true END AS agrees FROM r")
def sidecar_check(spark, d):
    rows = t.runs(spark, d)
    checked = rows.select("run", F.col("run").alias("set"), "s", F.col("n").alias("count"), F.col("value").alias("mean"), F.col("value").alias("worst"))
    side = rows.select(F.col("run").alias("set"), F.lit(64).alias("s"), F.lit(100).alias("count"), F.col("value").alias("mean"), (F.col("value") * (1 + F.col("run") % 2 * 1e-9)).alias("max"))
    return errors.check_sidecar(checked, side).select("run", "compared", "agrees")


@query(f"WITH {t.RUNS} SELECT run, run % 3 <> 0 AND test_l2 <> 0 AND abs(test_l2 * (1 + run % 2 * 1e-3) - test_l2) / abs(test_l2) <= 1e-5 AS agrees FROM r")
def last_epoch_check(spark, d):
    rows = t.runs(spark, d)
    means = rows.select("run", (F.col("test_l2") * (1 + F.col("run") % 2 * 1e-3)).alias("model_mean"))
    return errors.check_last_epoch(means, rows.where("run % 3 <> 0")).select("run", "agrees")


@query("SELECT n, k, split, 'poisson_n' || n || '_K' || k || '_' || split AS stem, (SELECT count(*) FROM events WHERE user_id % 6 = pos) AS events FROM (VALUES (0, 33, 16), (1, 65, 32), (2, 129, 64), (3, 257, 64), (4, 129, 32), (5, 65, 16)) AS v(pos, n, k), (VALUES ('train'), ('test')) AS s(split)")
def catalogue(spark, d):
    """The known sets, with how many events fall to each."""
    at = F.create_map(*(x for i, (n, k) in enumerate(readers.SETS) for x in (F.lit(n * 1000 + k), F.lit(i))))
    counts = t.read(spark, d, "events").groupBy((F.col("user_id") % len(readers.SETS)).alias("at")).agg(F.count("*").alias("events"))
    rows = readers.catalogue(spark).withColumn("at", at[F.col("n") * 1000 + F.col("k")])
    return rows.join(counts, "at", "left").select("n", "k", "split", "stem", F.coalesce("events", F.lit(0)).alias("events"))


@query(f"WITH {t.RUNS} SELECT run, 'c.name' AS key, 'run-' || run AS value FROM r UNION ALL SELECT run, 'c.grid.s', CAST(s AS VARCHAR) FROM r UNION ALL SELECT run, 'c.grid.padding', CAST(padding AS VARCHAR) FROM r UNION ALL SELECT run, 'c.optimizer', coalesce(optimizer, 'null') FROM r UNION ALL SELECT run, 'c.modes', '[' || s || ',' || n || ']' FROM r UNION ALL SELECT run, 'c.subset', coalesce(CAST(subset_seed AS VARCHAR), 'null') FROM r")
def export_params(spark, d):
    config = F.struct(F.concat(F.lit("run-"), "run").alias("name"), F.struct("s", "padding").alias("grid"), "optimizer", F.array("s", "n").alias("modes"), F.col("subset_seed").alias("subset"))
    return tracking.check_lengths(tracking.params(t.runs(spark, d).select("run", config.alias("c")), "c"))


@query(f"WITH {t.RUNS} SELECT * FROM (SELECT run, 'group' AS key, 'p' || padding || '_s' || s AS value FROM r UNION ALL SELECT run, 'n', CAST(n AS VARCHAR) FROM r UNION ALL SELECT run, 'subset', CAST(subset_seed AS VARCHAR) FROM r) WHERE value IS NOT NULL")
def export_tags(spark, d):
    return tracking.tags(t.runs(spark, d), group=tracking.run_group(F.col("padding"), F.col("s")), n=F.col("n"), subset=F.col("subset_seed"))


_LONG = f"{t.EPOCHS}, l AS (SELECT run, 'train_l2' AS key, epoch AS step, train_l2 AS value FROM m UNION ALL SELECT run, 'test_l2', epoch, test_l2 FROM m UNION ALL SELECT run, 'epoch_time_s', epoch, epoch_time_s FROM m WHERE epoch_time_s IS NOT NULL)"


def _long(spark, d):
    return tracking.metrics_long(t.epochs(spark, d), "epoch", "train_l2", "test_l2", "epoch_time_s")


@query(f"WITH {_LONG} SELECT run, key, step, round(value, 9) AS value FROM l WHERE value IS NOT NULL")
def export_metrics(spark, d):
    return _r(_long(spark, d), 9, "value")


@query(f"WITH {_LONG}, b AS (SELECT run, (row_number() OVER (PARTITION BY run ORDER BY step, key) - 1) // 50 AS batch, step, key FROM l WHERE value IS NOT NULL) SELECT run, batch, count(*) AS n, min(step) AS first_step FROM b GROUP BY run, batch")
def export_batches(spark, d):
    got = tracking.request_batches(_long(spark, d), 50, "step", "key")
    return got.select("run", "batch", "n", F.get_json_object("payload", "$[0].step").cast("long").alias("first_step"))


@query(f"WITH {t.RUNS} SELECT run, k, 'epoch' AS key, epoch AS step, CAST(k AS DOUBLE) AS value FROM r")
def export_summary(spark, d):
    last = t.runs(spark, d)
    got = tracking.summary_metrics(last, last.select("run", F.col("k").alias("params")), "params")
    return got.join(last.select("run", "k"), "run").select("run", "k", F.lit("epoch").alias("key"), "step", "value")


@query(f"WITH {t.RUNS} SELECT 'e_' || run || '_' || (1700000000 + run) AS run, CAST((1700000000 + run) * 1000 AS BIGINT) AS start_ms, CASE WHEN run % 4 = 0 THEN 5 ELSE CAST((1700000000 + run) * 1000 + round(value * 1000) AS BIGINT) END AS end_ms FROM r")
def export_times(spark, d):
    rows = t.runs(spark, d).select(F.concat(F.lit("e_"), "run", F.lit("_"), F.lit(1_700_000_000) + F.col("run")).alias("run"), F.when(F.col("run") % 4 != 0, F.col("value")).alias("training_time_s"))
    return tracking.times(rows, F.lit(5).cast("long")).select("run", "start_ms", "end_ms")


@query(f"WITH {t.RUNS} SELECT run FROM r WHERE run % 3 <> 0")
def export_pending(spark, d):
    rows = t.runs(spark, d)
    return tracking.to_export(rows, rows.where("run % 3 = 0")).select("run")


@query(f"WITH {t.RUNS} SELECT run, CASE WHEN run % 2 = 0 THEN 2 ELSE 1 END AS version FROM r")
def export_replaced(spark, d):
    rows = t.runs(spark, d).select("run")
    return tracking.after_export(rows.withColumn("version", F.lit(1)), rows.where("run % 2 = 0").withColumn("version", F.lit(2)))


@query(f"WITH {t.RUNS}, c AS (SELECT run, ceil(count(*) / 50.0) AS batches FROM m GROUP BY run), a AS (SELECT run, 0 AS phase, 'create' AS kind, 0 AS batch FROM r UNION ALL SELECT run, 1, 'params', 0 FROM r UNION ALL SELECT run, 2, 'metrics', unnest(range(CAST(batches AS BIGINT))) FROM c UNION ALL SELECT run, 4, 'update', 0 FROM r) SELECT run, row_number() OVER (PARTITION BY run ORDER BY phase, batch) - 1 AS seq, kind FROM a")
def export_requests(spark, d):
    rows = t.runs(spark, d)
    one = rows.select("run", F.to_json(F.struct("run")).alias("payload"))
    settings = tracking.request_batches(rows.select("run", F.lit("s").alias("key"), F.col("s").cast("string").alias("value")), tracking.MOST_PARAMS, "key")
    values = tracking.request_batches(tracking.metrics_long(t.epochs(spark, d), "epoch", "test_l2"), 50, "step")
    got = tracking.requests(one, settings, values, one.where("false"), one)
    return got.select("run", F.col("seq").cast("long").alias("seq"), "kind")


@query(f"WITH {t.EPOCHS} SELECT run, CAST(epoch AS INTEGER) AS epoch, false AS bad, k = 9 OR epoch_time_s IS NULL AS no_time FROM m")
def metrics_lines(spark, d):
    """Epochs written as lines of a metrics file and parsed again."""
    rows = t.epochs(spark, d).withColumn("train_mse", F.col("value")).withColumn("current_lr", F.lit(1e-3)).withColumn("epoch_time_s", F.when(F.col("k") != 9, F.col("epoch_time_s")))
    lines = readers.metrics_lines(rows.select("run", *readers.METRICS)).withColumnRenamed("epoch", "line")
    return readers.parsed_metrics(lines).select("run", "epoch", "bad", F.col("epoch_time_s").isNull().alias("no_time"))


@query("WITH e AS (SELECT user_id AS run, event_id % 100 AS epoch, max(row(ts, event_id, value)) AS r FROM events GROUP BY ALL) SELECT run, epoch, r[3] AS value FROM e")
def latest_epochs(spark, d):
    from gridmill.streaming.epochs import latest

    rows = t.read(spark, d, "events").select(F.col("user_id").alias("run"), (F.col("event_id") % 100).alias("epoch"), "event_id", "value", "ts")
    return latest(rows).select("run", "epoch", "value")


@query(f"WITH {t.EPOCHS} SELECT run, count(*) AS epochs, min(test_l2) AS best, arg_max(test_l2, epoch) AS last, round(sum(epoch_time_s), 7) AS seconds FROM m GROUP BY run")
def run_totals(spark, d):
    from gridmill.streaming.epochs import totals

    return _r(totals(t.epochs(spark, d)), 7, "seconds")
