"""Tables of training runs: assembled rows, groups, comparisons and choice rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions.safe import greatest_number
from gridmill.operators.selection import upper_medians

#: Mean error that a training size is to reach.
BAR = 2e-2


def last_epoch(metrics: DataFrame, *columns: str) -> DataFrame:
    """Each run's row of its last epoch."""
    rest = [c for c in metrics.columns if c != "run"]
    return metrics.groupBy("run").agg(F.max_by(F.struct(*rest), "epoch").alias("last")).select("run", *(f"last.{c}" for c in (columns or rest)))


def _later_times(first: Column) -> Column:
    """Sorted epoch times of a run after its first row, from rows collected as `times`."""
    later = F.filter("times", lambda x: (x["epoch"] > first) & x["epoch_time_s"].isNotNull())
    return F.array_sort(F.transform(later, lambda x: x["epoch_time_s"]))


def finished(metrics: DataFrame) -> DataFrame:
    """Each run's last epoch with median_time, in one pass over the epochs."""
    rest = [c for c in metrics.columns if c != "run"]
    rows = metrics.groupBy("run").agg(F.max_by(F.struct(*rest), "epoch").alias("last"), F.min("epoch").alias("first"), F.collect_list(F.struct("epoch", "epoch_time_s")).alias("times"))
    rows = rows.withColumn("times", _later_times(F.col("first")))
    middle = F.try_element_at("times", (F.floor(F.size("times") / 2) + 1).cast("int"))
    return rows.select("run", *(f"last.{c}" for c in rest), middle.alias("median_time"))


def median_epoch_time(metrics: DataFrame) -> DataFrame:
    """(run, median_time): upper median of the epoch times after the run's first row."""
    return finished(metrics.select("run", "epoch", "epoch_time_s")).select("run", "median_time")


def optimizer_arm(optimizer: Column, batch: Column, diagonal: Column) -> Column:
    """Name of a run's optimiser arm: Adam, Hybrid, or GN with its batch and -D for a diagonal one."""
    second = F.concat(F.lit("GN"), batch.cast("string"), F.when(F.coalesce(diagonal, F.lit(False)), "-D").otherwise(""))
    return F.when(optimizer.isNull() | (optimizer == "adam"), "Adam").when(optimizer == "hybrid", "Hybrid").otherwise(second)


def assembled(data: DataFrame, training: DataFrame, model: DataFrame, metrics: DataFrame, errors: DataFrame, costs: DataFrame) -> DataFrame:
    """A row a run from its files; only costs may be missing.

    A run without epochs or errors, or whose errors are on another grid than its data, is an error."""
    faults = errors.withColumnRenamed("s", "errors_s").withColumn("has_errors", F.lit(True))
    out = data.join(training, "run").join(model, "run").join(finished(metrics), "run", "left").join(faults, "run", "left").join(costs, "run", "left")
    name = F.col("run").cast("string")
    wrong = (
        F.when(F.col("epoch").isNull(), F.concat(F.lit("no metrics of run "), name))
        .when(F.col("has_errors").isNull(), F.concat(F.lit("no errors of run "), name))
        .when(F.col("errors_s") != F.col("s"), F.concat(F.lit("errors and data on different grids for run "), name))
    )
    # the check is part of the key, so no later step can leave it out
    out = out.withColumn("run", F.when(wrong.isNull(), F.col("run")).otherwise(F.raise_error(wrong).cast(data.schema["run"].dataType))).drop("errors_s", "has_errors")
    steps = F.col("epochs") * F.ceil(F.col("n_train") / F.col("batch_size"))
    return out.withColumn("steps", F.coalesce("optimisation_steps", steps)).withColumn("gap", F.col("test_l2") - F.col("train_l2")).withColumn("passes", F.col("forward_passes") + F.col("backward_passes"))


def spread(values: Column) -> Column:
    """(mean, low, high) over the values that are there; low and high skip NaN, the mean does not."""
    return F.when(F.count(values) > 0, F.struct(F.avg(values).alias("mean"), F.min(values).alias("low"), greatest_number(values).alias("high")))


def cells(runs: DataFrame, *values: str) -> DataFrame:
    """A row for each (padding, s): runs, seeds in order, spreads, peaks and the first known costs by
    seed; of equal seeds the smaller."""
    return runs.groupBy("padding", "s").agg(
        F.count("*").alias("runs"), F.array_sort(F.collect_list("seed")).alias("seeds"),
        *(spread(F.col(v)).alias(v) for v in values),
        F.array_sort(F.collect_set("peak")).alias("peaks"),
        F.min_by("num_params", F.when(F.col("num_params").isNotNull(), F.struct("seed", "num_params"))).alias("num_params"),
    )


def by_size(runs: DataFrame, error: str, bar: float = BAR) -> DataFrame:
    """(n, runs, spread, mean_meets, all_meet) by training size."""
    e = F.col(error)
    out = runs.groupBy("n").agg(F.count("*").alias("runs"), spread(e).alias("spread"), F.coalesce(F.avg(e) <= bar, F.lit(False)).alias("mean_meets"), F.coalesce(F.bool_and(F.coalesce(e <= bar, F.lit(False))), F.lit(False)).alias("all_meet"))
    return out


def smallest_size(sizes: DataFrame) -> DataFrame:
    """The smallest n whose mean meets the bar; no row if none does."""
    return sizes.where("mean_meets").orderBy("n").limit(1)


def means_by(runs: DataFrame, error: str) -> DataFrame:
    """(n, by, key, mean): means by subset seed and by seed; a null key is a key of its own."""
    both = F.explode(F.array(
        F.struct(F.lit("subset_seed").alias("by"), F.col("subset_seed").cast("long").alias("key")),
        F.struct(F.lit("seed").alias("by"), F.col("seed").cast("long").alias("key")),
    ))
    return runs.select("n", error, both.alias("g")).groupBy("n", "g.by", "g.key").agg(F.avg(error).alias("mean"))


def steps_between(sizes: DataFrame) -> DataFrame:
    """From each size to the next: fall of the mean, samples and time added, per thousandth of fall.

    sizes: (n, mean, time), a handful of rows. Time is null unless both have one; with no fall the
    per-thousandth columns are null."""
    w = Window.orderBy("n")
    rows = sizes.select("n", F.lag("n").over(w).alias("from_n"), (F.lag("mean").over(w) - F.col("mean")).alias("fall"), (F.col("time") - F.lag("time").over(w)).alias("more_time"))
    rows = rows.where(F.col("from_n").isNotNull()).withColumn("more_samples", F.col("n") - F.col("from_n"))
    per = F.when(F.col("fall") > 0, F.col("fall") * 1000)
    return rows.withColumn("samples_per", F.col("more_samples") / per).withColumn("time_per", F.col("more_time") / per)


def distinct_values(runs: DataFrame, *columns: str) -> Column:
    """How many different combinations, with null as a value."""
    return F.count_distinct(F.struct(*columns))


def assert_alike(runs: DataFrame, *columns: str) -> DataFrame:
    """runs, or an error if they differ in the columns together."""
    if runs.agg(distinct_values(runs, *columns).alias("d")).first().d > 1:
        raise ValueError(f"runs differ in {', '.join(columns)}")
    return runs


def by_arm(runs: DataFrame, *values: str) -> DataFrame:
    """A row for each optimiser arm with the spreads of the values."""
    return runs.groupBy("arm").agg(F.count("*").alias("runs"), F.array_sort(F.collect_set("seed")).alias("seeds"), F.array_sort(F.collect_set("peak")).alias("peaks"), *(spread(F.col(v)).alias(v) for v in values))


def pass_totals(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, forward, backward, steps, training_forward) of runs; null where a run has no step log."""
    sums = steps.groupBy("run").agg(F.sum("forward_passes").alias("forward"), F.sum("backward_passes").alias("backward"), F.count("*").alias("steps"))
    return runs.select("run").distinct().join(sums, "run", "left").withColumn("training_forward", F.col("forward") + F.col("steps"))


def scatter(evaluations: DataFrame, s: int) -> DataFrame:
    """(run, u_norm, error): per-sample points of the runs at one grid."""
    pair = F.explode(F.arrays_zip(F.col("u_norm_per_sample").alias("u_norm"), F.col("total_per_sample").alias("error")))
    return evaluations.where(F.col("s") == s).select("run", pair.alias("p")).select("run", "p.u_norm", "p.error")


def truncated(metrics: DataFrame, resume: DataFrame) -> DataFrame:
    """Rows before the epoch that each run resumes from; runs that don't resume keep all."""
    return metrics.join(resume.select("run", "next_epoch"), "run", "left").where(F.coalesce(F.col("epoch") < F.col("next_epoch"), F.lit(True))).drop("next_epoch")


def sweep_winner(runs: DataFrame, loss: str = "test_l2", within: float = 1.02) -> DataFrame:
    """Smallest padding whose loss is within 2 % of the lowest; ties to the lower loss."""
    least = runs.agg(F.min(loss).alias("least"))
    return runs.crossJoin(F.broadcast(least)).where(F.col(loss) <= within * F.col("least")).orderBy("padding", loss).limit(1).drop("least")


def baseline_grid(rows: DataFrame, error: str, reference: int = 128, within: float = 1.10) -> DataFrame:
    """Smallest s whose mean error is within 10 % of the reference grid's."""
    means = rows.groupBy("s").agg(F.avg(error).alias("mean"))
    ref = means.where(F.col("s") == reference).select(F.col("mean").alias("reference"))
    return means.crossJoin(F.broadcast(ref)).where(F.col("mean") <= within * F.col("reference")).orderBy("s").limit(1)


def device_scaling(epochs: DataFrame, first: int = 5, last: int = 50) -> DataFrame:
    """(load, devices, median, low, high, speedup, efficiency) of epoch times over a range of epochs.

    A pair of load and devices holds the epochs of any number of runs; its median is found by counts."""
    used = epochs.where(F.col("epoch").between(first, last))
    medians = upper_medians(used, "epoch_time_s", "load", "devices").drop("n").withColumnsRenamed({"load": "of_load", "devices": "of_devices"})
    rows = used.groupBy("load", "devices").agg(F.min("epoch_time_s").alias("low"), F.max("epoch_time_s").alias("high"))
    same = F.col("load").eqNullSafe(F.col("of_load")) & F.col("devices").eqNullSafe(F.col("of_devices"))
    rows = rows.join(medians, same).select("load", "devices", "median", "low", "high")
    one = rows.where("devices = 1").select("load", F.col("median").alias("single"))
    speedup = F.col("single") / F.col("median")
    return rows.join(one, "load", "left").withColumn("speedup", speedup).withColumn("efficiency", speedup / F.col("devices")).drop("single")


def cost_fit(rows: DataFrame, size: str, seconds: str, *group: str) -> DataFrame:
    """(base, per_sample) of the least-squares line of seconds over size."""
    return rows.groupBy(*group).agg(F.regr_intercept(seconds, size).alias("base"), F.regr_slope(seconds, size).alias("per_sample"))


def upload_bytes(samples: Column, s: Column, channels: Column) -> Column:
    """Bytes of a split in single precision."""
    return samples * s * s * channels * 4
