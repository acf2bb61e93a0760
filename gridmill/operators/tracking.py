"""Run tables as the requests of an experiment tracker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tracker's limits for one request, and for the length of a key or value.
MOST_METRICS, MOST_PARAMS, MOST_LENGTH = 1000, 100, 250


def _leaves(kind: T.DataType, path: str, at: Column) -> list[tuple[str, Column]]:
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _leaves(f.dataType, f"{path}.{f.name}" if path else f.name, at[f.name])]
    text = at if isinstance(kind, T.StringType) else F.to_json(F.struct(at.alias("v")), {"ignoreNullFields": "false"})
    if not isinstance(kind, T.StringType):
        text = F.substring(text, F.lit(6), F.length(text) - 6)  # {"v":...}
    return [(path, F.coalesce(text, F.lit("null")))]


def params(configs: DataFrame, *columns: str) -> DataFrame:
    """(run, key, value): nested configs as dotted keys; strings bare, other leaves as JSON text."""
    found = [x for c in columns for x in _leaves(configs.schema[c].dataType, c, F.col(c))]
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in found))
    return configs.select("run", F.explode(pairs).alias("p")).select("run", "p.key", "p.value")


def tags(runs: DataFrame, **columns: Column) -> DataFrame:
    """(run, key, value) of the given columns as text; null ones are left out."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in columns.items()))
    return runs.select("run", F.explode(pairs).alias("p")).select("run", "p.key", "p.value").where(F.col("value").isNotNull())


def run_group(padding: Column, s: Column) -> Column:
    """Group name of a run: its padding (none is 0) and grid."""
    return F.concat(F.lit("p"), F.coalesce(padding, F.lit(0)).cast("string"), F.lit("_s"), s.cast("string"))


def metrics_long(rows: DataFrame, step: str, *names: str) -> DataFrame:
    """(run, key, step, value): a row for each metric that is there."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in names))
    return rows.select("run", F.col(step).cast("long").alias("step"), F.explode(pairs).alias("m")).select("run", "m.key", "step", "m.value").where(F.col("value").isNotNull())


def summary_metrics(last: DataFrame, summaries: DataFrame, *names: str) -> DataFrame:
    """The same for a run's summary numbers, at its last epoch."""
    return metrics_long(summaries.join(last.select("run", "epoch"), "run"), "epoch", *names)


def as_text(value: Column) -> Column:
    """A number as the tracker reads it: NaN, Infinity and -Infinity are words."""
    return F.when(F.isnan(value), "NaN").when(value == float("inf"), "Infinity").when(value == float("-inf"), "-Infinity").otherwise(value.cast("string"))


def request_batches(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    """(run, batch, n, payload): rows of a run in order, at most `limit` in a request."""
    own = Window.partitionBy("run").orderBy(*order)
    rest = [c for c in rows.columns if c != "run"]
    at = rows.withColumn("_at", F.row_number().over(own) - 1).withColumn("batch", F.floor(F.col("_at") / limit))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("_at", F.struct(*rest).alias("row")))), lambda x: x["row"])
    return at.groupBy("run", "batch").agg(F.count("*").alias("n"), F.to_json(packed).alias("payload"))


def check_lengths(rows: DataFrame, most: int = MOST_LENGTH) -> DataFrame:
    """rows, or an error if a key or value has more bytes than the tracker takes."""
    long_ = rows.where((F.octet_length("key") > most) | (F.octet_length("value") > most)).limit(1).collect()
    if long_:
        raise ValueError(f"{long_[0]['key'][:60]} of {long_[0]['run']} is over {most} bytes")
    return rows


def times(runs: DataFrame, now_ms: Column) -> DataFrame:
    """Adds start_ms and end_ms: from the seconds that end the run's name, plus its training time."""
    start = F.coalesce(F.regexp_extract("run", r"_(\d+)$", 1).try_cast("long") * 1000, now_ms)
    end = F.coalesce(start + F.round(F.col("training_time_s") * 1000).cast("long"), now_ms)
    return runs.withColumn("start_ms", start).withColumn("end_ms", end)


def to_export(runs: DataFrame, exported: DataFrame, replace: bool = False) -> DataFrame:
    """Runs to export: all if they replace earlier exports, else those not exported yet."""
    return runs if replace else runs.join(exported.select("run"), "run", "left_anti")


def after_export(exported: DataFrame, runs: DataFrame) -> DataFrame:
    """What is exported once runs have replaced their earlier exports."""
    return exported.join(runs.select("run"), "run", "left_anti").unionByName(runs.select(*exported.columns))


def requests(starts: DataFrame, params_: DataFrame, metrics: DataFrame, artifacts: DataFrame, ends: DataFrame) -> DataFrame:
    """(run, seq, kind, payload): a run's requests in order: create, params, metrics, artifacts, update."""
    kinds = (("create", starts), ("params", params_), ("metrics", metrics), ("artifact", artifacts), ("update", ends))
    rows = None
    for phase, (kind, table) in enumerate(kinds):
        part = table.select("run", F.lit(phase).alias("phase"), F.lit(kind).alias("kind"), (F.col("batch") if "batch" in table.columns else F.lit(0)).cast("long").alias("batch"), "payload")
        rows = part if rows is None else rows.unionByName(part)
    own = Window.partitionBy("run").orderBy("phase", "batch", "payload")
    return rows.withColumn("seq", F.row_number().over(own) - 1).select("run", "seq", "kind", "payload")
