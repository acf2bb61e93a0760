"""Readers and writers of split files, run folders and their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas of the record files.
STATS = "struct<mean: double, max: double>"
SIDECAR = f"n int, s int, K int, K_explicit boolean, K_max int, tau_sq double, alpha double, seed long, count int, eps_K double, error2 {STATS}, label_check {STATS}, convention_version int, git_commit string, wall_time_s double, split string, file string"
METRICS = ("epoch", "train_mse", "train_l2", "test_l2", "current_lr", "epoch_time_s")
GN_STEPS = "epoch int, step long, phi_before double, phi_after double, grad_norm double, step_norm double, predicted_reduction double, actual_reduction double, rho double, lambda double, lambda_next double, accepted boolean, accepted_iteration int, cg_iterations int, cg_rel_residual double, cg_stop string, ritz_min double, ritz_max double, adjoint_error double, forward_passes int, backward_passes int, wall_time_s double"
DATA = "base struct<n_train: int, n_test: int>, n int, s int, source struct<k: int, d: int>, subset struct<seed: long, population: int, hash: string>"
TRAINING = "epochs int, batch_size int, test_batch_size int, learning_rate double, weight_decay float, min_lr double, seed long, optimizer string, time_budget_s double, adam_epochs int"
MODEL = "modes array<int>, hidden_channels int, data_channels int, out_channels int, n_layers int, spectral_init string, padding int"
COSTS = "dataset_train_wall_time_s double, dataset_test_wall_time_s double, load_time_s double, training_time_s double, inference_time_s double, host_to_device_bytes_train long, host_to_device_bytes_test long, peak_gpu_memory string, backend_features array<string>, device string, git_commit string, num_params long, optimisation_steps long, resumes long, forward_passes long, backward_passes long"
NORMALIZER = "mean array<double>, std array<double>, shape array<int>, eps double"
#: Files of a run that go along as artifacts, besides pictures.
ARTIFACTS = ("model_config.json", "training_config.json", "data_config.json", "costs.json", "errors.json", "normalizers.json", "metrics.csv", "gn_steps.csv")

SETS = ((33, 16), (65, 32), (129, 64), (257, 64), (129, 32), (65, 16))
SPLITS = ("train", "test")
STAGES = {65: "first", 129: "second", 257: "third"}


def run_of(path: Column) -> Column:
    """Name of the folder that a file lies in."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def _plain(text: Column) -> Column:
    """A percent-encoded name as it is; a plus sign stays one."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _own_run() -> Column:
    """Name of the folder of the file that a row comes from, whose path Spark gives percent-encoded."""
    return run_of(_plain(F.col("_metadata.file_path")))


def stem(n: Column, k: Column, split: Column) -> Column:
    return F.format_string("poisson_n%d_K%d_%s", n.cast("int"), k.cast("int"), split)


def catalogue(spark: SparkSession) -> DataFrame:
    """(n, k, split, stem, fields, sidecar): the files of each known set."""
    sets = spark.createDataFrame(SETS, "n int, k int")
    splits = spark.createDataFrame([(s,) for s in SPLITS], "split string")
    name = stem(F.col("n"), F.col("k"), F.col("split"))
    return sets.crossJoin(F.broadcast(splits)).select("n", "k", "split", name.alias("stem"), F.concat(name, F.lit(".npz")).alias("fields"), F.concat(name, F.lit(".json")).alias("sidecar"))


def stage(n: int) -> str:
    if n not in STAGES:
        raise ValueError(f"no stage for a grid of {n} nodes")
    return STAGES[n]


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Records of splits; keys match by their exact case, K comes as k."""
    rows = spark.read.schema(SIDECAR).json(path, multiLine=True)
    return rows.withColumnsRenamed({"K": "k"})


def write_split(rows: DataFrame, record: DataFrame, path: str) -> None:
    """Writes fields by (n, k, split), replacing only the partitions given, and their record."""
    writer = rows.write.partitionBy("n", "k", "split").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.parquet(f"{path}/fields")
    record.write.partitionBy("n", "k", "split").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(f"{path}/records")


def parsed_metrics(lines: DataFrame, *keep: str) -> DataFrame:
    """(run, line, epoch.., bad) from (run, line, value): rows of five or six fields; an empty sixth is null.

    keep: further columns that stay."""
    f = F.split("value", ",", -1)
    size = F.size(f)
    kinds = ("int", "float", "float", "float", "double", "double")
    casts = [F.try_element_at(f, F.lit(i + 1)).try_cast(k).alias(c) for i, (c, k) in enumerate(zip(METRICS, kinds, strict=True))]
    out = lines.select("run", "line", "value", *keep, size.alias("fields"), F.try_element_at(f, F.lit(6)).alias("sixth"), *casts)
    unread = ~F.col("fields").isin(5, 6) | F.greatest(*(F.col(c).isNull() for c in METRICS[:5])) | ((F.col("fields") == 6) & (F.col("sixth") != "") & F.col("epoch_time_s").isNull())
    return out.withColumn("bad", F.coalesce(unread, F.lit(True)))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(run, epoch, ...) of the metrics files under path; a bad row is an error that names its line."""
    folder = _own_run()
    run = F.when(folder.startswith("run="), _plain(F.substr(folder, F.lit(5)))).otherwise(folder)
    text = spark.read.text(path, wholetext=True).select(run.alias("run"), "value")
    lines = text.select("run", F.posexplode(F.split("value", "\r?\n")).alias("at", "value")).where((F.col("at") > 0) & (F.col("value") != ""))
    rows = parsed_metrics(lines.select("run", (F.col("at") + 1).alias("line"), "value"))
    bad = rows.where("bad").orderBy("run", "line").limit(1).collect()
    if bad:
        raise ValueError(f"line {bad[0].line} of run {bad[0].run}: {bad[0].value!r}")
    return rows.select("run", *METRICS)


def metrics_lines(metrics: DataFrame) -> DataFrame:
    """(run, epoch, value): rows as they are appended to a metrics file; a null time is an empty field."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in METRICS]
    return metrics.select("run", "epoch", F.concat_ws(",", *parts).alias("value"))


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Adds rows to the metrics of their runs: a folder run=<run> each under path, whose files begin
    with the header and hold the lines of metrics_lines in the order of epochs; read_metrics reads
    them back. A run's new rows are one file, as one log is appended by one writer."""
    lines = metrics_lines(metrics).select("run", "epoch", "value")
    head = metrics.select("run").distinct().select("run", F.lit(-1).alias("epoch"), F.lit(",".join(METRICS)).alias("value"))
    rows = head.unionByName(lines.select("run", F.col("epoch").cast("int").alias("epoch"), "value"))
    rows.repartition("run").sortWithinPartitions("run", "epoch").select("run", "value").write.mode("append").partitionBy("run").text(path)


def read_gn_steps(spark: SparkSession, path: str) -> DataFrame:
    """Second-order step logs; empty fields are null."""
    rows = spark.read.schema(GN_STEPS).csv(path, header=True, nullValue="", enforceSchema=False)
    return rows.withColumn("run", _own_run())


def append_gn_steps(steps: DataFrame, path: str) -> None:
    """Adds rows as CSV files with a header each; nulls are empty fields."""
    steps.write.mode("append").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_record(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record file of each run under path, with the run's name; fields a file lacks are null."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("run", _own_run())


def run_data(records: DataFrame) -> DataFrame:
    """Data records with the learning grid filled in: n - 1 where none is given."""
    return records.withColumn("s", F.coalesce("s", F.col("n") - 1)).withColumn("n_train", F.col("base.n_train")).withColumn("n_test", F.col("base.n_test"))


def run_files(spark: SparkSession, root: str) -> DataFrame:
    """(run, name, started, file) of the artifacts in run folders named <name>_<seconds>."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = found.select(run_of(F.col("path")).alias("run"), F.regexp_extract("path", "[^/]+$", 0).alias("file"))
    kept = parts.where(F.col("file").isin(*ARTIFACTS) | F.col("file").endswith(".png"))
    return kept.select("run", F.regexp_extract("run", r"^(.*)_(\d+)$", 1).alias("name"), F.regexp_extract("run", r"_(\d+)$", 1).try_cast("long").alias("started"), "file")


def write_normalizer(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("overwrite").json(path)


def read_normalizer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NORMALIZER).json(path)
