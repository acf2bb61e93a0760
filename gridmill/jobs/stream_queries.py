"""Registered queries that read `events` as a stream and give what the batch query would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.jobs.tables import read
from gridmill.sources.shared import scratch
from gridmill.streaming import epochs, open_runs
from gridmill.streaming.open_runs import state_session

#: Registered by `query`: name -> (function, SQL or None).
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as epochs of their users' runs."""
    # a pattern stands for a file as well as for a folder of files
    rows = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.[p]arquet")
    k = F.get_json_object("props", "$.k").try_cast("double")
    return rows.select(
        F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("train_l2"), (F.col("value") + k).alias("test_l2"),
        F.when(k > 20, k).alias("epoch_time_s"), F.col("ts").cast("timestamp").alias("ts"),
    )


def _written(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """The stream's rows, in the given session, once all files that are there have been read."""
    path = scratch(spark, name)
    q = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch(spark, name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


_E = "e AS (SELECT user_id AS run, event_id AS epoch, value AS train_l2, value + k AS test_l2, CASE WHEN k > 20 THEN k END AS epoch_time_s, ts FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))"


@query(f"WITH {_E}, l AS (SELECT run, 'train_l2' AS key, epoch AS step, train_l2 AS value FROM e UNION ALL SELECT run, 'test_l2', epoch, test_l2 FROM e UNION ALL SELECT run, 'epoch_time_s', epoch, epoch_time_s FROM e) SELECT run, key, step, round(value, 8) AS value FROM l WHERE value IS NOT NULL")
def stream_feed(spark, d):
    got = _written(spark, epochs.feed(_stream(spark, d), "train_l2", "test_l2", "epoch_time_s"), "feed")
    return got.withColumn("value", F.round("value", 8))


@query(f"WITH {_E} SELECT DISTINCT run, 'create' AS kind FROM e WHERE run % 3 <> 0")
def stream_new_runs(spark, d):
    """Runs that are created: those that no table knows, by their state."""
    own = state_session(spark)
    known = read(own, d, "events").where("user_id % 3 = 0").groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("epochs"), F.max("ts").alias("seen"))
    known = known.select("*", *(F.lit(None).cast("double").alias(c) for c in ("best", "last", "seconds")), F.lit(None).cast("int").alias("last_epoch"))
    got = _written(spark, open_runs.followed(_stream(own, d), known), "new-runs")
    return got.where("kind = 'create'").select("run", "kind")


@query(f"WITH {_E} SELECT run, count(*) AS epochs, min(test_l2) AS best, arg_max(test_l2, epoch) AS last, max(epoch) AS last_epoch, round(sum(epoch_time_s), 7) AS seconds FROM e GROUP BY run")
def stream_followed(spark, d):
    """Totals of every run as its state has them after its last rows."""
    got = _written(spark, open_runs.followed(_stream(state_session(spark), d)), "followed").where("kind = 'totals'")
    last = got.groupBy("run").agg(F.max_by(F.struct("epochs", "best", "last", "last_epoch", "seconds"), "epochs").alias("s")).select("run", "s.*")
    return last.withColumn("last_epoch", F.col("last_epoch").cast("long")).withColumn("seconds", F.round("seconds", 7))


@query(f"WITH {_E} SELECT run, count(*) AS epochs, min(test_l2) AS best, arg_max(test_l2, epoch) AS last, round(sum(epoch_time_s), 7) AS seconds FROM e GROUP BY run")
def stream_totals(spark, d):
    path = scratch(spark, "totals")
    rows = epochs.totals(_stream(spark, d))
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v{number}")
        last[:] = [number]

    q = rows.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch(spark, "totals")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(rows.schema).parquet(f"{path}/v{last[0]}") if last else spark.createDataFrame([], rows.schema)
    return got.withColumn("seconds", F.round("seconds", 7))
