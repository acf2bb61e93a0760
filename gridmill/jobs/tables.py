"""The given tables as field and run tables, and the SQL views of the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: An embedding of 64 numbers is a field on 8 x 8 nodes.
SIDE = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, label, values): every embedding as a field."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), "label", F.col("embedding").cast("array<double>").alias("values"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, label, values, pred): a field beside one that is off by a known rule."""
    off = F.transform("values", lambda x, i: x + (i % 5 - 2) * 0.01 * (1 + F.col("sample") % 7))
    return fields(spark, sf_dir).withColumn("pred", off)


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, epoch, ...): a user's events in order as the epochs of a run."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    k = F.get_json_object("props", "$.k").try_cast("int")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", F.row_number().over(order).alias("epoch"), "event_type", "value", k.alias("k"), "ts")
    return rows.withColumn("train_l2", F.col("value") / 100).withColumn("test_l2", F.col("value") / 100 + F.col("k") / 1000).withColumn("epoch_time_s", F.when(F.col("k") % 9 != 0, F.col("k") / 10))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, epoch, ...): a row a run: its last epoch, with settings that follow from its number."""
    from gridmill.operators.runs import last_epoch

    last = last_epoch(epochs(spark, sf_dir), "epoch", "train_l2", "test_l2", "k", "value")
    return last.select(
        "*", (F.col("run") % 3 * 4).alias("padding"), F.element_at(F.array(*map(F.lit, (16, 32, 64, 128))), (F.col("run") % 4 + 1).cast("int")).alias("s"),
        (F.lit(25) * F.pow(F.lit(2.0), (F.col("run") % 5).cast("double"))).cast("int").alias("n"), (F.col("run") % 7).alias("seed"),
        F.when(F.col("run") % 6 != 0, F.col("run") % 2).alias("subset_seed"), F.concat(F.lit("m"), F.col("k") % 3).alias("peak"),
        F.when(F.col("k") % 4 != 0, F.col("k") * 1000).alias("num_params"),
        F.element_at(F.array(F.lit("adam"), F.lit("gn"), F.lit("hybrid"), F.lit(None).cast("string")), (F.col("run") % 4 + 1).cast("int")).alias("optimizer"),
        (F.lit(20) + F.col("run") % 2 * 180).alias("batch_size"), (F.col("run") % 5 == 0).alias("diagonal"),
    )


FIELDS = "f AS (SELECT vec_id AS sample, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
POINTS = FIELDS + ", p AS (SELECT sample, label, unnest(range(len(v))) AS pos, unnest(v) AS x FROM f)"
PREDICTED = POINTS + ", e AS (SELECT *, x + (pos % 5 - 2) * 0.01 * (1 + sample % 7) AS y FROM p)"
EPOCHS = """m AS (SELECT *, value / 100 AS train_l2, value / 100 + k / 1000 AS test_l2, CASE WHEN k % 9 <> 0 THEN k / 10 END AS epoch_time_s FROM (
  SELECT user_id AS run, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, event_type, value, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts FROM events))"""
RUNS = EPOCHS + """, r AS (SELECT run, epoch, train_l2, test_l2, k, value, run % 3 * 4 AS padding, [16, 32, 64, 128][run % 4 + 1] AS s, CAST(25 * power(2, run % 5) AS INTEGER) AS n, run % 7 AS seed,
  CASE WHEN run % 6 <> 0 THEN run % 2 END AS subset_seed, 'm' || (k % 3) AS peak, CASE WHEN k % 4 <> 0 THEN k * 1000 END AS num_params,
  ['adam', 'gn', 'hybrid', NULL][run % 4 + 1] AS optimizer, 20 + run % 2 * 180 AS batch_size, run % 5 = 0 AS diagonal
  FROM m QUALIFY row_number() OVER (PARTITION BY run ORDER BY epoch DESC) = 1)"""
# nodes and weights of 8 Chebyshev nodes, and the matrices to and from 6 uniform ones
GRID = """
c AS (SELECT j, sin(pi() * (2 * j - 7) / 14) AS x FROM (SELECT unnest(range(8)) AS j)),
u AS (SELECT j, -1 + 2.0 * j / 5 AS x FROM (SELECT unnest(range(6)) AS j)),
w AS (SELECT j, CASE WHEN j IN (0, 7) THEN 1.0 ELSE 2.0 END / 7 * (1 - sum(2.0 / (4 * k * k - 1) * cos(2 * pi() * j * k / 7))) AS w FROM (SELECT unnest(range(8)) AS j), (SELECT unnest(range(1, 4)) AS k) GROUP BY j),
cw AS (SELECT j, x, CASE WHEN j % 2 = 0 THEN 1.0 ELSE -1.0 END * CASE WHEN j IN (0, 7) THEN 0.5 ELSE 1.0 END AS b FROM c),
down0 AS (SELECT u.j AS i, cw.j AS k, abs(u.x - cw.x) < 1e-14 AS hit, CASE WHEN abs(u.x - cw.x) < 1e-14 THEN 0 ELSE b / (u.x - cw.x) END AS t FROM u, cw),
down AS (SELECT i, k, CASE WHEN bool_or(hit) OVER (PARTITION BY i) THEN CASE WHEN hit THEN 1.0 ELSE 0.0 END ELSE t / sum(t) OVER (PARTITION BY i) END AS c FROM down0),
starts AS (SELECT k.j AS k, i.j AS i FROM u k, u i WHERE i.j BETWEEN greatest(0, k.j - 2) AND least(k.j, 3)),
uw AS (SELECT k AS j, sum(term) AS b FROM (SELECT k, i, CASE WHEN i % 2 = 0 THEN 1.0 ELSE -1.0 END / product(a.x - o.x) AS term FROM starts JOIN u a ON a.j = k JOIN u o ON o.j BETWEEN i AND i + 2 AND o.j <> k GROUP BY k, i) GROUP BY k),
up0 AS (SELECT c.j AS i, u.j AS k, abs(c.x - u.x) < 1e-14 AS hit, CASE WHEN abs(c.x - u.x) < 1e-14 THEN 0 ELSE uw.b / (c.x - u.x) END AS t FROM c, u JOIN uw USING (j)),
up AS (SELECT i, k, CASE WHEN bool_or(hit) OVER (PARTITION BY i) THEN CASE WHEN hit THEN 1.0 ELSE 0.0 END ELSE t / sum(t) OVER (PARTITION BY i) END AS c FROM up0)"""
