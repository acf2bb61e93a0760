"""Field tables: one row a sample, its values flattened row by row in an array column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _require(df: DataFrame, bad: Column, message: str) -> None:
    """Raises with the first offending row, if any."""
    row = df.where(bad).limit(1).collect()
    if row:
        raise ValueError(f"{message}: {row[0].asDict()}")


def strided(values: Column | str, step: int, width: int | None = None) -> Column:
    """Every step-th point of each axis from the first on; width: row length of a 2D field."""
    if step < 1:
        raise ValueError(f"a step of {step}")
    if width is None:
        return F.filter(values, lambda x, i: i % step == 0)
    return F.filter(values, lambda x, i: (F.floor(i / width) % step == 0) & (i % width % step == 0))


def points_left(points: int, step: int) -> int:
    """Points of an axis that a stride keeps."""
    return -(-points // step)


def line_points(step: int, points: int = 8192) -> int:
    """Points of the one-dimensional set at a stride."""
    return points // step


def plane_points(step: int, points: int = 421) -> int:
    """Points a side of the two-dimensional set at a stride, both ends kept."""
    return (points - 1) // step + 1


def check_points(df: DataFrame, values: str, expected: int) -> DataFrame:
    """df, or an error if a field has another number of points (a null field has none)."""
    _require(df.select("sample", F.size(values).alias("points")), F.coalesce(F.col("points"), F.lit(-1)) != expected, f"a field without {expected} points")
    return df


def first_and_last(df: DataFrame, n_train: int, n_test: int) -> DataFrame:
    """First n_train samples as train and last n_test as test, in column split."""
    total = df.count()
    if n_train + n_test > total:
        raise ValueError(f"{n_train} + {n_test} of {total} samples")
    split = F.when(F.col("sample") < n_train, "train").when(F.col("sample") >= total - n_test, "test")
    return df.withColumn("split", split).where(F.col("split").isNotNull())


def prefixes(df: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """First wanted[split] samples of each split."""
    have = {r.split: r["count"] for r in df.where(F.col("split").isin([*wanted])).groupBy("split").count().collect()}
    for split, n in wanted.items():
        if n > have.get(split, 0):
            raise ValueError(f"{n} of {have.get(split, 0)} samples of {split}")
    rule = F.lit(False)
    for split, n in wanted.items():
        rule = rule | ((F.col("split") == split) & (F.col("sample") < n))
    return df.where(rule)


def raw_field(df: DataFrame, field: str, n: int, k: int, split: str, count: int) -> DataFrame:
    """First samples of one field on its own grid: partitions, rows and the one column are pruned."""
    return df.where((F.col("n") == n) & (F.col("k") == k) & (F.col("split") == split) & (F.col("sample") < count)).select("sample", field)


def check_shape(df: DataFrame, values: str, side: int, count: int) -> DataFrame:
    """df, or an error if it has under count samples or a field that isn't side by side."""
    row = df.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size(values), F.lit(-1)) != side * side).alias("bad")).first()
    if row.bad or row.n < count:
        raise ValueError(f"{row.bad} fields are not {side} x {side}; {row.n} of {count} samples")
    return df


def node_gap(nodes: DataFrame, axis: str, n: int, *keys: str) -> DataFrame:
    """(keys, gap): largest distance of each row's stored nodes from the n Chebyshev nodes, over rows
    of equal keys; NaN if one is NaN, missing or beyond the n."""
    grid = nodes_table(nodes.sparkSession, n).agg(F.array_sort(F.collect_list("x")).alias("_grid"))
    nan = F.lit(float("nan"))
    gaps = F.zip_with(axis, "_grid", lambda v, x: F.abs(F.coalesce(v, nan) - F.coalesce(x, nan)))
    each = nodes.crossJoin(F.broadcast(grid)).select(*keys, F.coalesce(F.array_max(gaps), nan).alias("gap"))
    return each.groupBy(*keys).agg(F.max("gap").alias("gap"))


def check_nodes(nodes: DataFrame, axis: str, n: int, within: float = 1e-14) -> DataFrame:
    """nodes, or an error if one is further off, missing or NaN."""
    gap = node_gap(nodes, axis, n).first().gap
    if gap is None or not gap <= within:
        raise ValueError(f"{axis} is not the grid of {n} nodes: off by {gap}")
    return nodes


def nodes_table(spark, n: int) -> DataFrame:
    """(j, x): the n Chebyshev nodes."""
    return spark.range(n).select(F.col("id").cast("int").alias("j"), F.sin(F.lit(3.141592653589793) * (2 * F.col("id") - (n - 1)) / (2 * (n - 1))).alias("x"))


def uniform_table(spark, s: int) -> DataFrame:
    """(j, x): s equally spaced nodes on [-1, 1]."""
    return spark.range(s).select(F.col("id").cast("int").alias("j"), (-1 + 2 * F.col("id") / (s - 1)).alias("x"))


def weights_table(spark, n: int) -> DataFrame:
    """(j, w): Clenshaw-Curtis weights of n nodes, from their cosine sum."""
    last, half = n - 1, (n - 1) // 2
    j, k = spark.range(n).withColumnRenamed("id", "j"), spark.range(1, half + 1).withColumnRenamed("id", "k")
    b = F.when(2 * F.col("k") == last, 1.0).otherwise(2.0)
    term = b / (4 * F.col("k") * F.col("k") - 1) * F.cos(F.lit(2 * 3.141592653589793) * F.col("j") * F.col("k") / last)
    ends = F.when(F.col("j").isin(0, last), 1.0).otherwise(2.0)
    # two tables of n rows each
    return j.crossJoin(k).groupBy("j").agg(F.sum(term).alias("t")).select(F.col("j").cast("int").alias("j"), (ends / last * (1 - F.col("t"))).alias("w"))


def with_channel(df: DataFrame, values: str) -> DataFrame:
    """Adds the channel axis to shape and rounds the values once, to single precision."""
    return df.withColumn("shape", F.concat("shape", F.array(F.lit(1)))).withColumn(values, F.col(values).cast("array<float>"))


def with_coordinates(values: Column | str, height: int, width: int) -> Column:
    """For each point [value, x_2, x_1] with coordinates on [0, 1], 0 along an axis of one point."""
    y = lambda i: (i % width / (width - 1)) if width > 1 else F.lit(0.0)
    x = lambda i: (F.floor(i / width) / (height - 1)) if height > 1 else F.lit(0.0)
    return F.transform(values, lambda v, i: F.array(v, y(i).cast("double"), x(i).cast("double")))


def one_sided(inputs: DataFrame, targets: DataFrame) -> DataFrame:
    """Samples that only one of the tables has."""
    a, b = inputs.select("sample", F.lit(True).alias("has_input")), targets.select("sample", F.lit(True).alias("has_target"))
    return a.join(b, "sample", "full").where(F.col("has_input").isNull() | F.col("has_target").isNull())


def pairs(inputs: DataFrame, targets: DataFrame) -> DataFrame:
    """Inputs joined to targets, or an error if a sample lacks either."""
    _require(one_sided(inputs, targets), F.lit(True), "a sample without a partner")
    return inputs.join(targets, "sample")


def long_form(df: DataFrame, values: str, *keep: str, width: int | None = None) -> DataFrame:
    """A row a point: pos, and i and j where the row length is given."""
    out = df.select(*keep, F.posexplode(values).alias("pos", "value"))
    if width is None:
        return out
    return out.select(*keep, F.floor(F.col("pos") / width).cast("int").alias("i"), (F.col("pos") % width).alias("j"), "pos", "value")


def array_form(points: DataFrame, *keys: str) -> DataFrame:
    """Back from a row a point to an array a sample."""
    packed = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return points.groupBy(*keys).agg(packed.alias("p")).select(*keys, F.transform("p", lambda p: p["value"]).alias("values"))


def common_nodes(coarse: DataFrame, fine: DataFrame, n: int, factor: int) -> DataFrame:
    """Samples whose coarse values are the fine ones at the shared nodes, point by point.

    n: nodes a side of the coarse grid; the fine one has factor * (n - 1) + 1."""
    wide = factor * (n - 1) + 1
    thinned = fine.select("sample", strided("values", factor, wide).alias("values"))
    a, b = long_form(coarse, "values", "sample"), long_form(thinned, "values", "sample").withColumnRenamed("value", "fine")
    return a.join(b, ["sample", "pos"]).groupBy("sample").agg(F.max(F.abs(F.col("value") - F.col("fine"))).alias("gap"))
