"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.common import saved


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest neighbour."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    ties = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return ties.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest node reachable from each node of the edges (a, b): columns id, label.

    Rounds double the reach, each written to the shared folder; a node with a third of all edges is
    only ever met in an aggregated minimum and in joins that can be split. No edges give no rows."""
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    seen = None
    while True:
        size = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if size == seen or not size[0]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(
                now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
            )
        seen = size
        now = saved(_small(_large(now)), name)
