"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import stage, unstage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v): each u sends its smallest neighbour to its larger (or smaller) neighbours."""
    if large:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        return around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("low"))
    hung = down.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return hung.union(least.select("u", F.col("low").alias("v")))


def components(spark: SparkSession, edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, label): the smallest node of the component, for every node with an edge in ``edges`` (u, v).

    Every round is two map-side combined minima and two joins; a round's edges are written to the shared
    folder. It ends when the edges form stars, after O(log n) rounds; no node set is ever collected.
    Null ends and loops are ignored.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stage(spark, now, "edges")
    mark = None
    for _ in range(rounds):
        last, now = now, stage(spark, _star(_star(now, True).distinct(), False).distinct(), "edges")
        unstage(spark, last)
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row["n"], row["s"]) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        mark = (row["n"], row["s"])
    raise RuntimeError("components did not settle")
