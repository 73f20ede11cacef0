"""Connected components of an edge table, by large-star and small-star steps in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_anew


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Point each node's neighbours at its least neighbour: the larger ones, or the smaller ones and itself.

    Least neighbours come from partial sums, and the join on a hot node is one that Spark may split."""
    if small:
        own = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        own = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = own.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
    met = own.join(least, F.col("u") == F.col("w"))
    if not small:
        return met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    made = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    # Dealt anew: as the join left them, a star's edges lie with its centre.
    return made.where("u <> v").repartition("u", "v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node either has one edge, to a smaller node, or is such a centre."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the component's least node."""
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(now):
        now = cut_anew(_star(_star(now, small=False), small=True), now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
