"""Connected components of edges, and reachability, as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def min_label_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, component (its least node): labels spread over edges and jump along labels, so rounds grow as the logarithm of the longest path.

    Each round is checkpointed in spark.checkpoint.dir where that is set; without one (tests, small graphs) lineage is cut by a cache.
    """
    keep = (lambda df: df.checkpoint()) if edges.sparkSession.conf.get("spark.checkpoint.dir", None) else (lambda df: df.cache())
    e = keep(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct())
    labels = keep(e.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")))
    for _ in range(most_rounds):
        near = e.join(labels.select(F.col("x").alias("y"), F.col("l").alias("ly")), "y").groupBy("x").agg(F.min("ly").alias("near"))
        new = labels.join(near, "x").select("x", F.least("l", "near").alias("l"))
        jump = new.alias("p").join(new.select(F.col("x").alias("jx"), F.col("l").alias("jl")), F.col("p.l") == F.col("jx"), "left").select("x", F.least("p.l", F.coalesce("jl", "p.l")).alias("l"))
        jump = keep(jump)
        changed = jump.join(labels.withColumnRenamed("l", "was"), "x").where("l <> was").limit(1).count()
        labels = jump
        if not changed:
            return labels.select(F.col("x").alias("node"), F.col("l").alias("component"))
    raise RuntimeError("components did not settle")
