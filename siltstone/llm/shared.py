"""Tables in the folder that the cluster shares, and connected components over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.checkpoints import drop, drop_since, folder, mark, new_path, release, table

__all__ = ["components", "drop", "drop_since", "folder", "mark", "new_path", "release", "table"]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node of the edges (a, b): label is the least node reachable.

    Each round takes the least label among the neighbours and then jumps to the
    label's own label, so long chains shorten geometrically.  All steps are
    joins and minima with map-side combining; a hub's edges may be split over
    tasks.  Rounds are written tables, and older ones are deleted.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both, both_path = table(both)
    labels, path = table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    for _ in range(most_rounds):
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("l").alias("l"))
        )
        low = labels.join(near, "node", "left").select(
            "node", F.least("label", F.coalesce("l", "label")).alias("low"), F.col("label").alias("old")
        )
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("l2"))
        after = low.join(jump, "low", "left").select(
            "node", F.least("low", F.coalesce("l2", "low")).alias("label"), "old"
        )
        after, new_path_ = table(after, free=False)
        changed = after.where(F.col("label") != F.col("old")).limit(1).count()
        drop(spark, path)
        labels, path = after.select("node", "label"), new_path_
        if not changed:
            drop(spark, both_path)
            release(spark)
            return labels
    raise RuntimeError("components did not settle")
