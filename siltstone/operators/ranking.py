"""Row numbers over a whole table without putting it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.checkpoints import table


def global_row_number(df: DataFrame, *order: str, name: str = "rn") -> DataFrame:
    """Numbers from 1 in the order of the columns.

    Rows are range-partitioned and written once with the number of their
    partition, because a second range exchange would sample other bounds;
    counts and places are then read from that table.  Only the counts (a row a
    partition) are summed up in one place.  Ties get numbers in no fixed order.
    """
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(order)]
    names = [f"k{i}" for i in range(len(order))]
    rows = df.select(F.struct("*").alias("row"), *keys).repartitionByRange(*names)
    parts, _ = table(rows.withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*names))
    numbered = parts.withColumn("k", within).join(F.broadcast(starts), "part")  # one row a partition
    return numbered.select("row.*", (F.col("start") + F.col("k")).alias(name))
