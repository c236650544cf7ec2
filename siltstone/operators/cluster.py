"""Connected components, leader clustering and k-means."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.checkpoints import drop, table


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(vec_id, cluster): least id reachable over the edges (a, b); a node without edges is its own.

    With a minimum of one sample every point of DBSCAN is a core point, so its
    clusters are the components of the graph of pairs within epsilon.  Each
    round takes the neighbours' least label and then the label's label.
    """
    spark = nodes.sparkSession
    both, both_path = table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), free=False)
    labels, path = table(nodes.select("vec_id", F.col("vec_id").alias("cluster")), free=False)
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["vec_id"]).groupBy("a").agg(F.min("cluster").alias("near"))
        low = labels.join(near, labels["vec_id"] == near["a"], "left").select(
            "vec_id", F.col("cluster").alias("old"), F.least("cluster", F.coalesce("near", "cluster")).alias("low")
        )
        jump = labels.select(F.col("vec_id").alias("low"), F.col("cluster").alias("far"))
        after, new_path = table(low.join(jump, "low", "left").select("vec_id", "old", F.least("low", F.coalesce("far", "low")).alias("cluster")), free=False)
        changed = after.where("cluster <> old").limit(1).count()
        drop(spark, path)
        labels, path = after.select("vec_id", "cluster"), new_path
        if not changed:
            drop(spark, both_path)
            return labels
    raise RuntimeError("components did not settle")


def leader_clusters(hashes: DataFrame, radius: int, block: int = 4096) -> DataFrame:
    """Leader clustering in order of id: a vector joins the nearest earlier representative
    within ``radius`` (ties: the least id), else it founds a cluster.

    Rows go in blocks of ids.  A block first meets the written table of
    representatives found so far by an equi-join on bands (radius + 1 of them,
    one must be equal); what is left founds clusters among itself in one task
    of at most ``block`` rows.  So the order is sequential by block, work within a
    block is distributed, and no group has to fit into one task.
    """
    import numpy as np
    import pandas as pd

    from siltstone.operators.ranking import global_row_number
    from siltstone.operators.similarity import bands, hamming

    spark = hashes.sparkSession
    numbered, numbered_path = table(
        global_row_number(hashes.select("vec_id", "w0", "w1"), "vec_id").withColumn("blk", F.floor((F.col("rn") - 1) / block))
    )

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        words, ids = pdf[["w0", "w1"]].to_numpy().astype(np.uint64), pdf["vec_id"].to_numpy()
        near, far = pdf["near"].to_numpy(), pdf["dist"].to_numpy()
        reps: list[int] = []
        out = []
        for i in range(len(pdf)):
            d = np.bitwise_count(words[reps] ^ words[i]).sum(axis=1) if reps else np.empty(0, int)
            best = int(d.argmin()) if len(d) and d.min() <= radius else -1
            if far[i] <= radius and (best < 0 or far[i] <= d[best]):
                out.append(int(near[i]))
            elif best >= 0:
                out.append(int(ids[reps[best]]))
            else:
                reps.append(i)
                out.append(int(ids[i]))
        return pd.DataFrame({"vec_id": ids, "cluster": out, "w0": pdf["w0"], "w1": pdf["w1"]})

    schema = "vec_id long, cluster long, w0 long, w1 long"
    done: DataFrame | None = None
    for b in range((numbered.agg(F.max("blk")).first()[0] or 0) + 1):
        mine = numbered.where(F.col("blk") == b).select("vec_id", "w0", "w1")
        if done is None:
            rows = mine.select("*", F.lit(-1).cast("long").alias("near"), F.lit(999).alias("dist"))
        else:
            x = mine.withColumn("k", F.explode(bands(radius))).alias("a")
            y = done.where("vec_id = cluster").withColumn("k", F.explode(bands(radius))).alias("b")
            d = hamming("a", "b")
            best = x.join(y, F.col("a.k") == F.col("b.k")).where(d <= radius).groupBy(F.col("a.vec_id").alias("vec_id")).agg(
                F.min(F.struct(d.alias("dist"), F.col("b.vec_id").alias("near"))).alias("m")
            )
            rows = mine.join(best, "vec_id", "left").select(
                "vec_id", "w0", "w1", F.coalesce("m.near", F.lit(-1)).alias("near"), F.coalesce("m.dist", F.lit(999)).alias("dist")
            )
        part, _ = table(rows.groupBy(F.lit(b).alias("blk")).applyInPandas(found, schema))
        done = part if done is None else done.unionByName(part)
    drop(spark, numbered_path)
    return done.select("vec_id", "cluster")


def kmeans(vectors: DataFrame, k: int, seed: int = 0, init: str = "k-means||") -> DataFrame:
    """vec_id and cluster; ``init`` is ``k-means||`` or ``random``."""
    rows = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, initMode=init, featuresCol="features", predictionCol="cluster").fit(rows)
    return model.transform(rows).select("vec_id", "cluster")


def kmeans_report(vectors: DataFrame, k: int, slack: float = 1.1) -> DataFrame:
    """Vectors, clusters, and vectors whose squared distance to another cluster's mean is ``slack`` times smaller than to their own."""
    rows, _ = table(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).join(kmeans(vectors, k), "vec_id"))
    means = rows.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x"))
    means = means.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    far = F.aggregate(F.zip_with("v", "c.m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    all_means = means.agg(F.collect_list(F.struct("cluster", "m")).alias("all"))  # k means in one row
    each = rows.crossJoin(F.broadcast(all_means)).select("vec_id", "cluster", "v", F.explode("all").alias("c"))
    best = each.select("vec_id", far.alias("d"), (F.col("c.cluster") == F.col("cluster")).alias("own")).groupBy("vec_id").agg(
        F.min(F.when(F.col("own"), F.col("d"))).alias("own"), F.min(F.when(~F.col("own"), F.col("d"))).alias("other")
    )
    n = means.agg(F.count(F.lit(1)).alias("clusters"))
    return best.agg(F.count(F.lit(1)).alias("vectors"), F.sum((F.col("other") * slack < F.col("own")).cast("long")).alias("misplaced")).crossJoin(n).select("vectors", "clusters", "misplaced")
