"""Placement of chunks over servers: consistent hashing and least loaded first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ring_position(key: Column) -> Column:
    """32 bits of the key's md5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def ring_placement(keys: DataFrame, servers: DataFrame, points: int = 8) -> DataFrame:
    """Server of each key: the owner of the first ring point at or after the key's hash, else of the first.

    ``keys``: key; ``servers``: server.  Positions are dealt over slots of the
    ring; in a slot, points and keys are sorted together and each key takes the
    next point, and what a slot has none for goes to the first point of the
    next slot that has one (a row a slot).  So neither side is broadcast, and
    a large ring costs no more a key than a small one.
    """
    ring = servers.select("server", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).select(
        ring_position(F.concat("server", F.lit("#"), F.col("i").cast("string"))).alias("pos"), "server"
    )
    slot = F.shiftright("pos", 32 - SLOT_BITS).cast("int")
    hashed = keys.select(ring_position(F.col("key")).alias("pos"), "key")
    both = ring.select("pos", F.lit(1).alias("mark"), "server", F.lit(None).cast(keys.schema["key"].dataType).alias("key")).unionByName(
        hashed.select("pos", F.lit(0).alias("mark"), F.lit(None).cast("string").alias("server"), "key")
    ).withColumn("slot", slot)
    # the next point at or after: keys sort before points of their position
    ahead = Window.partitionBy("slot").orderBy("pos", "mark", "server").rowsBetween(0, Window.unboundedFollowing)
    placed = both.withColumn("owner", F.first("server", ignorenulls=True).over(ahead)).where("mark = 0")
    firsts = ring.withColumn("slot", slot).groupBy("slot").agg(F.min(F.struct("pos", "server"))["server"].alias("first"))
    every = servers.sparkSession.range(1 << SLOT_BITS).select(F.col("id").cast("int").alias("slot"))
    later = Window.orderBy("slot").rowsBetween(1, Window.unboundedFollowing)  # 2 ** SLOT_BITS rows
    around = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = every.join(firsts, "slot", "left").select(
        "slot", F.coalesce(F.first("first", ignorenulls=True).over(later), F.first("first", ignorenulls=True).over(around)).alias("next")
    )
    return placed.join(F.broadcast(after), "slot").select("key", F.coalesce("owner", "next").alias("server"))


#: The ring is worked off in 2 ** SLOT_BITS slots, a fixed number of rows wherever they are broadcast.
SLOT_BITS = 12


def least_loaded(
    files: DataFrame, servers: list[str], layer: str = "layer", seeds: DataFrame | None = None, local: str | None = None,
    least_files: int = 0, least_bytes: int = 0,
) -> DataFrame:
    """Largest file first to the server with the least load so far, layer by layer (ties: name of the server, then of the file).

    ``files``: layer, file, size.  ``seeds``: layer, server, load that is there
    already.  With ``local``, a layer whose files do not exceed both ``least_files``
    and ``least_bytes`` stays on that server whole.  A layer's files are placed
    in one task: a layer is bounded by what a registry accepts.
    """
    import heapq

    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if local is not None and not (len(pdf) > least_files and pdf["size"].sum() > least_bytes):
            return pd.DataFrame({"layer": pdf["layer"], "file": pdf["file"], "size": pdf["size"], "server": local})
        first = pdf["seeds"].iloc[0]
        start = {x["server"]: int(x["load"]) for x in first} if first is not None else {}
        load = [(start.get(s, 0), s) for s in sorted(servers)]
        heapq.heapify(load)
        out = []
        for lay, f, n in pdf.sort_values(["size", "file"], ascending=[False, True])[["layer", "file", "size"]].itertuples(index=False):
            used, s = heapq.heappop(load)
            heapq.heappush(load, (used + n, s))
            out.append((lay, f, n, s))
        return pd.DataFrame(out, columns=["layer", "file", "size", "server"])

    rows = files.select(F.col(layer).alias("layer"), "file", "size")
    if seeds is None:
        rows = rows.withColumn("seeds", F.lit(None).cast("array<struct<server:string,load:bigint>>"))
    else:
        held = seeds.groupBy("layer").agg(F.collect_list(F.struct("server", "load")).alias("seeds"))
        rows = rows.join(held, "layer", "left")
    return rows.groupBy("layer").applyInPandas(run, "layer long, file long, size long, server string")


def moved_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys whose server changes when the members change."""
    a = before.select("key", F.col("server").alias("old"))
    return a.join(after.select("key", F.col("server").alias("new")), "key").where("old <> new")


def routes(keys: DataFrame, servers: DataFrame, replicas: int, here: str) -> DataFrame:
    """Number of distinct servers that hold each key, and whether ``here`` is one of them or must ask the master.

    Replica i is the ring's owner of the key salted with i.
    """
    salted = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("c")).select(F.concat_ws("@", "key", F.col("c").cast("string")).alias("key"))
    held = ring_placement(salted, servers).select(F.substring_index("key", "@", 1).alias("key"), "server").distinct()
    return held.groupBy("key").agg(
        F.count(F.lit(1)).alias("replicas"), F.when(F.max((F.col("server") == here).cast("int")) == 1, "local").otherwise("master").alias("route")
    )
