"""Request traces: mapping to files, capping, replay plans and latency statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.ranking import global_row_number


def requests(events: DataFrame) -> DataFrame:
    """Events as registry requests."""
    kind = F.when(F.col("event_type") == "error", "manifests").otherwise("blobs")
    return events.select(
        "event_id", "ts", "user_id", "event_type",
        F.when(F.col("event_type").isin("view", "click", "error"), "GET").otherwise("PUT").alias("method"),
        F.concat(F.lit("repo"), F.col("user_id") % 10).alias("repo"),
        F.concat(F.lit("v2/repo"), F.col("user_id") % 10, F.lit("/"), kind, F.lit("/"), F.regexp_extract("props", r'"k": ([0-9]+)', 1)).alias("uri"),
        F.round(F.col("value") * 100).cast("long").alias("written"),
        F.col("value").alias("duration"),
    )


def map_to_files(reqs: DataFrame, files: DataFrame, min_size: int) -> DataFrame:
    """Blob reads larger than ``min_size`` joined to the least path of their size."""
    by_size = files.groupBy("size").agg(F.min("path").alias("path"))
    wanted = reqs.where((F.col("method") == "GET") & F.col("uri").like("%blobs%") & (F.col("written") > min_size))
    return wanted.join(by_size, wanted["written"] == by_size["size"]).select("event_id", "uri", "written", "path")


def cap_per_size(reqs: DataFrame, most: int) -> DataFrame:
    """The first most + 1 requests of each size (the counter starts at 0)."""
    w = Window.partitionBy("written").orderBy("event_id")
    return reqs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most + 1).select("event_id", "written", "rn")


def delays(reqs: DataFrame) -> DataFrame:
    """Microseconds since the first request; the minimum is one broadcast row."""
    first = reqs.agg(F.min("ts").alias("t0"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return reqs.crossJoin(F.broadcast(first)).select("event_id", (micros("ts") - micros("t0")).alias("delay_us"))


def limit_seconds(reqs: DataFrame, seconds: int) -> DataFrame:
    return delays(reqs).where(F.col("delay_us") <= seconds * 1_000_000)


def limit_requests(reqs: DataFrame, most: int) -> DataFrame:
    """The first requests by time: the limit is the feature."""
    return reqs.orderBy("ts", "event_id").limit(most).select("event_id")


def replay_stats(responses: DataFrame) -> DataFrame:
    """ok and failed counts, span, bytes, mean latency, on-time share, throughput.

    ``responses``: time, duration (seconds), on_time (yes, no, failed), size.
    """
    ok = F.col("on_time") != "failed"
    span = F.max(F.when(ok, F.col("time") + F.col("duration"))) - F.min("time")
    n = F.sum(F.when(ok, 1).otherwise(0))
    return responses.agg(
        n.alias("successful"), F.sum(F.when(ok, 0).otherwise(1)).alias("failed"), F.round(span, 3).alias("duration"),
        F.sum(F.when(ok, F.col("size"))).alias("bytes"), F.round(F.avg(F.when(ok, F.col("duration"))), 6).alias("avg_latency"),
        F.round(F.avg(F.when(ok, (F.col("on_time") == "yes").cast("double"))), 6).alias("on_time"),
        F.round(n / span, 6).alias("throughput"),
    )


def warmup(reqs: DataFrame) -> DataFrame:
    """First request of each uri."""
    f = F.min(F.struct("event_id", "written"))
    return reqs.groupBy("uri").agg(f.alias("f")).select("uri", "f.event_id", "f.written")


def warmup_size(reqs: DataFrame) -> DataFrame:
    """Bytes of the distinct uris, bytes stored if equal sizes are one blob, and their ratio."""
    w = warmup(reqs)
    sizes = w.groupBy("written").agg(F.count(F.lit(1)).alias("n"))
    got = sizes.agg(F.sum(F.col("n") * F.col("written")).alias("warmup_bytes"), F.sum("written").alias("stored_bytes"))
    return got.withColumn("ratio", F.round(F.col("warmup_bytes") / F.col("stored_bytes"), 6))


def replay_plan(reqs: DataFrame, known: DataFrame, clients: int) -> DataFrame:
    """GET for known uris, PUT for others, nothing for bad ones; clients in turn.

    ``known``: uri, digest or 'bad'.
    """
    j = reqs.join(known, "uri", "left").where(F.coalesce(F.col("digest"), F.lit("")) != "bad")
    j = j.select("event_id", F.when(F.col("digest").isNull(), "PUT").otherwise("GET").alias("verb"))
    return global_row_number(j, "event_id").select("event_id", "verb", ((F.col("rn") - 1) % clients).alias("client"))


def pacing(reqs: DataFrame) -> DataFrame:
    """Microseconds that each client waits from its last request, or from the start of the trace, to its next."""
    w = Window.partitionBy("client").orderBy("delay_us", "event_id")
    rows = delays(reqs).join(reqs.select("event_id", "client"), "event_id")
    return rows.select("event_id", "client", (F.col("delay_us") - F.coalesce(F.lag("delay_us").over(w), F.lit(0))).alias("wait_us"))


def pulls(reqs: DataFrame) -> DataFrame:
    return reqs.where("method = 'GET'").groupBy("repo", "uri").agg(F.count(F.lit(1)).alias("pulls"))


def merge_good_wins(maps: DataFrame) -> DataFrame:
    """One digest a uri over several maps; any good one beats 'bad'."""
    good = F.min(F.when(F.col("digest") != "bad", F.col("digest")))
    return maps.groupBy("uri").agg(F.coalesce(good, F.lit("bad")).alias("digest"))


def assign_slots(reqs: DataFrame, slots: int, key: str = "repo") -> DataFrame:
    """Start of each request on the least delayed of ``slots`` workers of its key, in order of time.

    Greedy and sequential within a key; a key's requests are handled in one
    task, so keys should be clients rather than the whole trace.
    """
    import heapq

    def run(pdf):
        pdf = pdf.sort_values(["t", "event_id"])
        free = [(0.0, i) for i in range(slots)]
        out = []
        for e, t, d in zip(pdf["event_id"], pdf["t"], pdf["duration"]):
            at, i = heapq.heappop(free)
            start = max(at, t)
            heapq.heappush(free, (start + d, i))
            out.append((e, i, start))
        import pandas as pd

        return pd.DataFrame(out, columns=["event_id", "slot", "start"])

    rows = reqs.select(key, "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "duration")
    return rows.groupBy(key).applyInPandas(run, "event_id long, slot int, start double")
