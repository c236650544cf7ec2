"""Event pipelines for streaming frames; each works on a batch frame as well."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

IGNORED_MEDIA = ("error",)


def source(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1) -> DataFrame:
    """A stream of the parquet files in a folder, with event time as a timestamp."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return timed(rows)


def timed(events: DataFrame) -> DataFrame:
    """Watermarks need TIMESTAMP, the tables hold TIMESTAMP_NTZ."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def envelopes(events: DataFrame) -> DataFrame:
    """Push, pull, mount and delete events as nested envelopes."""
    action = F.create_map(*[F.lit(x) for p in (("view", "pull"), ("click", "pull"), ("purchase", "push"), ("signup", "mount"), ("error", "delete")) for x in p])
    return events.select(
        F.col("event_id").cast("string").alias("id"), F.col("ts").alias("timestamp"), action[F.col("event_type")].alias("action"),
        F.struct(F.concat(F.lit("repo"), F.col("user_id") % 10).alias("repository"), F.round(F.col("value") * 100).cast("long").alias("size")).alias("target"),
        F.struct(F.col("user_id").cast("string").alias("name")).alias("actor"),
    )


def without_ignored(events: DataFrame, ignored: tuple[str, ...] = IGNORED_MEDIA) -> DataFrame:
    return events.where(~F.col("event_type").isin(*ignored))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of tumbling or sliding windows; later rows than the watermark are dropped in a stream."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each user that end after a pause: an entry that expires unless it is used again."""
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")
    )


def first_seen(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """Insert-if-absent on the keys; with ``late`` the state is bounded by the watermark."""
    if late:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


class RetryingSink:
    """For foreachBatch: a circuit breaker around a write.

    After ``threshold`` failures in a row the breaker is open: the next try
    waits until ``backoff`` seconds have gone since the last failure.  A success
    closes it.  A batch that fails ``most`` times fails the query, which repeats
    it from its checkpoint.  ``counts`` holds successes, failures, errors by kind
    and batches that are pending.
    """

    def __init__(self, write: Callable[[DataFrame], None], threshold: int = 3, backoff: float = 1.0, most: int = 5, clock=time.monotonic, sleep=time.sleep):
        self.write, self.threshold, self.backoff, self.most, self.clock, self.sleep = write, threshold, backoff, most, clock, sleep
        self.recent, self.last = 0, 0.0
        self.counts = {"success": 0, "failure": 0, "pending": 0}
        self.errors: dict[str, int] = {}

    def open(self) -> bool:
        """Whether the breaker holds writes back now."""
        return self.recent >= self.threshold and self.clock() < self.last + self.backoff

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.counts["pending"] += 1
        for attempt in range(1, self.most + 1):
            if self.open():
                self.sleep(self.last + self.backoff - self.clock())
            try:
                self.write(batch)
            except Exception as e:
                self.recent, self.last = self.recent + 1, self.clock()
                self.counts["failure"] += 1
                self.errors[type(e).__name__] = self.errors.get(type(e).__name__, 0) + 1
                if attempt == self.most:
                    raise
            else:
                self.recent = 0
                self.counts["success"] += 1
                self.counts["pending"] -= 1
                return


def post_envelopes(batch: DataFrame, path: str) -> None:
    """Events of a micro-batch as JSON envelopes of up to a partition each, in a folder that a poster takes them from."""
    rows = batch.groupBy(F.spark_partition_id().alias("p")).agg(F.collect_list(F.struct("*")).alias("events"))
    rows.select(F.to_json(F.struct("events")).alias("value")).write.mode("append").text(path)


def running_pulls(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Pulls of each repository so far, as a stream's state or of a batch."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.where(F.col("event_type").isin("view", "click")).groupBy(F.concat(F.lit("repo"), F.col("user_id") % 10).alias("repo")).agg(F.count(F.lit(1)).alias("pulls"))


def fan_out(batch: DataFrame, batch_id: int, sinks: list[Callable[[DataFrame, int], None]]) -> None:
    """Writes one micro-batch to several sinks; the batch is computed once."""
    batch.persist()
    try:
        for s in sinks:
            s(batch, batch_id)
    finally:
        batch.unpersist()
