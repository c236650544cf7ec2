"""Key-value records, descriptor caches, vacuuming, digest sets and upload sessions over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "::"


def key(family: str, *parts: Column) -> Column:
    """Key of a record: its family and parts, e.g. ``Slice:Recipe::digest::host``."""
    return F.concat_ws(SEPARATOR, F.lit(family), *parts)


def family(k: Column) -> Column:
    return F.substring_index(k, SEPARATOR, 1)


def latest(log: DataFrame) -> DataFrame:
    """Set: the last value of each key (key, at, value); ties go to the greatest value."""
    return log.groupBy("key").agg(F.max(F.struct("at", "value"))["value"].alias("value"))


def first(log: DataFrame) -> DataFrame:
    """SetNX: the first value of each key, and how many tried."""
    return log.groupBy("key").agg(F.min(F.struct("at", "value"))["value"].alias("value"), F.count(F.lit(1)).alias("tries"))


def stat(asked: DataFrame, members: DataFrame, blobs: DataFrame) -> DataFrame:
    """Descriptors of (repo, digest) pairs: a hit needs the digest in the repository's set; a miss has no size.

    ``members``: repo, digest; ``blobs``: digest, size, each distinct.
    """
    held = members.select("repo", "digest", F.lit(True).alias("held"))
    got = asked.join(held, ["repo", "digest"], "left").join(blobs, "digest", "left")
    hit = F.coalesce("held", F.lit(False))
    return got.select("repo", "digest", hit.alias("hit"), F.when(hit, F.col("size")).alias("size"))


def vacuum(links: DataFrame, blobs: DataFrame, repositories: list[str]) -> DataFrame:
    """Links (repo, digest) that stay when blobs (digest) and whole repositories are removed."""
    rest = links.where(~F.col("repo").isin(*repositories)) if repositories else links
    return rest.join(blobs.select("digest").distinct(), "digest", "left_anti")


def dedup_action(marker: Column, size: Column) -> Column:
    """What happens to a layer: one with a marker is moved as it is, an empty one is left out."""
    return F.when(marker, "move").when(size == 0, "empty").otherwise("dedup")


def digest_set(log: DataFrame) -> DataFrame:
    """Members after all operations (digest, op: add or remove), removal winning; with the number of each."""
    n = lambda op: F.count(F.when(F.col("op") == op, 1))
    got = log.groupBy("digest").agg(F.count(F.lit(1)).alias("added"), n("remove").alias("removed"))
    return got.where("removed = 0")


def uploads(ops: DataFrame) -> DataFrame:
    """State of each upload from its records (upload, op, n, size).

    Patches must be numbered 1, 2, … without gap or repeat for a commit to
    count; a commit without is invalid, and without an end the upload is open.
    Each upload is reduced map-side to a few sums.
    """
    patch = F.col("op") == "patch"
    ended = lambda op: F.max((F.col("op") == op).cast("int")) == 1
    got = ops.groupBy("upload").agg(
        F.sum("size").alias("size"), F.count(F.when(patch, 1)).alias("patches"), F.min(F.when(patch, F.col("n"))).alias("lo"),
        F.max(F.when(patch, F.col("n"))).alias("hi"), F.count_distinct(F.when(patch, F.col("n"))).alias("kinds"),
        ended("commit").alias("committed"), ended("cancel").alias("cancelled"), ended("create").alias("created"),
    )
    whole = (F.col("lo") == 1) & (F.col("hi") == F.col("patches")) & (F.col("kinds") == F.col("patches"))
    state = (
        F.when(F.col("committed"), F.when(F.coalesce(whole, F.lit(False)), "committed").otherwise("invalid"))
        .when(F.col("cancelled"), "cancelled").otherwise("open")
    )
    return got.where("created").select("upload", "size", "patches", state.alias("state"))
