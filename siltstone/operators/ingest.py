"""Ingest rules: modes, validation, insert-if-absent, upload state, logs and recipe bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_raw(layers: DataFrame, warmup: int = 200, factor: float = 1.1) -> DataFrame:
    """After the first ``warmup`` layers of a repository, layers whose stored size is more than ``factor`` times the compressed one.

    ``layers``: repo, seq, stored, compressed.
    """
    w = Window.partitionBy("repo").orderBy("seq")
    return layers.withColumn("n", F.row_number().over(w)).where((F.col("n") > warmup) & (F.col("stored") > factor * F.col("compressed")))


def few_layers(layers: DataFrame, k: int) -> DataFrame:
    """Layers of repositories that hold fewer than ``k``."""
    small = layers.groupBy("repo").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") < k).select("repo")
    return layers.join(small, "repo", "left_semi")


def valid_descriptor(digest: Column, size: Column, media_type: Column) -> Column:
    return digest.rlike("^sha256:[0-9a-f]{64}$") & (size >= 0) & (media_type != "")


def verified(digest: Column, payload: Column) -> Column:
    """Whether a well-formed digest is that of the payload."""
    return digest.rlike("^sha256:[0-9a-f]{64}$") & (F.substring_index(digest, ":", -1) == F.sha2(payload, 256))


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows that an insert-if-absent adds: the first of each key that the table lacks."""
    new = rows.join(table.select(key).distinct(), key, "left_anti")
    rest = [c for c in rows.columns if c not in (key, order)]
    first = F.min(F.struct(order, *rest)).alias("f")
    return new.groupBy(key).agg(first).select(key, "f.*")


def resume_state(states: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored hash state at exactly the wanted offset of an upload, and the highest one at or before it."""
    exact = wanted.join(states.select("upload", F.col("at").alias("offset"), F.col("state").alias("exact")), ["upload", "offset"], "left")
    before = wanted.join(states, "upload", "left").where(F.col("at") <= F.col("offset"))
    best = before.groupBy("upload", "offset").agg(F.max(F.struct("at", "state"))["state"].alias("nearest"))
    return exact.join(best, ["upload", "offset"], "left")


def recipe_bits(offset: Column, size: Column, ref: Column, flag: Column) -> tuple[Column, Column]:
    """The 82 bits offset 40, size 12, ref 28, flag 2 as a high and a low long (42 and 40 bits)."""
    high = F.shiftleft(size.cast("long"), 30).bitwiseOR(F.shiftleft(ref.cast("long"), 2)).bitwiseOR(flag.cast("long"))
    return high, offset.cast("long")


def recipe_fields(high: Column, low: Column) -> dict[str, Column]:
    mask = lambda n: F.lit((1 << n) - 1).cast("long")
    return {
        "offset": low, "size": F.shiftright(high, 30).bitwiseAND(mask(12)),
        "ref": F.shiftright(high, 2).bitwiseAND(mask(28)), "flag": high.bitwiseAND(mask(2)),
    }


def parse_log(lines: DataFrame) -> DataFrame:
    """key:value pairs of operation log lines (column ``value``) as a map, with the operation."""
    pairs = F.regexp_extract_all("value", F.lit(r"(\w+):(\S+)"), 0)
    return lines.select(
        F.regexp_extract("value", r"^(\w+)", 1).alias("op"),
        F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, ":", 1), F.regexp_replace(p, r"^\w+:", "")))).alias("fields"),
    )


def best_reference(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """For each item the earlier one with the least cost, unless its own cost is as small.

    ``pairs``: a, b, cost with a < b; ``own``: b, own_cost.
    """
    best = pairs.groupBy("b").agg(F.min(F.struct("cost", "a")).alias("m"))
    return own.join(best, "b", "left").select(
        "b", F.when(F.col("m.cost") < F.col("own_cost"), F.col("m.a")).alias("reference"),
        F.least("own_cost", F.coalesce("m.cost", "own_cost")).alias("cost"),
    )


def threshold_sweep(costs: DataFrame) -> DataFrame:
    """The threshold before the first increase of the cost (threshold, cost): a few rows, one a threshold."""
    w = Window.orderBy("threshold")
    up = costs.withColumn("up", (F.col("cost") > F.lag("cost").over(w)).cast("int")).withColumn("ups", F.sum("up").over(w))
    return up.where(F.coalesce("ups", F.lit(0)) == 0).agg(F.max(F.struct("threshold", "cost")).alias("m")).select("m.*")


def early_stop(losses: DataFrame, last: int = 10, share: float = 0.05) -> DataFrame:
    """Epochs (run, epoch, loss) at which the last losses span less than ``share`` of their least."""
    w = Window.partitionBy("run").orderBy("epoch").rowsBetween(-(last - 1), 0)
    hi, lo, n = F.max("loss").over(w), F.min("loss").over(w), F.count("loss").over(w)
    return losses.where("loss IS NOT NULL").withColumn("stop", (n == last) & ((hi - lo) < share * lo)).where("stop").select("run", "epoch")
