"""Registry-style queries: garbage collection, references, catalog, tags, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sweep(blobs: DataFrame, *marks: DataFrame) -> DataFrame:
    """Blobs that no mark set names (each frame has one column, ``digest``)."""
    live = marks[0]
    for m in marks[1:]:
        live = live.union(m)
    return blobs.join(live.distinct(), "digest", "left_anti")


def missing_references(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """References (manifest, target) whose target does not exist."""
    return refs.join(targets, "target", "left_anti").select("manifest", "target").distinct()


def latest_tags(tags: DataFrame) -> DataFrame:
    """The current digest of each tag: the last one put (ties: the greatest digest)."""
    return tags.groupBy("repo", "tag").agg(F.max(F.struct("at", "digest"))["digest"].alias("digest"))


def path_key(path: Column) -> Column:
    """Sorts a path before those it is a component-wise prefix of, and '/' before everything else."""
    return F.translate(path, "/", "\x01")


def catalog_page(repos: DataFrame, last: str, n: int) -> DataFrame:
    """The ``n`` repositories after ``last`` in component-wise order."""
    return (
        repos.select("repo").distinct().where(path_key(F.col("repo")) > path_key(F.lit(last)))
        .orderBy(path_key(F.col("repo"))).limit(n)
    )


def purge(uploads: DataFrame, older_than: str) -> DataFrame:
    """Uploads started before the time; without a start they are kept."""
    return uploads.where(F.col("started_at") < F.lit(older_than).cast("timestamp_ntz"))


def allowed_urls(layers: DataFrame, allow: str, deny: str) -> DataFrame:
    """Foreign layers whose URL matches ``allow`` and not ``deny``."""
    return layers.where(F.col("url").rlike(allow) & ~F.col("url").rlike(deny))


def membership_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Members that left and members that joined."""
    gone = old.distinct().join(new, "member", "left_anti").select("member", F.lit("removed").alias("change"))
    come = new.distinct().join(old, "member", "left_anti").select("member", F.lit("added").alias("change"))
    return gone.union(come)


def prefix_lookup(digests: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Matches of each prefix of ``length`` digits: the digest if it is the only one, and how many there are."""
    by = digests.select(F.substring("digest", 1, length).alias("prefix"), "digest").distinct()
    n = by.groupBy("prefix").agg(F.count(F.lit(1)).alias("matches"), F.min("digest").alias("d"))
    return wanted.join(n, "prefix", "left").select(
        "prefix", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("d")).alias("digest")
    )


def short_codes(digests: DataFrame, least: int, lead: int = 2) -> DataFrame:
    """Shortest prefix, of ``least`` digits or more, that tells each digest from its neighbours in order.

    Digests are uniform, so a window for each of the first ``lead`` digits is
    even; the neighbour in the next group differs within those digits.
    """
    d = digests.select("digest").distinct().withColumn("g", F.substring("digest", 1, lead))
    w = Window.partitionBy("g").orderBy("digest")

    def common(other: Column) -> Column:
        same = F.filter(F.sequence(F.lit(1), F.length("digest")), lambda i: F.substring("digest", F.lit(1), i) == F.substring(other, F.lit(1), i))
        return F.when(other.isNull(), F.lit(lead - 1)).otherwise(F.size(same))

    n = d.select("digest", F.lag("digest").over(w).alias("a"), F.lead("digest").over(w).alias("b"))
    size = F.greatest(F.lit(least), common(F.col("a")) + 1, common(F.col("b")) + 1)
    return n.select("digest", F.substring("digest", F.lit(1), size).alias("code"))


def resolve_links(names: DataFrame, *tables: DataFrame) -> DataFrame:
    """First target found over several link tables (name, target), in order."""
    out, cols = names, []
    for i, t in enumerate(tables):
        out = out.join(t.select("name", F.col("target").alias(f"_t{i}")), "name", "left")
        cols.append(F.col(f"_t{i}"))
    return out.select("name", F.coalesce(*cols).alias("target"))


def mount(repo_blobs: DataFrame, source: str, target: str, wanted: DataFrame) -> DataFrame:
    """Links that a mount adds: blobs of ``source`` that are wanted and not yet in ``target``."""
    have = repo_blobs.where(F.col("repo") == target).select("digest")
    return (
        repo_blobs.where(F.col("repo") == source).join(wanted, "digest", "left_semi").join(have, "digest", "left_anti")
        .select(F.lit(target).alias("repo"), "digest").distinct()
    )


def build_manifest(refs: DataFrame) -> DataFrame:
    """Ordered references of each manifest as one JSON list."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "target")))
    return refs.groupBy("manifest").agg(F.to_json(F.transform(parts, lambda x: x["target"])).alias("layers"))


def select_platform(manifests: DataFrame, os: str = "linux", arch: str = "amd64") -> DataFrame:
    """The first manifest of each list for the platform."""
    hit = manifests.where((F.col("os") == os) & (F.col("architecture") == arch))
    return hit.groupBy("list").agg(F.min(F.struct("ordinal", "manifest"))["manifest"].alias("manifest"))


def health(status: DataFrame, threshold: int, key: str) -> DataFrame:
    """Whether a key is unhealthy after each check: ``threshold`` failures or more in a row."""
    w = Window.partitionBy(key).orderBy("event_id")
    runs = status.withColumn("grp", F.sum((~F.col("failed")).cast("int")).over(w))
    r = Window.partitionBy(key, "grp").orderBy("event_id")
    streak = F.sum(F.col("failed").cast("int")).over(r)
    return runs.select("event_id", key, streak.cast("long").alias("streak"), (streak >= threshold).alias("unhealthy"))
