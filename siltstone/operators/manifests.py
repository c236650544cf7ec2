"""Manifests by media type: parsing, conversion to the older form, and marking through manifest lists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.checkpoints import drop, table

# Media types of manifests.
SCHEMA1 = "application/vnd.docker.distribution.manifest.v1+prettyjws"
SCHEMA2 = "application/vnd.docker.distribution.manifest.v2+json"
LIST = "application/vnd.docker.distribution.manifest.list.v2+json"
#: Digest of the empty compressed tar that stands for a layer without content.
EMPTY_LAYER = "sha256:a3ed95caeb02ffe68cdd9fd84406680ae93d633cb16422d00e8a7c22955b46d4"

DESCRIPTOR = "struct<mediaType:string,size:bigint,digest:string>"
SCHEMAS: dict[str, str] = {
    SCHEMA1: "schemaVersion int, name string, tag string, fsLayers array<struct<blobSum:string>>",
    SCHEMA2: f"schemaVersion int, mediaType string, config {DESCRIPTOR}, layers array<{DESCRIPTOR}>",
    LIST: "schemaVersion int, mediaType string, manifests array<struct<mediaType:string,size:bigint,digest:string,platform:struct<architecture:string,os:string>>>",
}


def register_schema(media_type: str, schema: str, known: dict[str, str] = SCHEMAS) -> None:
    if media_type in known:
        raise ValueError(f"{media_type} has a schema")
    known[media_type] = schema


def media_type_of(header: Column) -> Column:
    """The media type without parameters, in lower case."""
    return F.lower(F.trim(F.substring_index(header, ";", 1)))


def references(manifests: DataFrame, schemas: Mapping[str, str] = SCHEMAS) -> DataFrame:
    """digest, media_type, ordinal and target of every reference of manifests (digest, content_type, body).

    Schema 2 refers to its configuration (ordinal -1) and layers, a list to its
    manifests, schema 1 to its layers from the top.  Bodies of another type or
    that do not parse refer to nothing.
    """
    rows = manifests.withColumn("media_type", media_type_of(F.col("content_type")))
    found = []
    for media_type, pick in (
        (SCHEMA1, lambda m: F.transform(m["fsLayers"], lambda x, i: F.struct(i.alias("ordinal"), x["blobSum"].alias("target")))),
        (SCHEMA2, lambda m: F.concat(
            F.array(F.struct(F.lit(-1).alias("ordinal"), m["config"]["digest"].alias("target"))),
            F.transform(m["layers"], lambda x, i: F.struct(i.alias("ordinal"), x["digest"].alias("target"))),
        )),
        (LIST, lambda m: F.transform(m["manifests"], lambda x, i: F.struct(i.alias("ordinal"), x["digest"].alias("target")))),
    ):
        parsed = F.from_json("body", schemas[media_type])
        found.append(F.when(F.col("media_type") == media_type, pick(parsed)))
    kind = "array<struct<ordinal:int,target:string>>"
    refs = F.coalesce(*[f.cast(kind) for f in found])
    return rows.select("digest", "media_type", F.explode(refs).alias("r")).select("digest", "media_type", "r.*").where("target IS NOT NULL")


def reachable(roots: DataFrame, refs: DataFrame, most_rounds: int = 16) -> DataFrame:
    """Digests that are roots or referred to from one, through any depth of lists.

    Each round follows the references of what was new in the last one.
    """
    spark = roots.sparkSession
    seen, path = table(roots.select("digest").distinct())
    new = seen
    for _ in range(most_rounds):
        step = refs.join(new, "digest", "left_semi").select(F.col("target").alias("digest")).distinct().join(seen, "digest", "left_anti")
        new, new_path = table(step)
        if not new.limit(1).count():
            drop(spark, new_path)
            return seen
        seen, next_path = table(seen.unionByName(new))
        drop(spark, path)
        path = next_path
    raise RuntimeError("lists lie deeper than the rounds allowed")


def to_schema1(images: DataFrame) -> DataFrame:
    """Older form of schema 2 images: position (0 is the top), layer digest and id of each history entry.

    ``images``: image, layers (digests from the base) and history (array of
    empty: boolean, from the base).  An entry without content has the empty
    layer; the id of an entry hashes its layer with its parent's id, the base
    having none.  Images whose layers do not match their history give no rows.
    """
    has = F.filter("history", lambda h: ~h)
    rows = images.where((F.size("history") > 0) & (F.size(has) == F.size("layers")))
    place = F.transform("history", lambda h, i: F.size(F.filter(F.slice("history", 1, i + 1), lambda x: ~x)))
    sums = F.transform(F.arrays_zip(F.col("history").alias("empty"), place.alias("at")), lambda x: F.when(x["empty"], F.lit(EMPTY_LAYER)).otherwise(F.get("layers", x["at"] - 1)))
    chain = F.aggregate(
        "sums", F.array().cast("array<string>"),
        lambda ids, s: F.concat(ids, F.array(F.sha2(F.concat(F.substring_index(s, ":", -1), F.lit(" "), F.coalesce(F.element_at(F.concat(F.array(F.lit("")), ids), -1), F.lit(""))), 256))),
    )
    rows = rows.select("image", sums.alias("sums")).select("image", "sums", chain.alias("ids"))
    flat = rows.select("image", F.size("sums").alias("n"), F.posexplode(F.arrays_zip("sums", "ids")).alias("i", "e"))
    return flat.select("image", (F.col("n") - 1 - F.col("i")).alias("position"), F.col("e.sums").alias("blob_sum"), F.col("e.ids").alias("id"))
