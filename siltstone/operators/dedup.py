"""Chunking, content index, recipes, restore and dedup reports.

Payload bytes are hashed before any exchange; reports shuffle (hash, size)
pairs only, and every aggregate over a hash combines map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 512


def _pieces(docs: DataFrame, size: int, keep: Sequence[str]) -> DataFrame:
    """One row a block with the bytes in ``piece``.  Null and empty payloads have none."""
    n = F.ceil(F.octet_length("text") / F.lit(size)).cast("int")
    rows = docs.where(F.octet_length("text") > 0).select(
        *keep, F.col("text").cast("binary").alias("payload"), F.explode(F.sequence(F.lit(0), n - 1)).alias("ordinal")
    )
    return rows.select(*keep, "ordinal", F.substring("payload", F.col("ordinal") * size + 1, F.lit(size)).alias("piece"))


def document_chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Fixed blocks with hash and size; the last block of a payload is short."""
    return _pieces(docs, size, ("doc_id", "lang", "source")).select(
        "doc_id", "lang", "source", "ordinal", F.sha2("piece", 256).alias("hash"),
        F.octet_length("piece").cast("long").alias("size"),
    )


def padded_chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Fixed blocks, the last one filled up with zero bytes; ``size`` is what was there."""
    zero = F.lit(bytes(1))
    full = F.rpad(F.col("piece"), size, zero)
    return _pieces(docs, size, ("doc_id",)).select(
        "doc_id", "ordinal", F.sha2(full, 256).alias("hash"), F.octet_length("piece").cast("long").alias("size")
    )


def per_hash(chunks: DataFrame, *keys: str) -> DataFrame:
    """n, b (bytes) and s (one copy) of each hash within the key groups."""
    return chunks.groupBy(*keys, "hash").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.min("size").alias("s")
    )


def _total(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def dedup_report(chunks: DataFrame) -> DataFrame:
    """Chunks, distinct chunks, bytes and stored bytes."""
    return per_hash(chunks).agg(
        _total(F.col("n")).alias("chunks"), F.count(F.lit(1)).alias("unique_chunks"),
        _total(F.col("b")).alias("bytes"), _total(F.col("s")).alias("stored_bytes"),
    )


def savings(chunks: DataFrame) -> DataFrame:
    """Bytes saved by keeping one copy of each hash."""
    return per_hash(chunks).agg(_total((F.col("n") - 1) * F.col("s")).alias("saved_bytes"), _total(F.col("b")).alias("bytes"))


def size_breakdown(chunks: DataFrame) -> DataFrame:
    """Bytes of hashes seen once, of the first copies of repeated ones, and in all."""
    n, s = F.col("n"), F.col("s")
    return per_hash(chunks).agg(
        _total(F.when(n == 1, s)).alias("unique_bytes"), _total(F.when(n > 1, s)).alias("first_of_dup_bytes"),
        _total(F.col("b")).alias("total_bytes"),
    )


def four_tuple(chunks: DataFrame) -> DataFrame:
    n, s = F.col("n"), F.col("s")
    return per_hash(chunks).agg(
        _total(F.col("b") - s).alias("reduced_bytes"), _total(F.col("b")).alias("total_bytes"),
        _total(F.when(n > 1, s)).alias("dup_first_bytes"), _total(F.when(n == 1, s)).alias("once_bytes"),
    )


def keyed_ratio(chunks: DataFrame, *keys: str) -> DataFrame:
    """Dedup where only chunks under one key may share a copy; no keys: one key for all."""
    got = per_hash(chunks, *keys).agg(_total(F.col("b") - F.col("s")).alias("reduced_bytes"), _total(F.col("b")).alias("total_bytes"))
    ratio = F.round(F.col("reduced_bytes") / F.greatest(F.col("total_bytes"), F.lit(1)), 6)
    return got.withColumn("ratio", ratio)


def keying_comparison(chunks: DataFrame, schemes: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row a scheme; the chunk table is read once: rows are expanded under each scheme's key."""
    tagged = chunks.select(
        "hash", "size",
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("scheme"), F.concat_ws("|", F.lit(""), *keys).alias("key")) for n, keys in schemes.items()])
        ).alias("k"),
    ).select("hash", "size", "k.*")
    return per_hash(tagged, "scheme", "key").groupBy("scheme").agg(
        _total(F.col("b") - F.col("s")).alias("reduced_bytes"), _total(F.col("b")).alias("total_bytes")
    )


def first_chunks(chunks: DataFrame) -> DataFrame:
    """The first occurrence of each hash by (doc_id, ordinal): a minimum, so hot hashes combine map-side."""
    return chunks.groupBy("hash").agg(F.min(F.struct("doc_id", "ordinal", "size")).alias("f")).select("hash", "f.*")


def index_hits(chunks: DataFrame, index: DataFrame) -> DataFrame:
    return chunks.join(index.select("hash").distinct(), "hash", "left_semi")


def index_misses(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """What an insert-if-absent would add: first occurrences of hashes that the index lacks."""
    return first_chunks(chunks.join(index.select("hash").distinct(), "hash", "left_anti"))


def restore(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rebuilds every payload from its recipe and the store of distinct chunks.

    Chunks carry their ordinal, so repeats within a payload survive and order
    does not depend on the exchange.  A payload is one row by nature.
    """
    rows = _pieces(docs, size, ("doc_id",)).withColumn("hash", F.sha2("piece", 256))
    store = rows.groupBy("hash").agg(F.first("piece").alias("data"))
    recipe = rows.select("doc_id", "ordinal", "hash")
    back = recipe.join(store, "hash").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", F.hex("data").alias("h")))).alias("parts")
    )
    data = F.unhex(F.array_join(F.transform("parts", lambda p: p["h"]), ""))
    return back.select("doc_id", F.size("parts").cast("long").alias("chunks"), F.sha2(data, 256).alias("restored_sha256"))


def recipe_offsets(chunks: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.select("doc_id", "ordinal", "size", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("offset"))


def with_host(chunks: DataFrame, hosts: int = 4) -> DataFrame:
    """Placement of a chunk by the leading digits of its hash."""
    return chunks.withColumn("host", F.concat(F.lit("host"), F.conv(F.substring("hash", 1, 4), 16, 10).cast("long") % hosts))


def slices(chunks: DataFrame) -> DataFrame:
    """Slice of each layer on each host: chunk count and bytes."""
    return with_host(chunks).groupBy("doc_id", "host").agg(
        F.count(F.lit(1)).alias("fcnt"), F.sum("size").alias("slice_size")
    )


def layer_recipe(chunks: DataFrame) -> DataFrame:
    """Recipe summary of each layer: size, chunks, hosts, and as master the host with most bytes (then least name)."""
    s = slices(chunks)
    return s.groupBy("doc_id").agg(
        F.sum("slice_size").alias("uncompression_size"), F.sum("fcnt").alias("fcnt"), F.count(F.lit(1)).alias("n_hosts"),
        F.min(F.struct((-F.col("slice_size")).alias("s"), "host"))["host"].alias("master"),
    )


def size_map(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Bytes of each layer by host as ``host=bytes`` in order of host, and its size in millionths of the stored one."""
    held = F.sort_array(F.collect_list(F.struct("host", "slice_size")))
    got = slices(chunks).groupBy("doc_id").agg(held.alias("m"), F.sum("slice_size").alias("size"))
    text = F.array_join(F.transform("m", lambda x: F.concat(x["host"], F.lit("="), x["slice_size"].cast("string"))), ",")
    return got.join(stored, "doc_id").select("doc_id", text.alias("slice_sizes"), F.floor(F.col("size") * 1_000_000 / F.col("stored")).alias("compress_ppm"))


def forward_map(chunks: DataFrame, local: str = "host0") -> DataFrame:
    """Distinct new chunks each server must be sent by ``local``."""
    rows = with_host(first_chunks(chunks)).where(F.col("host") != local)
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
