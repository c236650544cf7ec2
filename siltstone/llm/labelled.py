"""Folds of labelled rows and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a classifier is fitted on at most; the bound makes the driver's share constant.
MOST_ROWS = 6000
#: Bytes of text that a classifier is fitted on at most.
MOST_BYTES = 128 << 20
FOLDS = 5


def remainder(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % folds


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> list[tuple[bytes, int]]:
    """(text, 0 or 1) of labelled training rows in order of their ids' hashes: at most ``most`` rows, and no more
    of them than ``most_bytes`` bytes of text hold.

    The ids are chosen first, from the narrow table; then the lengths of their
    texts are read, and only the texts that fit are fetched, so what is
    broadcast and what reaches the driver are bounded by the two parameters.
    Rows without an id, a label or a text are passed over; of several rows with
    one id the least text is taken, and of several labels the least.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1) & (remainder("doc_id", FOLDS) != 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("data")
    )
    held = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.max(F.octet_length("data")).alias("n"))
    order = held.select("doc_id", "n", F.xxhash64("doc_id").alias("x")).toArrow().sort_by([("x", "ascending"), ("doc_id", "ascending")])
    total, ids = 0, []
    for doc, n in zip(order["doc_id"].to_pylist(), order["n"].to_pylist()):
        total += n
        if total > most_bytes:
            break
        ids.append(doc)
    if not ids:
        return []
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long").join(F.broadcast(chosen), "doc_id")
    rows = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("data").alias("data"), F.min("label").alias("label")).toArrow()
    got = sorted(zip(rows["doc_id"].to_pylist(), rows["data"].to_pylist(), rows["label"].to_pylist()))
    return [(data, int(y)) for _, data, y in got]
