"""Bytes as model inputs, and inference in batches whose order is restored."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.ranking import global_row_number


def normalise(data: bytes) -> np.ndarray:
    """Bytes as floats from -1 up to 1, 1 excluded."""
    return (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128


def normalised_means(docs: DataFrame) -> DataFrame:
    """doc_id, n and the mean of the normalised bytes of each payload that is not empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [x.as_py() for x in b.column(1)]
            mean = [float(normalise(x).mean(dtype=np.float64)) for x in data]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(mean, pa.float64())], ["doc_id", "n", "mean"])

    rows = docs.where(F.octet_length("text") > 0).select("doc_id", F.col("text").cast("binary").alias("data"))
    return rows.mapInArrow(run, "doc_id long, n long, mean double").withColumn("mean", F.round("mean", 6))


def sign_words(vectors: np.ndarray) -> np.ndarray:
    """Signs (x >= 0) of a batch of vectors as words of 32 bits, the first one low."""
    bits = np.packbits(vectors >= 0, axis=1, bitorder="little")
    return bits.view("<u4").astype(np.int64)


def in_batches(vectors: DataFrame, size: int, model=sign_words) -> DataFrame:
    """vec_id, w0, w1 and batch: the model sees ``size`` vectors at a time, in the order of their ids.

    Rows are numbered once, so a batch is the same whatever the partitions are;
    each batch is one group, and its rows carry the number that restores the order.
    """
    numbered = global_row_number(vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("v")), "vec_id")
    rows = numbered.withColumn("batch", F.floor((F.col("rn") - 1) / size).cast("long"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rn")
        words = model(np.array(t["v"].to_pylist(), np.float32))
        return pa.table({"vec_id": t["vec_id"], "w0": words[:, 0], "w1": words[:, 1], "batch": t["batch"]})

    return rows.groupBy("batch").applyInArrow(run, "vec_id long, w0 long, w1 long, batch long")
