"""Small helpers for functions that map Arrow record batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, as UTF-8 bytes; a null text is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("data"))


def slices(batches: Iterable[pa.RecordBatch], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that no slice of several rows holds more than ``most`` bytes of data."""
    for b in batches:
        col = b.column("data")
        at, held = 0, 0
        for i in range(b.num_rows):
            n = len(col[i].as_buffer() or b"")
            if i > at and held + n > most:
                yield b.slice(at, i - at)
                at, held = i, 0
            held += n
        if b.num_rows > at:
            yield b.slice(at)


def give_back() -> None:
    """Returns freed memory to the system: Python workers are used again by the next stage and keep what the last one freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)
