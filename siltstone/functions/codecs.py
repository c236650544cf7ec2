"""Codecs and checksums of payloads as Arrow functions, each with its inverse."""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import chunkers

#: Bytes a streaming coder is fed at a time.
STEP = 1000
_ADLER = 65521


def _dictionary(data: bytes, words: bytes) -> bool:
    c = zlib.compressobj(6, zlib.DEFLATED, -15, zdict=words) if words else zlib.compressobj(6, zlib.DEFLATED, -15)
    code = c.compress(data) + c.flush()
    d = zlib.decompressobj(-15, zdict=words) if words else zlib.decompressobj(-15)
    return d.decompress(code) + d.flush() == data


def _stream(data: bytes) -> bool:
    c, d = zlib.compressobj(1), zlib.decompressobj()
    code = b"".join(c.compress(data[i : i + STEP]) for i in range(0, len(data), STEP)) + c.flush()
    return b"".join(d.decompress(code[i : i + STEP]) for i in range(0, len(code), STEP)) + d.flush() == data


def _partial(data: bytes) -> bool:
    """The first half of a payload without decoding the rest."""
    half = len(data) // 2
    return not half or zlib.decompressobj().decompress(zlib.compress(data), half) == data[:half]


def _delta(data: bytes) -> bool:
    half = len(data) // 2
    source = data[half:] + b"-" + data[:half]
    return chunkers.delta_decode(chunkers.delta_encode(data, source), source) == data


CODECS = {
    "zlib": lambda x: zlib.decompress(zlib.compress(x)) == x,
    "lzma": lambda x: lzma.decompress(lzma.compress(x, preset=0)) == x,
    "dictionary": lambda x: _dictionary(x, x[:STEP]),
    "stream": _stream,
    "partial": _partial,
    "delta": _delta,
}


def _payload(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))


def round_trips(docs: DataFrame) -> DataFrame:
    """codec, doc_id and whether decoding gives the payload back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [x.as_py() for x in b.column(1)]
            for name, same in CODECS.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(data)), b.column(0), pa.array([same(x) for x in data], pa.bool_())], ["codec", "doc_id", "identical"]
                )

    return _payload(docs).mapInArrow(run, "codec string, doc_id long, identical boolean")


def adler32_combine(a: int, b: int, n: int) -> int:
    """adler32 of two byte strings in a row from their own and the length of the second."""
    low_a, high_a, low_b, high_b = a & 0xFFFF, a >> 16, b & 0xFFFF, b >> 16
    low = (low_a + low_b - 1) % _ADLER
    high = (high_a + high_b + n * (low_a - 1)) % _ADLER
    return high << 16 | low


def crc32_combine(a: int, b: int, n: int) -> int:
    """crc32 of two byte strings in a row: the first one's is carried over ``n`` zero bytes by squared matrices."""

    def times(rows: list[int], v: int) -> int:
        out = i = 0
        while v:
            if v & 1:
                out ^= rows[i]
            v >>= 1
            i += 1
        return out

    bit = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    power = bit
    for _ in range(3):
        power = [times(power, r) for r in power]  # one zero byte
    while n:
        if n & 1:
            a = times(power, a)
        power = [times(power, r) for r in power]
        n >>= 1
    return a ^ b


def checksums(docs: DataFrame) -> DataFrame:
    """crc32 and adler32 of each payload, the same combined from its halves, and crc32 by Spark itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1):
                x = x.as_py()
                y, z = x[: len(x) // 2], x[len(x) // 2 :]
                rows.append((
                    zlib.crc32(x), crc32_combine(zlib.crc32(y), zlib.crc32(z), len(z)),
                    zlib.adler32(x), adler32_combine(zlib.adler32(y), zlib.adler32(z), len(z)),
                ))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols), b.column(2)],
                ["doc_id", "crc32", "crc32_halves", "adler32", "adler32_halves", "crc32_sql"],
            )

    rows = _payload(docs).withColumn("crc32_sql", F.crc32("data"))
    return rows.mapInArrow(run, "doc_id long, crc32 long, crc32_halves long, adler32 long, adler32_halves long, crc32_sql long")


def xxh64(docs: DataFrame, seed: int = 0) -> DataFrame:
    """XXH64 of each payload, in one piece and from a state fed in steps, as signed longs."""

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, fed = [], []
            for x in b.column(1):
                x = x.as_py()
                state = xxhash.xxh64(seed=seed)
                for i in range(0, len(x), STEP):
                    state.update(x[i : i + STEP])
                one.append(signed(xxhash.xxh64_intdigest(x, seed=seed)))
                fed.append(signed(state.intdigest()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(one, pa.int64()), pa.array(fed, pa.int64())], ["doc_id", "hash", "streamed"])

    return _payload(docs).mapInArrow(run, "doc_id long, hash long, streamed long")
