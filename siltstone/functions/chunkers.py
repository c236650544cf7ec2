"""Content-defined chunking, rolling features and codec sizes as Arrow functions."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gear_table(seed: int = 1) -> np.ndarray:
    """256 32-bit values from SHA-256 of the seed and the byte: a rule, so cut points are this library's own."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([seed, b])).digest()[:4], "big") for b in range(256)], np.uint64)


GEAR = gear_table()


def fastcdc(data: bytes, low: int, average: int, high: int) -> list[tuple[int, int]]:
    """(offset, length) of chunks: a gear hash that shifts right, a strict mask before the
    centre and a loose one after it; the last chunk has the bytes that are there."""
    bits = max(1, round(np.log2(average)))
    strict, loose = (1 << (bits + 1)) - 1, (1 << (bits - 1)) - 1
    centre = max(0, average - (low + (low + 1) // 2)) if low < average else 0
    out, at, n = [], 0, len(data)
    gear = GEAR.tolist()
    while at < n:
        end = min(n, at + high)
        i, h, cut = at + low, 0, end
        if i < end:
            middle = min(end, at + max(low, centre))
            while i < end:
                h = (h >> 1) + gear[data[i]]
                if not h & (strict if i < middle else loose):
                    cut = i + 1
                    break
                i += 1
        out.append((at, cut - at))
        at = cut
    return out


def rabin_karp(data: bytes, target: int, high: int, base: int = 256, modulus: int = 69061) -> list[tuple[int, int]]:
    """(offset, length): cut when the chunk has ``target`` bytes and its hash is a multiple of ``target``, or at ``high``."""
    out, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = (h * base + b) % modulus
        n = i + 1 - start
        if (n >= target and h % target == 0) or n >= high:
            out.append((start, n))
            start, h = i + 1, 0
    if start < len(data):
        out.append((start, len(data) - start))
    return out


def _polynomial(a: np.ndarray, window: int, base: int, modulus: int) -> np.ndarray:
    """Hash of the ``window`` bytes from each position, put together from hashes of power-of-two lengths."""
    m = np.uint64(modulus)
    out, done = np.zeros(len(a) + 1, np.uint64), 0
    h, width = a.astype(np.uint64), 1
    while True:
        if window & width:  # this length follows what is there
            n = len(a) - done - width + 1
            out = (out[:n] * np.uint64(pow(base, width, modulus)) + h[done : done + n]) % m
            done += width
        if width * 2 > window:
            return out
        h = (h[:-width] * np.uint64(pow(base, width, modulus)) + h[width:]) % m
        width *= 2


def rolling_features(data: bytes, features: int = 12, window: int = 48, base: int = 37, modulus: int = 1_000_000_007) -> list[int]:
    """For each of ``features`` equal parts the greatest polynomial hash of its windows; a shorter part is one window."""
    part = max(1, len(data) // features)
    out = []
    for f in range(features):
        a = np.frombuffer(data[f * part : (f + 1) * part], np.uint8)
        n = min(window, len(a))
        out.append(int(_polynomial(a, n, base, modulus).max()) if n else 0)
    return out


def super_features(data: bytes, features: int = 12, groups: int = 3) -> list[int]:
    """XXH64 (seed 0) of the i-th greatest-to-least features of the groups, as signed longs."""
    f = rolling_features(data, features)
    each = features // groups
    parts = [sorted(f[g * each : (g + 1) * each]) for g in range(groups)]
    out = []
    for i in range(each):
        h = xxhash.xxh64_intdigest(b"".join(p[i].to_bytes(8, "little") for p in parts), seed=0)
        out.append(h - (1 << 64) if h >= 1 << 63 else h)
    return out


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id and the super-features (an array) of the bytes of each payload that is not empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([super_features(x.as_py()) for x in b.column(1)], pa.list_(pa.int64()))], ["doc_id", "sf"]
            )

    rows = docs.where(F.octet_length("text") > 0).select("doc_id", F.col("text").cast("binary").alias("data"))
    return rows.mapInArrow(run, "doc_id long, sf array<long>")


def chunk_table(docs: DataFrame, cutter: Callable[[bytes], list[tuple[int, int]]]) -> DataFrame:
    """doc_id, ordinal, start, size and hash of each chunk of the payloads."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, x in zip(b.column(0).to_pylist(), b.column(1)):
                data = x.as_py()
                for k, (at, n) in enumerate(cutter(data)):
                    rows.append((d, k, at, n, hashlib.sha256(data[at : at + n]).hexdigest()))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(cols, kinds)], ["doc_id", "ordinal", "start", "size", "hash"]
            )

    payload = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    return payload.mapInArrow(run, "doc_id long, ordinal int, start long, size long, hash string")


def self_size(data: bytes) -> int:
    return len(zlib.compress(data, 6))


#: Bytes of a block of the source that the delta coder can copy, and its polynomial.
DELTA_BLOCK = 32
_DELTA_BASE = np.uint64(0x9E3779B97F4A7C15)


def _window_codes(a: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code of the ``n`` bytes from each position (n a power of two), by doubling."""
    h, width, base = a.astype(np.uint64) + np.uint64(1), 1, _DELTA_BASE
    while width < n:
        h = h[: len(h) - width] * base + h[width:]
        with np.errstate(over="ignore"):
            base = base * base
        width *= 2
    return h


def delta(data: bytes, source: bytes) -> list[tuple[int, int] | bytes]:
    """``data`` as copies (start in the whole source, length) and literal bytes.

    Blocks of the source at multiples of DELTA_BLOCK are indexed by code;
    wherever the data has one, the match is checked and extended both ways.
    """
    out: list[tuple[int, int] | bytes] = []
    if len(source) < DELTA_BLOCK or len(data) < DELTA_BLOCK:
        return [data] if data else []
    a, b = np.frombuffer(data, np.uint8), np.frombuffer(source, np.uint8)
    blocks, first = np.unique(_window_codes(b, DELTA_BLOCK)[::DELTA_BLOCK], return_index=True)
    codes = _window_codes(a, DELTA_BLOCK)
    place = np.minimum(np.searchsorted(blocks, codes), len(blocks) - 1)
    hits = np.flatnonzero(blocks[place] == codes)
    done = k = 0

    def run(x: np.ndarray, y: np.ndarray) -> int:
        """Leading places at which two arrays agree."""
        n, at = min(len(x), len(y)), 0
        while at < n:
            step = min(n - at, 4096)
            differ = x[at : at + step] != y[at : at + step]
            if differ.any():
                return at + int(differ.argmax())
            at += step
        return n

    while k < len(hits):
        at = int(hits[k])
        start = int(first[place[at]]) * DELTA_BLOCK
        back = run(a[done:at][::-1], b[:start][::-1])
        n = back + run(a[at:], b[start:])
        if n >= DELTA_BLOCK:
            if at - back > done:
                out.append(data[done : at - back])
            out.append((start - back, n))
            done = at - back + n
            k = int(np.searchsorted(hits, done))
        else:
            k += 1
    if done < len(data):
        out.append(data[done:])
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def delta_encode(data: bytes, source: bytes) -> bytes:
    """The delta as instructions and literals, deflated: what ``delta_decode`` reads."""
    ops, literal, end = bytearray(), bytearray(), 0
    for step in delta(data, source):
        if isinstance(step, bytes):
            ops += b"\0" + _varint(len(step))
            literal += step
        else:
            start, n = step
            jump = start - end
            ops += (b"\1" if jump >= 0 else b"\2") + _varint(abs(jump)) + _varint(n)
            end = start + n
    return zlib.compress(_varint(len(ops)) + bytes(ops) + bytes(literal), 6)


def delta_decode(code: bytes, source: bytes) -> bytes:
    raw, at = zlib.decompress(code), 0

    def number() -> int:
        nonlocal at
        v = shift = 0
        while True:
            b = raw[at]
            at += 1
            v |= (b & 127) << shift
            shift += 7
            if b < 128:
                return v

    stop = number() + at
    literal, end, out = stop, 0, bytearray()
    while at < stop:
        kind = raw[at]
        at += 1
        if kind == 0:
            n = number()
            out += raw[literal : literal + n]
            literal += n
        else:
            jump = number()
            start = end + (jump if kind == 1 else -jump)
            end = start + number()
            out += source[start:end]
    return bytes(out)


def delta_size(data: bytes, source: bytes) -> int:
    """Bytes of ``data`` coded against the whole of ``source``."""
    return len(delta_encode(data, source))


def strategy(pairs: DataFrame) -> DataFrame:
    """Cheapest encoding of each chunk: dup, delta against its reference, self, or raw.

    ``pairs``: doc_id, data, reference (bytes or null), dup (boolean).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flags, sizes = [], []
            for data, ref, dup in zip(b.column(1), b.column(2), b.column(3).to_pylist()):
                data, ref = data.as_py(), ref.as_py()
                options = [(len(data), "raw"), (self_size(data), "self")]
                if ref:
                    options.append((delta_size(data, ref), "delta"))
                size, flag = (0, "dup") if dup else min(options)
                flags.append(flag), sizes.append(size)
            raw = [len(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(flags), pa.array(sizes, pa.int64()), pa.array(raw, pa.int64())], ["doc_id", "flag", "size", "raw"]
            )

    return pairs.select("doc_id", "data", "reference", "dup").mapInArrow(run, "doc_id long, flag string, size long, raw long")
