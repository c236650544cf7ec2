"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

Every benchmark item of L words is compared with the windows of L words of
every document (a shorter document is one window).  Windows and items carry
128-bit SimHash fingerprints of their weighted 5-word shingles.  The index
cuts fingerprints into BLOCKS blocks and lists each item under its value of
every block; a window probes each block with all values of up to ERRORS wrong
bits, so by pigeonhole it meets every item within RADIUS.  Those of the
window's length are candidates, which are verified by the exact weighted
Jaccard similarity of their shingles, counted with multiplicity.

A window at a similarity of exactly 0.8 differs from its item in about 19 of
128 bits (standard deviation 4), so it is beyond the radius of 31 about once
in 500 times; windows that are more alike, far less often.

A window that reaches the similarity shares at least that part of the item's
shingles, so windows with too few benchmark shingles are passed over before
they are fingerprinted; none of them could be verified.

The benchmark is taken in blocks of about ITEMS items or ITEM_BYTES bytes, each
of which is one pass over the documents with one broadcast of bounded size (a
single larger item makes a block of its own).

Words are split at white space; A-Z count as a-z and ASCII punctuation is left
out.  Edge cases: null and empty texts and items match nothing; an item of
fewer than five words is one shingle of its own length and must occur exactly;
repeated rows and null ids each give their own rows, repeated items count once;
empty tables on either side give none; very long texts are worked off whole,
document by document; of equally similar windows the first is reported; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.arrowrows import with_bytes
from siltstone.llm.textcodes import U64, mix, shingles, word_codes

K = 5
SIMILARITY = 0.8
BITS, BLOCKS, ERRORS = 128, 8, 3
BLOCK_BITS = BITS // BLOCKS
RADIUS = BLOCKS * (ERRORS + 1) - 1
ITEMS, ITEM_BYTES = 10_000, 16 << 20
_DROP = string.punctuation.encode()
_SHIFTS = np.arange(64, dtype=U64)
#: Windows fingerprinted at a time, and places between starts that are summed up together.
AT_A_TIME, FAR = 1024, 64
#: All block values with up to ERRORS bits set: what a probe differs by.
NEAR = np.array([v for v in range(1 << BLOCK_BITS) if v.bit_count() <= ERRORS], np.int64)


def codes(data: bytes) -> np.ndarray:
    return word_codes(data.translate(None, _DROP))


def _signs(shingle_codes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each shingle and bit."""
    words = np.stack([shingle_codes, mix(shingle_codes + U64(0x9E3779B97F4A7C15))], axis=1)
    bits = (words[:, :, None] >> _SHIFTS) & U64(1)
    return (bits.astype(np.int32).reshape(len(words), BITS) << 1) - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    """Two words for each row of sums."""
    return ((sums.reshape(-1, 2, 64) > 0).astype(U64) << _SHIFTS).sum(axis=2, dtype=U64)


def simhash(shingle_codes: np.ndarray) -> np.ndarray:
    """Fingerprint of a list of shingles; a shingle weighs as often as it occurs."""
    return _pack(_signs(shingle_codes).sum(axis=0)[None])[0]


def windows_simhash(shingle_codes: np.ndarray, starts: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, fingerprint) of the runs of ``n`` shingles from each start, a stretch of starts at a time."""
    for at in range(0, len(starts), AT_A_TIME):
        part = starts[at : at + AT_A_TIME]
        cut = np.flatnonzero(np.append(True, np.diff(part) > FAR))  # starts far apart are summed up apart
        for a, b in zip(cut, np.append(cut[1:], len(part))):
            run = part[a:b]
            lo, hi = int(run[0]), int(run[-1]) + n
            total = np.zeros((hi - lo + 1, BITS), np.int32)
            np.cumsum(_signs(shingle_codes[lo:hi]), axis=0, out=total[1:])
            yield from zip(run.tolist(), _pack(total[run - lo + n] - total[run - lo]))


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of smaller over sum of larger multiplicities."""
    u, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(inv[: len(a)], minlength=len(u))
    y = np.bincount(inv[len(a) :], minlength=len(u))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class HammingIndex:
    """All stored fingerprints within RADIUS of a query: block values are listed once, and queries probe with errors."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints.reshape(-1, 2)
        self.values = np.ascontiguousarray(self.prints).view("<u2").reshape(len(self.prints), BLOCKS)
        self.lists = []
        for values in self._blocks(self.prints).T:
            order = np.argsort(values, kind="stable").astype(np.int32)
            self.lists.append((np.searchsorted(values[order], np.arange((1 << BLOCK_BITS) + 1)).astype(np.int32), order))

    @staticmethod
    def _blocks(prints: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(prints).view("<u2").reshape(len(prints), BLOCKS).astype(np.int64)

    def candidates(self, p: np.ndarray) -> np.ndarray:
        """Places of stored fingerprints that share a block with ``p`` up to ERRORS bits.

        With fewer stored fingerprints than probes the block values themselves are compared; the result is the same.
        """
        if len(self.prints) <= len(NEAR):
            wrong = np.bitwise_count(self.values ^ np.ascontiguousarray(p).view("<u2"))
            return np.flatnonzero((wrong <= ERRORS).any(axis=1))
        found = []
        for value, (first, order) in zip(self._blocks(p[None])[0], self.lists):
            probe = value ^ NEAR
            lo, n = first[probe], first[probe + 1] - first[probe]
            hit = np.flatnonzero(n)
            if len(hit):
                lo, n = lo[hit], n[hit]
                found.append(order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)

    def within(self, p: np.ndarray) -> np.ndarray:
        at = self.candidates(p)
        return at[np.bitwise_count(self.prints[at] ^ p).sum(axis=1) <= RADIUS]


class BenchmarkIndex:
    """One index of all items, and the items' lengths in words."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items: list[tuple[int, np.ndarray]] = []
        lengths, prints = [], [np.empty((0, 2), U64)]
        for item, data in items:
            words = codes(data)
            if len(words):
                s = shingles(words, K)
                self.items.append((item, s))
                lengths.append(len(words))
                prints.append(simhash(s)[None])
        self.length = np.array(lengths, np.int64)
        self.lengths = sorted(set(lengths))
        self.index = HammingIndex(np.concatenate(prints))
        self.known = {
            k: np.unique(np.concatenate([s for n, (_, s) in zip(lengths, self.items) if min(n, K) == k])) for k in {min(n, K) for n in lengths}
        }

    def matches(self, data: bytes) -> list[tuple[int, int, float, int]]:
        """(item, windows that match, best similarity, first word of the best window)."""
        words = codes(data)
        best: dict[int, tuple[int, float, int]] = {}
        for k, known in self.known.items():
            own = shingles(words, k)
            if not len(own) or (len(words) < k):
                continue
            hit = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
            if not hit.any():
                continue
            seen = np.concatenate([[0], np.cumsum(hit)])
            for n in self.lengths:
                if min(n, K) != k:
                    continue
                run = min(n - k + 1, len(own))
                shared = seen[run:] - seen[:-run]
                starts = np.flatnonzero(shared >= SIMILARITY * (n - k + 1) - 1e-9)
                if not len(starts):
                    continue
                for at, p in windows_simhash(own, starts, run):
                    for i in self.index.within(p):
                        if self.length[i] != n:
                            continue
                        item, theirs = self.items[i]
                        s = weighted_jaccard(own[at : at + run], theirs)
                        if s >= SIMILARITY:
                            c, top, first = best.get(item, (0, 0.0, 0))
                            best[item] = (c + 1, s, at) if s > top else (c + 1, top, first)
        return [(item, *v) for item, v in sorted(best.items())]


def indexes(benchmark: DataFrame) -> Iterator[BenchmarkIndex]:
    """One index for each block of about ITEMS items or ITEM_BYTES bytes."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size["n"] // ITEMS), -(-size["b"] // ITEM_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        got = rows.where(part == b).select(F.col("item_id").cast("long"), F.col("text").cast("binary")).distinct().toArrow()
        yield BenchmarkIndex(sorted(zip(got[0].to_pylist(), got[1].to_pylist())))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, similarity and start_word of each leaked item in each document."""
    spark = docs.sparkSession

    def against(index: BenchmarkIndex) -> DataFrame:
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, rows = [], []
                for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                    for m in held.value.matches(x.as_py()):
                        ids.append(i)
                        rows.append(m)
                cols = list(zip(*rows)) if rows else [[]] * 4
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), *(pa.array(list(c), t) for c, t in zip(cols, kinds))],
                    ["doc_id", "item_id", "n_windows", "similarity", "start_word"],
                )

        return with_bytes(docs).mapInArrow(
            run, "doc_id long, item_id long, n_windows long, similarity double, start_word long"
        )

    return reduce(DataFrame.unionByName, [against(i) for i in indexes(benchmark)])


def clean_column(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> Column:
    """True for texts that hold no benchmark item."""

    def against(index: BenchmarkIndex) -> Column:
        held = docs.sparkSession.sparkContext.broadcast(index)

        @F.arrow_udf("boolean")
        def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                yield pa.array([not held.value.matches(x.as_py() or b"") for x in b], pa.bool_())

        return clean(F.col(text).cast("string").cast("binary"))

    return reduce(lambda a, b: a & b, [against(i) for i in indexes(benchmark)])
