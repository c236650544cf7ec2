"""Repeated byte strings across documents by a sparse, range-partitioned suffix array.

A byte goes if some LENGTH-byte string that covers it also starts in a document
with a smaller id.  Suffixes are sampled by content: every LENGTH-byte window
elects the least of its GRAM-byte strings (by hash, leftmost on ties) as its
anchor, so equal windows have anchors at equal places and only suffixes at
anchors, about one byte in fourteen, need sorting.  Anchors whose GRAM bytes
occur in one document only are set aside by a fingerprint exchange.

Sampled splitters range-partition the other suffixes by their leading bytes.
Each bucket sorts them by multikey quicksort on eight-byte characters (all open
segments of equal prefix advance together), and the longest common prefixes of
neighbours give runs of suffixes that agree on any number of bytes.  The bytes
before the anchors are sorted the same way from right to left, so two windows
are equal exactly if they are in one run on both sides, and the least document
of a pair of runs settles the window.  Equal leading bytes never part at a
splitter, so no run crosses a boundary.

Texts travel in blocks of a few MB.  A block sends each distinct context once,
with its least document, however many of its documents hold it; contexts of
that block's later documents are repeats already.

Edge cases: a null or empty text has no bytes and the digest of the empty
string; texts of fewer than LENGTH bytes lose nothing; rows with a null id lose
nothing and make others lose nothing; rows that repeat an id are not earlier
than each other; very long texts are worked off in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import shared
from siltstone.llm.arrowrows import slices, with_bytes
from siltstone.llm.textcodes import _EXACT as CODES
from siltstone.llm.textcodes import U64, mix, powers

LENGTH, GRAM = 50, 24
#: Places of an anchor within its window, and the bytes kept before and after an anchor.
PLACES = LENGTH - GRAM + 1
BEFORE, AFTER = PLACES - 1, LENGTH
BLOCK_BYTES = 1 << 22
PIECE = 1 << 16
_LOW = U64((1 << 21) - 1)
PRINT_BITS = 40
PARTITION_BYTES = 1 << 25
#: Suffixes in a bucket; sampled suffixes of a block, and for each bucket: the sample grows with the buckets.
BUCKET = 100_000
SAMPLE_BLOCK, PER_BUCKET = 256, 16
LEAD = 16


def _gram_hashes(a: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """Hash of the GRAM bytes at some positions, from sums of powers modulo 2**64."""
    n = len(a)
    s = np.zeros(n + 1, U64)
    np.cumsum(CODES[a] * powers(n)[:n], out=s[1:])
    return (s[GRAM:][at] - s[: n + 1 - GRAM][at]) * powers(n, inverse=True)[: n + 1 - GRAM][at]


def anchors(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Anchor positions of the documents that lie end to end between the bounds."""
    n = len(data) - LENGTH + 1
    if n < 1:
        return np.empty(0, np.int64)
    long = np.flatnonzero(np.diff(bounds) >= LENGTH)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[bounds[long]] = 1
    inside[bounds[long + 1] - LENGTH + 1] -= 1  # no window crosses documents
    inside = np.cumsum(inside, dtype=np.int8).view(bool)
    out = []
    for lo in range(0, n, PIECE):
        hi = min(n, lo + PIECE)
        least = _gram_hashes(data[lo : hi + LENGTH - 1], slice(None))
        least &= ~_LOW
        least |= np.arange(len(least), dtype=U64)
        width = 1
        while 2 * width <= PLACES:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = PLACES - width
        if rest:
            least = np.minimum(least[: len(least) - rest], least[rest:])
        at = (least[inside[lo:hi]] & _LOW).astype(np.int64) + lo
        if len(at):
            out.append(at[np.append(True, at[1:] != at[:-1])])
    at = np.concatenate(out) if out else np.empty(0, np.int64)
    return at[np.append(True, at[1:] != at[:-1])] if len(at) else at


def anchor_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    cut = np.searchsorted(at, np.arange(0, len(data) + PIECE, PIECE))
    out = [
        _gram_hashes(data[k * PIECE : (k + 1) * PIECE + GRAM - 1], at[a:b] - k * PIECE)
        for k, (a, b) in enumerate(zip(cut[:-1], cut[1:]))
        if b > a
    ]
    return mix(np.concatenate(out)) if out else np.empty(0, U64)


def contexts(data: np.ndarray, at: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One row for each anchor: AFTER bytes from it, BEFORE bytes before it backwards, and how many are real.

    ``first`` and ``end`` are where its document starts and ends; bytes beyond count as zeros.
    """
    padded = np.zeros(len(data) + BEFORE + AFTER, np.uint8)
    padded[BEFORE : BEFORE + len(data)] = data
    rows = np.lib.stride_tricks.sliding_window_view(padded, BEFORE + AFTER)[at]
    out = np.empty((len(at), BEFORE + AFTER + 2), np.uint8)
    out[:, :AFTER] = rows[:, BEFORE:]
    out[:, AFTER : AFTER + BEFORE] = rows[:, BEFORE - 1 :: -1] if BEFORE else rows[:, :0]
    out[:, -2] = np.minimum(end - at, AFTER)
    out[:, -1] = np.minimum(at - first, BEFORE)
    few = np.flatnonzero(out[:, -2] < AFTER)
    out[few, :AFTER] *= np.arange(AFTER) < out[few, -2:-1]
    few = np.flatnonzero(out[:, -1] < BEFORE)
    out[few, AFTER : AFTER + BEFORE] *= np.arange(BEFORE) < out[few, -1:]
    return out


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents with their anchors as bits, so that later stages need not elect them again."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        for b in slices(batches, BLOCK_BYTES):
            ids, texts = b.column("doc_id").to_pylist(), b.column("data").to_pylist()
            sizes = [len(x) for x in texts]
            data = np.frombuffer(b"".join(texts), np.uint8)
            bounds = np.append(0, np.cumsum(sizes))
            at = anchors(data, bounds)
            if None in ids:
                named = np.array([d is not None for d in ids])
                at = at[np.repeat(named, np.diff(np.searchsorted(at, bounds)))]
            few = at[anchor_hashes(data, at) % U64(64) == 0].tolist()
            cut = [data[i : i + LEAD].tobytes() for i in few[:: max(1, -(-len(few) // SAMPLE_BLOCK))]]
            cut = [cut[i] for i in np.random.default_rng(seq).permutation(len(cut))]  # any stretch of it is a sample
            elected = np.zeros(len(data), bool)
            elected[at] = True
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 32) | seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int64())), pa.array([len(data)], pa.int64()),
                    pa.array([zstandard.compress(data, 1)], pa.binary()),
                    pa.array([zstandard.compress(np.packbits(elected), 1)], pa.binary()),
                    pa.array([b"".join(cut)], pa.binary()),
                ],
                ["block", "ids", "sizes", "total", "data", "elected", "sample"],
            )
            seq += 1

    return with_bytes(docs).mapInArrow(
        run, "block long, ids array<long>, sizes array<long>, total long, data binary, elected binary, sample binary"
    )


class Block:
    """The documents of a block end to end, and each anchor's place, document and fingerprint."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.data = np.frombuffer(zstandard.decompress(row["data"]), np.uint8)
        self.bounds = np.append(0, np.cumsum(np.array(row["sizes"], np.int64)))
        bits = np.frombuffer(zstandard.decompress(row["elected"]), np.uint8)
        self.at = np.flatnonzero(np.unpackbits(bits, count=len(self.data)).view(bool))
        self.of = np.repeat(np.arange(len(self.ids)), np.diff(np.searchsorted(self.at, self.bounds)))
        self.prints = anchor_hashes(self.data, self.at) >> U64(64 - PRINT_BITS)

    def distinct_prints(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct fingerprints of the block's anchors; whether several of its documents have one."""
        if not len(self.at):
            return np.empty(0, U64), np.empty(0, bool)
        nth = np.cumsum(np.append(False, self.of[1:] != self.of[:-1]))  # among those with anchors, so few bits hold it
        by = np.sort((self.prints << U64(64 - PRINT_BITS)) | nth.astype(U64))
        u = by >> U64(64 - PRINT_BITS)
        start = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        return u[start], by[np.append(start[1:], len(by)) - 1] != by[start]


def _each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, Block]]:
    """Blocks one by one."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, Block(row)


def _cut(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    return [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]


def _bounds(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used = np.unique(part)
    return used, np.append(np.searchsorted(part, used), len(part))


def _ask_prints(parts: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _each(batches):
            u, several = block.distinct_prints()
            used, bounds = _bounds((u * U64(parts) >> U64(PRINT_BITS)).astype(np.int64))
            low = u.view(np.uint8).reshape(-1, 8)[:, : PRINT_BITS // 8]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used), row["block"])), pa.array(used.astype(np.int32)),
                    pa.array(_cut(np.ascontiguousarray(low), bounds), pa.binary()), pa.array(_cut(several, bounds), pa.binary()),
                ],
                ["block", "p", "prints", "several"],
            )

    return run


def _count_prints(t: pa.Table) -> pa.Table:
    """Which fingerprints are in more than one document."""
    size = PRINT_BITS // 8
    raw = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, size) for x in t["prints"]]
    bounds = np.append(0, np.cumsum([len(x) for x in raw]))
    wide = np.zeros((bounds[-1], 8), np.uint8)
    wide[:, :size] = np.concatenate(raw)
    several = np.concatenate([np.frombuffer(x.as_buffer(), bool) for x in t["several"]])
    _, inv, n = np.unique(wide.view(U64).ravel(), return_inverse=True, return_counts=True)
    more = n > 1
    more[inv[several]] = True
    answer = more[inv]
    return pa.table(
        {
            "block": t["block"], "p": t["p"], "more": pa.array(_cut(answer, bounds), pa.binary()),
            "n": pa.array(np.add.reduceat(answer.astype(np.int64), bounds[:-1]), pa.int64()),
        }
    )


class Contexts:
    """The block's distinct contexts of anchors that other documents may share, in order and so in bucket order."""

    def __init__(self, row: dict, block: Block, splitters: np.ndarray):
        u, _ = block.distinct_prints()
        more = np.concatenate([np.frombuffer(x["more"], bool) for x in row["a0"]]) if row["a0"] else np.empty(0, bool)
        held = _among(u[more], block.prints)
        self.at, of = block.at[held], block.of[held]
        ids = np.array([0 if d is None else d for d in block.ids], np.int64)  # rows without an id have no anchors
        self.owner = ids[of]
        self.rows = contexts(block.data, self.at, block.bounds[of], block.bounds[of + 1])
        order, new = multikey_order(self.rows)
        first = order[new]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.distinct = self.rows[first]
        self.bucket = np.searchsorted(splitters, _leads(self.distinct), side="right")
        self.least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.place, self.owner)


def _leads(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows[:, :LEAD]).view(f"S{LEAD}").ravel()


def _among(wanted: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Places of the fingerprints that are wanted; a table of their leading bits spares most searches."""
    if not len(wanted):
        return np.empty(0, np.int64)
    shift = U64(PRINT_BITS - 20)
    maybe = np.zeros(1 << 20, bool)
    maybe[wanted >> shift] = True
    at = np.flatnonzero(maybe[prints >> shift])
    f = prints[at]
    return at[wanted[np.minimum(np.searchsorted(wanted, f), len(wanted) - 1)] == f]


def _ask_contexts(splitters: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _each(batches):
            c = Contexts(row, block, splitters)
            used, bounds = _bounds(c.bucket)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used), row["block"])), pa.array(used.astype(np.int32)),
                    pa.array([zstandard.compress(x, 3) for x in _cut(c.distinct, bounds)], pa.binary()),
                    pa.array([zstandard.compress(x, 1) for x in _cut(c.least, bounds)], pa.binary()),
                ],
                ["block", "p", "rows", "least"],
            )

    return run


def multikey_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings of one length, and which differ from the one before them in order.

    Quicksort by one eight-byte character after the other; only segments that
    are equal so far go on to the next character.
    """
    n, width = rows.shape
    chars = np.zeros((n, -(-width // 8) * 8), np.uint8)
    chars[:, :width] = rows
    words = chars.view(">u8")
    order, segment = np.arange(n), np.zeros(n, np.int64)
    first = np.zeros(n, bool)
    first[:1] = True
    open_at = np.arange(n if n > 1 else 0)
    for k in range(words.shape[1]):
        if not len(open_at):
            break
        w, s = words[order[open_at], k].astype(U64), segment[open_at]
        by = np.lexsort((w, s)) if k else np.argsort(w)
        order[open_at] = order[open_at][by]
        w, s = w[by], s[by]
        new = np.append(True, (w[1:] != w[:-1]) | (s[1:] != s[:-1]))
        start = np.flatnonzero(new)
        first[open_at[start]] = True
        segment[open_at] = open_at[start][np.cumsum(new) - 1]
        size = np.diff(np.append(start, len(new)))
        open_at = open_at[np.repeat(size > 1, size)]
    return order, first


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings of one length, and the common prefix of each with the one before it in order."""
    n, width = rows.shape
    order, first = multikey_order(rows)
    common = np.full(n, width)
    common[:1] = 0
    at = np.flatnonzero(first)[1:]
    if len(at):
        common[at] = (rows[order[at]] != rows[order[at - 1]]).argmax(axis=1)
    return order, common


def repeated_windows(rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each context a mask: bit o is set if the window that starts o bytes before the anchor
    also occurs in a context of a smaller document."""
    if not len(rows):
        return np.zeros(0, np.int32)
    order, first = multikey_order(rows)
    kind = np.empty(len(rows), np.int64)
    kind[order] = np.cumsum(first) - 1
    one = order[first]
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, docs)
    masks = _repeated_windows(rows[one], least)
    # what a smaller document has in the same context is repeated as a whole
    return np.where(docs > least[kind], whole_windows(rows), masks[kind])


def whole_windows(rows: np.ndarray) -> np.ndarray:
    """For each context the mask of all windows that its document has."""
    after, before = rows[:, -2].astype(np.int32), rows[:, -1].astype(np.int32)
    return ((1 << (before + 1)) - 1) & -(1 << np.maximum(0, LENGTH - after))


def _repeated_windows(rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The masks of contexts that all differ and are in order."""
    n = len(rows)
    masks = np.zeros(n, np.int32)
    common = np.zeros(n, np.int64)
    if n > 1:
        differ = rows[1:, :AFTER] != rows[:-1, :AFTER]
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), AFTER)
    starts = common < GRAM
    size = np.bincount(np.cumsum(starts) - 1)
    open_at = np.flatnonzero(np.repeat(size > 1, size))  # whole runs, so neighbours stay neighbours
    if not len(open_at):
        return masks
    rows, docs, common = rows[open_at], docs[open_at], common[open_at]
    back_order, back_common = multikey_sort(rows[:, AFTER : AFTER + BEFORE])
    left = np.empty(len(rows), np.int64)
    whole, found = whole_windows(rows), np.zeros(len(rows), np.int32)
    for o in range(PLACES):
        right = np.cumsum(common < LENGTH - o)
        left[back_order] = np.cumsum(back_common < o) if o else 0
        size = np.bincount(right)
        at = np.flatnonzero(((whole >> o) & 1).astype(bool) & (size > 1)[right])
        if not len(at):
            continue
        key, d = right[at] * (len(rows) + 1) + left[at], docs[at]
        by = np.argsort(key)
        new = np.append(True, np.diff(key[by]) != 0)
        least = np.minimum.reduceat(d[by], np.flatnonzero(new))[np.cumsum(new) - 1]
        at = at[by]
        found[at] |= (least < d[by]).astype(np.int32) << o
    masks[open_at] = found
    return masks


def _sort_bucket(t: pa.Table) -> pa.Table:
    width = BEFORE + AFTER + 2
    raw = [np.frombuffer(zstandard.decompress(x.as_py()), np.uint8).reshape(-1, width) for x in t["rows"]]
    least = np.concatenate([np.frombuffer(zstandard.decompress(x.as_py()), np.int64) for x in t["least"]])
    bounds = np.append(0, np.cumsum([len(x) for x in raw]))
    masks = repeated_windows(np.concatenate(raw), least)
    return pa.table({"block": t["block"], "p": t["p"], "masks": pa.array(_cut(masks, bounds), pa.binary())})


def _remove(splitters: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _each(batches):
            c = Contexts(row, block, splitters)
            data, bounds = block.data, block.bounds
            change = np.zeros(len(data) + 1, np.int8)
            if len(c.at):
                masks = np.concatenate([np.frombuffer(x["masks"], np.int32) for x in row["a1"]])
                mine = np.where(c.owner > c.least[c.place], whole_windows(c.rows), masks[c.place])
                starts = np.zeros(len(data), bool)
                for o in range(PLACES):
                    starts[c.at[((mine >> o) & 1).astype(bool)] - o] = True
                s = np.flatnonzero(starts)
                change[s] = 1
                change[s + LENGTH] -= 1
            covered = np.cumsum(change[:-1], dtype=np.int8) > 0
            opens = covered.copy()
            opens[1:] &= ~covered[:-1]
            first = bounds[:-1][np.diff(bounds) > 0]
            opens[first] = covered[first]
            spans = np.diff(np.searchsorted(np.flatnonzero(opens), bounds))
            gone = np.searchsorted(np.flatnonzero(covered), bounds)
            kept, cut = memoryview(data[~covered]), (bounds - gone).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.ids, pa.int64()), pa.array(np.diff(bounds)), pa.array(np.diff(gone)), pa.array(spans),
                    pa.array([hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:])], pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def _with(table: DataFrame, answers: list[tuple[DataFrame, str]]) -> DataFrame:
    """Blocks with the answers to them in the order of partitions; blocks without any have null."""
    for i, (a, field) in enumerate(answers):
        got = a.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("p", field))).alias(f"a{i}"))
        table = table.join(got, "block", "left")
    return table


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    spark = docs.sparkSession
    table, _ = shared.table(blocks(docs))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = table.agg(F.sum("total")).first()[0] or 0
    parts = max(2 * tasks, -(-total // PARTITION_BYTES))
    asked = table.select("block", "ids", "sizes", "data", "elected").mapInArrow(
        _ask_prints(parts), "block long, p int, prints binary, several binary"
    )
    more, _ = shared.table(asked.groupBy("p").applyInArrow(_count_prints, "block long, p int, more binary, n long"))
    del asked
    shared.release(spark)
    held = more.agg(F.sum("n")).first()[0] or 0
    buckets = max(2 * tasks, -(-held // BUCKET))
    n_blocks = max(1, table.count())
    most = min(SAMPLE_BLOCK, -(-PER_BUCKET * buckets // n_blocks)) * LEAD
    few = table.select(F.substring("sample", 1, most)).collect()  # PER_BUCKET leads a bucket
    lead = np.sort(np.frombuffer(b"".join(r[0] for r in few), f"S{LEAD}"))
    splitters = np.unique(lead[np.linspace(0, len(lead) - 1, buckets + 1).astype(int)[1:-1]]) if len(lead) else lead
    rows = table.select("block", "ids", "sizes", "data", "elected")
    contexts_ = _with(rows, [(more, "more")]).mapInArrow(_ask_contexts(splitters), "block long, p int, rows binary, least binary")
    masks, _ = shared.table(contexts_.groupBy("p").applyInArrow(_sort_bucket, "block long, p int, masks binary"))
    del contexts_
    shared.release(spark)
    return _with(rows, [(more, "more"), (masks, "masks")]).mapInArrow(
        _remove(splitters), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
