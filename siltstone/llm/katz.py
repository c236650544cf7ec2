"""Katz backoff language model of words with Good-Turing discounts, of any order.

Texts become blocks of a few MB: arrays of token codes with a vocabulary.  A
block asks for what it needs and nothing else: first it sends its distinct
tokens, then order by order its distinct n-grams by context, in packed arrays
to the partitions of the count tables.  A partition adds up the training counts
and answers every request with the count and, for n-grams that were seen, with
a number.  The number of a context and that of a word name an n-gram of the
next order, so n-grams are told apart exactly; words are numbered by frequency
and others in the order of their partition, which keeps the arrays small.

A partition holds whole contexts, so it computes what their discounts and
exactly normalised backoff weights are made of: the numbers of followers with
counts 1 to K, and the probability of all followers in the lower order.
``train`` keeps the merged n-grams of each partition as tables, and ``score`` can
read them back, where they take part like one more block; without a model it
counts and scores in one pass and writes the answers only.  Contexts so frequent that they would fill a partition are
salted by the following word; the partial sums of those are added up in a table
and joined to the blocks that met them.

Each token is evaluated recursively from the lowest order up: the discounted
relative frequency where its n-gram was seen, else the context's backoff weight
times the probability of the lower order; a context that was never seen passes
the lower order on.  Unigrams form the training vocabulary and one unknown type,
which gets the mass that the unigram discounts free.  If a context has no
discounted n-gram, one count is kept free for the unseen ones.  A text starts
after one end token; contexts of more words than that are those the text has.

Edge cases: a null or empty text is one end token; without training rows
every token is unknown with probability 1; a null id is scored, never learned
from and has a null held_out; repeated rows count and are scored each; very
long texts make a block of their own; an empty table gives no rows; there are
no ties, as everything is a sum; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import shared
from siltstone.llm.arrowrows import slices
from siltstone.llm.labelled import remainder
from siltstone.llm.textcodes import U64, mix, word_codes

FOLDS, HELD_OUT = 7, 2
ORDER = 3
#: Counts up to this one are discounted.
K = 5
BLOCK_BYTES = 6 << 20
#: Bytes of token codes, and tokens, that a partition of the count tables gets on average.
PARTITION_BYTES, PARTITION_TOKENS = 1 << 25, 4_000_000
#: A context with more than this part of a partition's tokens is salted.
SALT = 4
END = U64(0x0123456789ABCDEF)
#: Number of the unknown word; those that were seen follow.
UNKNOWN, FIRST = 1, 2
#: Places of n-grams in a partition are below two to this power.
PLACE_BITS = 36
#: Marks a count whose context has no discounted n-gram.
BARE = np.uint32(1 << 31)


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """Good-Turing factors d[r] for counts r = 0..K (d[0] unused); index r - 1 of the argument is N_r."""
    n = [0, *counts_of_counts]
    d = np.ones(K + 1)
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        good = n[r] and tail < 1
        value = (((r + 1) * n[r + 1] / n[r] / r) - tail) / (1 - tail) if good else 0.0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


@dataclass
class Totals:
    """Training tokens, and for each order its discounts; ``free`` is the unknown type's probability."""

    total: int
    types: int
    free: float
    d: dict[int, np.ndarray] = field(default_factory=dict)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """Probability of types with these counts; the unknown type has count 0."""
        if not self.total:
            return np.ones(len(c))
        return np.where(c > 0, self.seen(1, c, np.int64(self.total)), self.free)

    def seen(self, k: int, c: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Discounted relative frequency of n-grams of order ``k`` that were seen ``c`` times in contexts of this count."""
        return np.where(c <= K, self.d[k][np.minimum(c, K)], 1.0) * c / np.maximum(context, 1)


def pack(values: np.ndarray) -> bytes:
    """Bytes of an array, those of one significance together, compressed."""
    size = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, size).T
    return zstandard.compress(planes.tobytes(), 3)


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_small(values: np.ndarray) -> bytes:
    """Numbers in groups of seven bits, the low ones first; the last byte of a number is below 128."""
    most = int(values.max()) if len(values) else 0
    v = values.astype(np.uint32 if most < 1 << 32 else U64)
    size = np.ones(len(v), np.int8)
    longer = []
    for shift in range(7, most.bit_length(), 7):
        longer.append(np.flatnonzero(v >> v.dtype.type(shift)))
        size[longer[-1]] += 1
    last = np.cumsum(size, dtype=np.int64)
    first = last - size
    out = np.empty(int(last[-1]) if len(v) else 0, np.uint8)
    out[first] = v.astype(np.uint8) & 127 | (size > 1).astype(np.uint8) << 7
    for i, has in enumerate(longer, 1):
        low = (v[has] >> v.dtype.type(7 * i)).astype(np.uint8) & 127
        out[first[has] + i] = low | (size[has] > i + 1).astype(np.uint8) << 7
    return zstandard.compress(out.tobytes(), 3)


def unpack_small(data: bytes) -> np.ndarray:
    b = np.frombuffer(zstandard.decompress(data), np.uint8)
    last = np.flatnonzero(b < 128)
    first = np.append(0, last[:-1] + 1)
    size = last - first + 1
    out = (b[first] & 127).astype(np.int64) if len(last) else np.empty(0, np.int64)
    for i in range(1, int(size.max()) if len(size) else 0):
        has = np.flatnonzero(size > i)
        out[has] |= (b[first[has] + i] & 127).astype(np.int64) << (7 * i)
    return out


def pack_sorted(codes: np.ndarray) -> bytes:
    """Ascending codes as their differences."""
    return pack(np.diff(codes, prepend=U64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, U64), dtype=U64)


def _cut_sorted(codes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    return [pack_sorted(codes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def _cut(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    return [pack(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def _part(codes: np.ndarray, parts: int) -> np.ndarray:
    """Partition of each code: equal ranges, so sorted codes have sorted partitions."""
    return ((codes >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def blocks(docs: DataFrame, id_col: str = "doc_id", learn: bool = True) -> DataFrame:
    """Tokens of the texts, a block a row; without ``learn`` all of them count as held out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        for b in slices(batches, BLOCK_BYTES):
            codes = [np.append(word_codes(x.as_py()), END) for x in b.column("data")]
            vocab, local, often = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
            # tokens travel as ranks by frequency, which compress better than places in the vocabulary
            ranked = np.argsort(-often, kind="stable").astype(np.int32)
            rank = np.empty(len(vocab), np.int32)
            rank[ranked] = np.arange(len(vocab), dtype=np.int32)
            n = np.array([len(c) for c in codes], np.int32)
            fold = np.array([9 if x is None else x for x in b.column("fold").to_pylist()], np.int8)
            ids = b.column("doc_id")
            missing = np.array([x is None for x in ids.to_pylist()], np.int8)
            row = [
                pa.array([(task << 32) | seq], pa.int64()),
                *(
                    pa.array([pack(v)], pa.binary())
                    for v in (ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), missing, fold, n, np.diff(ranked, prepend=np.int32(0)))
                ),
                pa.array([pack_small(rank[local])], pa.binary()),
                pa.array([pack_sorted(vocab)], pa.binary()),
                pa.array([len(local)], pa.int64()),
            ]
            seq += 1
            yield pa.RecordBatch.from_arrays(row, ["block", "ids", "missing", "fold", "n", "ranked", "local", "vocab", "tokens"])

    fold = remainder(id_col, FOLDS).cast("int") if learn else F.lit(HELD_OUT)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"),
        fold.alias("fold"),
    )
    return rows.mapInArrow(
        run, "block long, ids binary, missing binary, fold binary, n binary, ranked binary, local binary, vocab binary, tokens long"
    )


def _vocabulary(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes in order, each token's place among them, and whether the token is learned from."""
    vocab = unpack_sorted(row["vocab"])
    local = np.cumsum(unpack(row["ranked"], np.int32), dtype=np.int32).astype(np.int64)[unpack_small(row["local"])]
    return vocab, local, _learned(row)


def _learned(row: dict) -> np.ndarray:
    learn = (unpack(row["fold"], np.int8) != HELD_OUT) & (unpack(row["missing"], np.int8) == 0)
    return np.repeat(learn, unpack(row["n"], np.int32))


@dataclass
class Level:
    """Distinct n-grams of one order in a block whose context was seen, in the order of their partitions and numbers:
    partition, context (among those of the order below), word, training count, the n-gram of the order below that ends
    the same, and each token's place among them (-1: none)."""

    part: np.ndarray
    ctx: np.ndarray
    word: np.ndarray
    counts: np.ndarray
    lower: np.ndarray
    place: np.ndarray


def _distinct(part: np.ndarray, ctx: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct triple in their order, and each row's place among them."""
    bits = [int(x.max()).bit_length() for x in (part, ctx, word)]
    if sum(bits) < 64:
        key = (part << (bits[1] + bits[2])) | (ctx << bits[2]) | word
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
    else:
        order = np.lexsort((word, ctx, part))
        new = np.append(True, np.any([x[order][1:] != x[order][:-1] for x in (part, ctx, word)], axis=0))
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def _cut_small(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    return [pack_small(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def _cut_steps(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Ascending values as their differences."""
    return [pack_small(np.diff(values[a:b], prepend=0)) for a, b in zip(bounds[:-1], bounds[1:])]


def _pack_steps(values: np.ndarray, head: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Values ascend within a context: the first as it is, the others as differences."""
    steps = np.diff(values, prepend=0)
    steps[head] = values[head]
    return _cut_small(steps, bounds)


def _unpack_steps(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    head = np.cumsum(sizes) - sizes
    run = np.cumsum(steps)
    return run - np.repeat(run[head] - steps[head], sizes)


def _rows(table: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Blocks with the answers to them, each a list in the order of partitions; none is null."""
    for a in answers:
        table = table.join(a, "block", "left")
    return table


def _listed(found: DataFrame, name: str) -> DataFrame:
    fields = [c for c in found.columns if c != "block"]
    return found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def _ask_tokens(parts: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                vocab, local, learn = _vocabulary(row)
                counts = np.bincount(local[learn], minlength=len(vocab)).astype(np.int64)
                part = _part(vocab, parts)
                used = np.unique(part)
                bounds = np.append(np.searchsorted(part, used), len(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(used), row["block"])), pa.array(used.astype(np.int32)),
                        pa.array(_cut_sorted(vocab, bounds), pa.binary()), pa.array(_cut(counts, bounds), pa.binary()),
                    ],
                    ["block", "p", "codes", "counts"],
                )

    return run


def _of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(c[(c > 0) & (c <= K + 1)], minlength=K + 2)[1 : K + 2].tolist()


TOKENS = "block long, p int, known binary, places binary, stats array<long>, codes binary, counts binary"


def _add_tokens(t: pa.Table) -> pa.Table:
    """One partition of the unigram table: adds up, answers each block with counts and places by frequency, and one row
    of statistics with the table itself."""
    codes = [unpack_sorted(x.as_py()) for x in t["codes"]]
    counts = np.concatenate([unpack(x.as_py(), np.int64) for x in t["counts"]])
    bounds = np.append(0, np.cumsum([len(c) for c in codes]))
    u, inv = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(u), np.int64)
    np.add.at(total, inv, counts)
    place = np.empty(len(u), np.int64)
    place[np.lexsort((u, -total))] = np.arange(len(u))
    seen = total > 0
    asked = [i for i, x in enumerate(t["block"].to_pylist()) if x is not None]
    cut = lambda v: [pack(v[inv[bounds[i] : bounds[i + 1]]]) for i in asked]
    n, p = len(asked), t["p"][0].as_py()
    stats = [int(total.sum()), int(seen.sum()), *_of_counts(total)]
    return pa.table(
        {
            "block": pa.array([*(t["block"][i].as_py() for i in asked), None], pa.int64()),
            "p": pa.array([p] * (n + 1), pa.int32()),
            "known": pa.array([*cut(total), None], pa.binary()),
            "places": pa.array([*cut(np.where(seen, place, 0).astype(np.int32)), None], pa.binary()),
            "stats": pa.array([*([None] * n), stats], pa.list_(pa.int64())),
            "codes": pa.array([*([None] * n), pack_sorted(u[seen])], pa.binary()),
            "counts": pa.array([*([None] * n), pack(total[seen])], pa.binary()),
        }
    )


def _settle(parts: int):
    """Blocks with the answers to their tokens, as blocks of numbered words: codes are no longer needed.

    Words are listed by number, so their places in a block are in the order of
    their numbers; unknown ones are one entry.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                vocab, local, _ = _vocabulary(row)
                known = [unpack(x["known"], np.int64) for x in row["a1"]]
                count, part = np.concatenate(known), np.repeat([x["p"] for x in row["a1"]], [len(x) for x in known])
                place = np.concatenate([unpack(x["places"], np.int32) for x in row["a1"]]).astype(np.int64)
                number, first, at = np.unique(np.where(count > 0, place * parts + part + FIRST, UNKNOWN), return_index=True, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(c).slice(i, 1) for c in ("block", "ids", "missing", "fold", "n")
                    ] + [
                        pa.array([pack_small(at[local])], pa.binary()), pa.array([pack_small(np.diff(number, prepend=0))], pa.binary()),
                        pa.array([pack_small(count[first])], pa.binary()), pa.array([int(at[np.searchsorted(vocab, END)])], pa.int64()),
                    ],
                    ["block", "ids", "missing", "fold", "n", "local", "number", "count", "end"],
                )

    return run


SETTLED = "block long, ids binary, missing binary, fold binary, n binary, local binary, number binary, count binary, end long"


class Evaluation:
    """A settled block with the answers so far: counts, numbers, bare contexts and backoff weights of its n-grams by order."""

    def __init__(self, row: dict, totals: Totals, parts: int, upto: int):
        self.row, self.totals, self.parts = row, totals, parts
        self.n = unpack(row["n"], np.int32)
        self.first = np.cumsum(self.n) - self.n
        self.local = unpack_small(row["local"])
        self.learn = _learned(row)
        self.count, self.number = {1: unpack_small(row["count"])}, {1: np.cumsum(unpack_small(row["number"]))}
        none = np.empty(0, np.int64)
        self.level = {1: Level(none, none, none, none, none, self.local)}
        self.bare, self.weight = {1: np.zeros(len(self.count[1]), bool)}, {}
        for k in range(2, upto + 1):
            self._read(k, row[f"a{k}"] or [], row[f"hot{k}"] or [])

    def context_count(self, k: int) -> np.ndarray:
        """Training count of the context of each n-gram of order ``k``."""
        if k == 1:
            return np.full(len(self.count[1]), self.totals.total)
        return self.count[k - 1][self.level[k].ctx]

    def salts(self, k: int) -> np.ndarray:
        """Over how many partitions each context of order ``k`` is dealt."""
        return np.maximum(1, -(-self.count[k - 1] * SALT * self.parts // max(1, self.totals.total)))

    def above(self, k: int) -> Level:
        """The n-grams of order ``k``, from the level below."""
        if k in self.level:
            return self.level[k]
        below = self.level[k - 1].place
        ctx = np.empty(len(self.local), np.int64)
        ctx[1:] = below[:-1]
        ctx[self.first] = self.row["end"] if k == 2 else -1
        has = np.flatnonzero(ctx >= 0)
        has = has[self.count[k - 1][ctx[has]] > 0]
        ctx, word, place = ctx[has], self.local[has], np.full(len(self.local), -1)
        if len(has):
            part, salts = _part(mix(self.number[k - 1].astype(U64)), self.parts)[ctx], self.salts(k)[ctx]
            at = np.flatnonzero(salts > 1)
            part[at] = (part[at] + (mix(self.number[1][word[at]].astype(U64)) % salts[at].astype(U64)).astype(np.int64)) % self.parts
            first, mine = _distinct(part, ctx, word)
            place[has] = mine
            counts = np.bincount(mine[self.learn[has]], minlength=len(first)).astype(np.int64)
            lower = below[has[first]]
            part, ctx, word = part[first], ctx[first], word[first]
        else:
            part = counts = lower = has
        self.level[k] = Level(part, ctx, word, counts, lower, place)
        return self.level[k]

    def _read(self, k: int, answers: list, hot: list) -> None:
        r = self.above(k)
        n = len(r.ctx)
        self.number[k], self.bare[k], self.weight[k] = np.zeros(n, np.int64), np.zeros(n, bool), np.ones(n)
        if not n:
            self.count[k] = np.zeros(0, np.int64)
            return
        found = np.concatenate([unpack(x["found"], np.uint32) for x in answers])
        count, bare = (found & ~BARE).astype(np.int64), (found & BARE) > 0
        seen = count > 0
        # numbers go by partition, then by place, as the n-grams of this block do
        self.number[k][seen] = np.concatenate([np.cumsum(unpack_small(x["places"])) for x in answers]) + (r.part[seen] << PLACE_BITS) + FIRST
        few = np.concatenate([unpack(x["few"], np.int32) for x in answers]).reshape(-1, K)
        low = np.concatenate([unpack(x["low"], np.float64) for x in answers])
        weight, cc = self.weight[k], self.context_count(k)
        at = np.flatnonzero(~seen)
        d = self.totals.d[k]
        if len(at):
            c, p = r.ctx[at], r.part[at]
            which = np.cumsum(np.append(True, (c[1:] != c[:-1]) | (p[1:] != p[:-1]))) - 1
            weight[at] = backoff(few[which], low[which], cc[at], d)[0]
        salted = self.salts(k)[r.ctx] > 1
        if salted.any():
            h = np.array([x["h"] for x in hot], np.int64)
            order = np.argsort(h)
            mine = np.flatnonzero(salted)
            at = order[np.searchsorted(h[order], self.number[k - 1][r.ctx[mine]])]
            n_hot = np.array([[x[f"n{i}"] for i in range(K)] for x in hot], np.float64)[at]
            low_hot = np.array([x["low"] for x in hot], np.float64)[at]
            weight[mine], bare[mine] = backoff(n_hot, low_hot, cc[mine], d)
        self.count[k], self.bare[k] = count, bare

    def probabilities(self, order: int) -> np.ndarray:
        """Probability of each token, from the lowest order up."""
        p = self.totals.unigram(self.count[1])[self.local]
        for k in range(2, order + 1):
            cc = self.context_count(k)
            at = np.flatnonzero(self.level[k].place >= 0)
            g = self.level[k].place[at]
            c = self.count[k][g]
            high = self.totals.seen(k, c, cc[g] + self.bare[k][g])
            p[at] = np.where(c > 0, high, self.weight[k][g] * p[at])
        return p


def _ask(k: int, totals: Totals, parts: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                e = Evaluation(row, totals, parts, k - 1)
                r = e.above(k)
                if not len(r.ctx):
                    continue
                used = np.unique(r.part)
                bounds = np.append(np.searchsorted(r.part, used), len(r.part))
                head = np.flatnonzero(np.append(True, (r.ctx[1:] != r.ctx[:-1]) | (r.part[1:] != r.part[:-1])))
                heads = np.append(np.searchsorted(head, bounds[:-1]), len(head))
                sizes = np.diff(np.append(head, len(r.ctx)))
                of_lower = e.count[k - 1][r.lower]
                ctx, word = e.number[k - 1][r.ctx[head]], e.number[1][r.word]
                cols = [
                    _cut_steps(ctx, heads), _cut_small(sizes, heads), _cut(e.salts(k)[r.ctx[head]] > 1, heads), _pack_steps(word, head, bounds),
                    _cut_small(r.counts, bounds), _cut_small(np.where(r.counts > 0, of_lower, 0), bounds),
                    _cut(e.context_count(k - 1)[r.lower][head], heads), _cut(e.bare[k - 1][r.lower][head], heads),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), row["block"])), pa.array(used.astype(np.int32)), *(pa.array(c, pa.binary()) for c in cols)],
                    ["block", "p", *PACKET],
                )

    return run


PACKET = ["ctx", "sizes", "salted", "word", "counts", "lower", "low_count", "low_bare"]
ASKED = "block long, p int, " + ", ".join(f"{c} binary" for c in PACKET)
FOUND = (
    "block long, p int, found binary, places binary, few binary, low binary, need array<long>, h long, stats array<long>, mass double, "
    + ", ".join(f"{c} binary" for c in PACKET)
)

KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def backoff(n: np.ndarray, low: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backoff weights of contexts, and which have no discounted n-gram.

    ``n``: followers with counts 1..K (a row a context); ``low``: probability
    of all followers in the lower order; ``c``: the context's count; ``d``: discounts.
    """
    reserve = n @ ((1 - d[1:]) * np.arange(1, K + 1))
    bare = reserve <= 0
    left = np.where(bare, 1 / (c + 1), reserve / np.maximum(c, 1))
    return np.where(c > 0, left / np.maximum(1 - low, 1e-300), 1.0), bare & (c > 0)


def _add(k: int, totals: Totals, keep: bool):
    """One partition of the table of order ``k``: adds up, and answers with counts and, for what was seen, places; for a
    context that some block met with an unseen word, with what its backoff weight is made of; one row of statistics
    and, with ``keep``, the merged table; and the partial sums of salted contexts."""

    def run(t: pa.Table) -> pa.Table:
        get = lambda name, kind: np.concatenate([unpack(x.as_py(), kind) for x in t[name]])
        small = lambda name: np.concatenate([unpack_small(x.as_py()) for x in t[name]])
        sizes = small("sizes")
        if not len(sizes):  # a stored table without n-grams
            return pa.table({f.split()[0]: pa.array([], KINDS[f.split()[1]]) for f in FOUND.split(", ")})
        of_head = lambda v: np.repeat(v, sizes)
        word = _unpack_steps(small("word"), sizes)
        heads = np.concatenate([np.cumsum(unpack_small(x.as_py())) for x in t["ctx"]])
        each = [unpack_small(x.as_py()) for x in t["counts"]]
        bounds = np.append(0, np.cumsum([len(x) for x in each]))
        u, dense = np.unique(heads, return_inverse=True)
        ctx, dense = of_head(heads), of_head(dense)
        bits = int(word.max()).bit_length()
        order = np.argsort(dense << bits | word) if bits + len(u).bit_length() < 63 else np.lexsort((word, ctx))
        ctx, word = ctx[order], word[order]
        start = np.flatnonzero(np.append(True, (ctx[1:] != ctx[:-1]) | (word[1:] != word[:-1])))
        inv = np.empty(len(order), np.int64)
        inv[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
        ctx, word = ctx[start], word[start]
        reduce = lambda f, v: f.reduceat(v[order], start)
        total = reduce(np.add, np.concatenate(each))
        lower = reduce(np.maximum, small("lower"))
        head = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))
        context = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(ctx))))
        by_context = lambda v: np.maximum.reduceat(reduce(np.maximum, of_head(v)), head)
        low_count, low_bare, part = by_context(get("low_count", np.int64)), by_context(get("low_bare", bool)), by_context(get("salted", bool))
        seen = total > 0
        p_low = totals.seen(k - 1, lower, (low_count + low_bare)[context])
        mass = np.bincount(context, weights=np.where(seen, p_low, 0.0), minlength=len(head))
        few = np.flatnonzero(seen & (total <= K))
        n = np.bincount(context[few] * K + total[few] - 1, minlength=len(head) * K).reshape(-1, K)
        bare = (n.sum(axis=1) == 0) & ~part
        counts = total.astype(np.uint32) | np.where(bare[context], BARE, np.uint32(0))
        place = np.cumsum(seen) - 1
        rows, blocks_ = [], t["block"].to_pylist()
        for at, b in enumerate(blocks_):
            if b is None:
                continue
            mine = inv[bounds[at] : bounds[at + 1]]
            met = context[mine]
            new = met[~seen[mine]]
            new = new[np.append(True, new[1:] != new[:-1])] if len(new) else new
            salted = np.unique(met[part[met]])
            rows.append((
                b, pack(counts[mine]), pack_small(np.diff(place[mine][seen[mine]], prepend=0)), pack(n[new].astype(np.int32).ravel()), pack(mass[new]),
                ctx[head[salted]].tolist(),
            ))
        p, m = t["p"][0].as_py(), len(rows)
        salted = np.flatnonzero(part)
        more = 1 + len(salted)
        block, found, places, few_, low, need = zip(*rows) if rows else [()] * 6
        # the table itself, as one packet of what was seen
        at = np.flatnonzero(seen)
        c = context[at]
        first = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(at) else at
        whole = np.array([0, len(at)])
        held = c[first] if len(at) else at
        table = [None] * len(PACKET) if not keep else [
            pack_small(np.diff(ctx[at][first], prepend=0)), pack_small(np.diff(np.append(first, len(at)))), pack(part[held]),
            _pack_steps(word[at], first, whole)[0], pack_small(total[at]), pack_small(lower[at]), pack(low_count[held]), pack(low_bare[held]),
        ]
        none = lambda count: [None] * count
        return pa.table(
            {
                "block": pa.array([*block, *none(more)], pa.int64()), "p": pa.array([p] * (m + more), pa.int32()),
                "found": pa.array([*found, *none(more)], pa.binary()), "places": pa.array([*places, *none(more)], pa.binary()),
                "few": pa.array([*few_, *none(more)], pa.binary()), "low": pa.array([*low, *none(more)], pa.binary()),
                "need": pa.array([*need, *none(more)], pa.list_(pa.int64())),
                "h": pa.array([*none(m + 1), *ctx[head[salted]].tolist()], pa.int64()),
                "stats": pa.array([*none(m), _of_counts(total), *(n[i].tolist() for i in salted)], pa.list_(pa.int64())),
                "mass": pa.array([*none(m + 1), *mass[salted].tolist()], pa.float64()),
                **{name: pa.array([*none(m), v, *none(more - 1)], pa.binary()) for name, v in zip(PACKET, table)},
            }
        )

    return run


def _score(totals: Totals, parts: int, order: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                e = Evaluation(row, totals, parts, order)
                c = e.count[1][e.local]
                base = np.log10((c + 1) / (totals.total + totals.types + 1))
                per_doc = lambda v: np.add.reduceat(v, e.first)
                miss = unpack(row["missing"], np.int8) > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(unpack(row["ids"], np.int64), pa.int64(), mask=miss), pa.array(unpack(row["fold"], np.int8) == HELD_OUT, pa.bool_(), mask=miss),
                        pa.array(e.n.astype(np.int64)), pa.array(per_doc((c > 0).astype(np.int64))),
                        pa.array(np.full(len(e.n), totals.total)), pa.array(per_doc(base)), pa.array(per_doc(np.log10(e.probabilities(order)))),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def _sums(df: DataFrame, n: int) -> list[int]:
    got = df.agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(n)]).first()
    return [int(x or 0) for x in got]


def _hot(found: DataFrame, name: str) -> DataFrame:
    """Sums of the salted contexts that each block met."""
    sums = found.where("h IS NOT NULL").groupBy("h").agg(
        *[F.sum(F.col("stats")[i]).alias(f"n{i}") for i in range(K)], F.sum("mass").alias("low")
    )
    met = found.where("block IS NOT NULL").select("block", F.explode("need").alias("h")).distinct()
    return met.join(sums, "h").groupBy("block").agg(F.collect_list(F.struct("h", *[f"n{i}" for i in range(K)], "low")).alias(name))


@dataclass
class Model:
    """Tables of a trained model: one of unigrams and one of each higher order, a row a partition."""

    path: str
    parts1: int
    parts: int
    order: int

    def packets(self, spark: SparkSession, k: int) -> DataFrame:
        """The table of order ``k`` as the requests of a block without number."""
        return spark.read.parquet(f"{self.path}/order{k}").withColumn("block", F.lit(None).cast("long"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        return cls(path, *spark.read.parquet(f"{path}/sizes").select("parts1", "parts", "order").first())


def _evaluate(docs: DataFrame, order: int, model: Model | None, keep: str | None) -> DataFrame:
    spark = docs.sparkSession
    place = shared.mark()
    paths = []

    def table(df: DataFrame) -> DataFrame:
        out, path = shared.table(df)
        paths.append(path)
        return out

    packed = table(blocks(docs, learn=model is None))
    size = packed.agg(F.sum("tokens").alias("n"), F.sum(F.octet_length("vocab")).alias("v")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts1 = model.parts1 if model else max(2 * tasks, -(-2 * (size["v"] or 0) // PARTITION_BYTES))
    parts = model.parts if model else max(2 * tasks, -(-(size["n"] or 0) // PARTITION_TOKENS))
    asked = packed.mapInArrow(_ask_tokens(parts1), "block long, p int, codes binary, counts binary")
    if model:
        asked = asked.unionByName(model.packets(spark, 1))
    tokens = table(asked.groupBy("p").applyInArrow(_add_tokens, TOKENS))
    total, types, *ones = _sums(tokens.where("block IS NULL"), K + 3)
    d1 = discounts(ones)
    free = sum((1 - d1[r]) * r * ones[r - 1] for r in range(1, K + 1)) / total if total else 1.0
    if total and free <= 0:
        free = 1 / (total + 1)
    totals = Totals(total, types, free, {1: d1})
    if keep:
        tokens.where("block IS NULL").select("p", "codes", "counts").write.parquet(f"{keep}/order1")
        spark.createDataFrame([(parts1, parts, order)], "parts1 int, parts int, order int").write.parquet(f"{keep}/sizes")
    first = _listed(tokens.where("block IS NOT NULL").select("block", "p", "known", "places"), "a1")
    settled = table(_rows(packed, [first]).mapInArrow(_settle(parts1), SETTLED))
    shared.drop(spark, *paths[:2])  # codes and counts of tokens are in the settled blocks
    del asked, first, packed, tokens
    shared.release(spark)
    answers: list[DataFrame] = []
    for k in range(2, order + 1):
        asked = _rows(settled, answers).mapInArrow(_ask(k, totals, parts), ASKED)
        if model:
            asked = asked.unionByName(model.packets(spark, k))
        found = table(asked.groupBy("p").applyInArrow(_add(k, totals, bool(keep)), FOUND))
        del asked
        shared.release(spark)
        totals = Totals(total, types, free, totals.d | {k: discounts(_sums(found.where("block IS NULL AND h IS NULL"), K + 1))})
        if keep:
            found.where("block IS NULL AND h IS NULL").select("p", *PACKET).write.parquet(f"{keep}/order{k}")
        own = found.where("block IS NOT NULL").select("block", "p", "found", "places", "few", "low")
        answers += [_listed(own, f"a{k}"), _hot(found, f"hot{k}")]
    shared.drop_since(spark, place, *paths[2:])
    return _rows(settled, answers).mapInArrow(
        _score(totals, parts, order),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def train(docs: DataFrame, path: str, order: int = ORDER) -> Model:
    """Count tables of the training fold, written to ``path``."""
    _evaluate(docs, order, None, path)
    return Model.load(docs.sparkSession, path)


def score(docs: DataFrame, order: int = ORDER, model: Model | None = None) -> DataFrame:
    """Base and Katz log10 probabilities of every text, learned from the training fold or by a trained model."""
    return _evaluate(docs, model.order if model else order, model, None)
