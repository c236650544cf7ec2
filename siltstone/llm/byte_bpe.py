"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A piece starts as single bytes.  Leaf i of the tree holds the rank of the pair
that starts at live node i, joined with i so that the root is the leftmost
pair of minimum rank.  A merge changes the leaves of the merged node, of the
node that vanishes and of the left neighbour: three point updates of
logarithmic cost, cut short where a parent does not change.

Edge cases: a null text is empty; an empty text has no ids and the digest of
the empty string; a very long text is cut into pieces lazily; bytes that are
not UTF-8 are read with replacement characters; repeated rows and null ids each
give their own row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from siltstone.llm.arrowrows import give_back, slices, with_bytes

INF = 1 << 62
#: For rows: no pair; key = rank * POSITIONS + position.
INF32, POSITIONS = 1 << 40, 64
#: Pieces remembered in each of two generations, per Python worker, and pieces merged at once.
REMEMBERED, TOGETHER = 1 << 17, 1 << 13
#: Bytes of text encoded at once by ``round_trip``, whose worker runs beside all that a pipeline has left in memory.
SLICE = 1 << 20
#: Longer texts are cut into pieces lazily, so many at a time.
LONG_TEXT, AT_A_TIME = 1 << 20, 1 << 17
#: Pieces of up to this many bytes are merged side by side, one numpy row each.
ROW = 33


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairRanks:
    """Rank of the token that two adjacent tokens form, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        codes = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        self.bits = max(10, (4 * len(codes)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.zeros(1 << self.bits, np.int64)
        todo, at = np.arange(len(codes)), self._slot(codes)
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]] = codes[todo[free]]
            placed = self.keys[at] == codes[todo]
            self.ranks[at[placed]] = np.array(rank, np.int64)[todo[placed]]
            todo, at = todo[~placed], (at[~placed] + 1) & (len(self.keys) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        codes = (left.astype(np.int64) << 32) | right
        at = self._slot(codes)
        held = self.keys[at]
        out = np.where(held == codes, self.ranks[at], none)
        todo = np.flatnonzero((held != codes) & (held >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.keys) - 1)
            held = self.keys[at]
            hit = held == codes[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (held >= 0)
            todo, at = todo[on], at[on]
        return out


class ByteBPE:
    """An encoder for one table of ranks and one pre-tokenising pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.names = [str(i) for i in range(len(self.bytes_of))]
        self._pairs = PairRanks(ranks)
        self._bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        # ids as bytes of int32: a fraction of a tuple's memory
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token of any length."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        n = len(piece)
        width = 1 << max(0, n - 2).bit_length() if n > 2 else 1
        tree = [INF] * (2 * width)
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                tree[width + i] = r * n + i
        for t in range(width - 1, 0, -1):
            a, b = tree[2 * t], tree[2 * t + 1]
            tree[t] = a if a < b else b
        after = list(range(1, n + 2))  # start of the next live node
        before = list(range(-1, n))

        def put(i: int, value: int) -> None:
            t = width + i
            tree[t] = value
            while t > 1:
                least, other = tree[t], tree[t ^ 1]
                if other < least:
                    least = other
                t >>= 1
                if tree[t] == least:
                    return
                tree[t] = least

        while (least := tree[1]) < INF:
            i = least % n
            gone = after[i]
            end = after[gone]
            after[i] = end
            if gone < n - 1:
                put(gone, INF)
            if end < n:
                before[end] = i
                r = ranks.get(piece[i : after[end]])
                put(i, INF if r is None else r * n + i)
            else:
                put(i, INF)
            left = before[i]
            if left >= 0:
                r = ranks.get(piece[left:end])
                put(left, INF if r is None else r * n + left)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def merge_rows(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """``merge`` for pieces of 2 to ROW bytes."""
        return [tuple(np.frombuffer(ids, np.int32).tolist()) for ids in self._merge_rows(pieces)]

    def _merge_rows(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces of 2 to ROW bytes as int32: one segment tree a row, updated side by side."""
        size = np.array([len(p) for p in pieces])
        width = max(2, 1 << int(size.max() - 2).bit_length())
        rows, cols = len(pieces), width + 2
        none = INF32 // POSITIONS
        raw = np.zeros((rows, cols), np.uint8)
        inside = np.arange(cols) < size[:, None]
        raw[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        token = np.where(inside, self._bytes[raw], -1).ravel()
        after = np.tile(np.arange(1, cols + 1), (rows, 1)).ravel()
        before = np.tile(np.arange(-1, cols - 1), (rows, 1)).ravel()
        tree = np.full((rows, 2 * width), INF32, np.int64)
        ok = inside[:, 1 : width + 1]
        grid = token.reshape(rows, cols)
        first = self._pairs.of(grid[:, :width][ok], grid[:, 1 : width + 1][ok], none)
        leaf = np.full((rows, width), INF32, np.int64)
        leaf[ok] = np.where(first == none, INF32, first * POSITIONS + np.nonzero(ok)[1])
        tree[:, width:] = leaf
        level = width
        while level > 1:
            tree[:, level // 2 : level] = tree[:, level : 2 * level].reshape(rows, -1, 2).min(axis=2)
            level //= 2
        tree = tree.ravel()

        def put(root: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
            t = at + width
            tree[root + t] = value
            while len(t) and width > 1 and t[0] > 1:
                t = t >> 1
                tree[root + t] = np.minimum(tree[root + 2 * t], tree[root + 2 * t + 1])

        live = np.arange(rows)
        while True:
            top = tree[live * (2 * width) + 1]
            on = top < INF32
            live, top = live[on], top[on]
            if not len(live):
                break
            root, line = live * (2 * width), live * cols
            i, made = top % POSITIONS, top // POSITIONS
            gone = after[line + i]
            end = after[line + gone]
            token[line + i] = made
            token[line + gone] = -1
            after[line + i] = end
            before[line + end] = i
            held = gone < width
            put(root[held], gone[held], INF32)
            more = end < size[live]
            rank = np.full(len(live), none)
            rank[more] = self._pairs.of(made[more], token[(line + end)[more]], none)
            put(root, i, np.where(rank == none, INF32, rank * POSITIONS + i))
            left = before[line + i]
            has = left >= 0
            left, root, line, made = left[has], root[has], line[has], made[has]
            rank = self._pairs.of(token[line + left], made, none)
            put(root, left, np.where(rank == none, INF32, rank * POSITIONS + left))
        grid = token.reshape(rows, cols)
        kept = grid >= 0
        flat = grid[kept].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Remembers the ids of all these pieces."""
        young, old = self._young, self._old
        if len(young) >= REMEMBERED:
            young, old = self._young, self._old = {}, young
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces.difference(young):
            if (ids := old.get(p)) is not None:
                young[p] = ids
                continue
            raw = p.encode("utf-8")
            if (whole := self.ranks.get(raw)) is not None:
                young[p] = np.int32(whole).tobytes()
            elif len(raw) > ROW:
                young[p] = np.array(self.merge(raw), np.int32).tobytes()
            else:
                by_width.setdefault((len(raw) - 2).bit_length(), []).append((p, raw))
        for group in by_width.values():
            for at in range(0, len(group), TOGETHER):
                part = group[at : at + TOGETHER]
                young.update(zip([p for p, _ in part], self._merge_rows([r for _, r in part])))
        return young

    def encode_many(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text; pieces that are new are merged together."""
        found = [self.pattern.findall(t) if len(t) < LONG_TEXT else None for t in texts]
        known = self._learn(set().union(*(f for f in found if f is not None)))
        for i, (text, pieces) in enumerate(zip(texts, found)):
            if pieces is not None:
                ids = b"".join(map(known.__getitem__, pieces))
                found[i] = None
            else:
                parts, matches = [], (m.group() for m in self.pattern.finditer(text))
                while part := list(islice(matches, AT_A_TIME)):
                    parts.append(b"".join(map(self._learn(set(part)).__getitem__, part)))
                ids = b"".join(parts)
            yield np.frombuffer(ids, np.int32).tolist()

    def encode(self, text: str) -> list[int]:
        return next(self.encode_many([text]))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_encoders: dict[tuple[str, str], ByteBPE] = {}


def encoder(path: str, pattern: str) -> ByteBPE:
    """The encoder for a vocabulary file, read once in each Python process."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _encoders[path, pattern]


def _texts(b: pa.RecordBatch) -> list[str]:
    return [x.as_py().decode("utf-8", "replace") for x in b.column("data")]


def encode_table(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of its text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for b in slices(batches):
            ids = pa.array([np.array(x, np.int32) for x in bpe.encode_many(_texts(b))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return with_bytes(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_table(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of a table of ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for b in batches:
            data = [bpe.decode(x.as_py() or ()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode, decode, and digest both; with ``with_ids`` the ids are returned too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        give_back()
        for b in slices(batches, SLICE):
            n, a, z, kept = [], [], [], []
            for ids in bpe.encode_many(_texts(b)):
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest())
                z.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(np.array(ids, np.int32))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(z, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return with_bytes(docs).mapInArrow(run, schema + ", ids array<int>" * with_ids)
