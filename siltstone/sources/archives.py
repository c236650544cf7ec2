"""gzip members, tar archives and a token view of DEFLATE streams."""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the DEFLATE format (RFC 1951, 3.2.5 and 3.2.7).
LENGTH_BASE = [3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 15, 17, 19, 23, 27, 31, 35, 43, 51, 59, 67, 83, 99, 115, 131, 163, 195, 227, 258]
LENGTH_BITS = [0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4, 5, 5, 5, 5, 0]
DIST_BASE = [1, 2, 3, 4, 5, 7, 9, 13, 17, 25, 33, 49, 65, 97, 129, 193, 257, 385, 513, 769, 1025, 1537, 2049, 3073, 4097, 6145, 8193, 12289, 16385, 24577]
DIST_BITS = [0, 0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13]
CODE_ORDER = [16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15]
ESCAPE, END = 0xAA, 0xFF
#: Marks a copy of 258 bytes in the long form; the high byte of a distance is 127 at most.
LONG_258 = 0xFE


def files(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder with their bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def gzip_payload(data: bytes) -> tuple[int, int]:
    """(offset, length) of the DEFLATE stream of a gzip member: the optional fields are passed over in full."""
    if data[:2] != b"\x1f\x8b":
        raise ValueError("not a gzip member")
    flags, at = data[3], 10
    if flags & 4:
        at += 2 + struct.unpack_from("<H", data, at)[0]
    for bit in (8, 16):
        if flags & bit:
            at = data.index(b"\0", at) + 1
    if flags & 2:
        at += 2
    return at, len(data) - at - 8


#: Kinds of entries that a tar layer may have.
ENTRY_KINDS = ((tarfile.TarInfo.isreg, "file"), (tarfile.TarInfo.isdir, "dir"), (tarfile.TarInfo.issym, "symlink"), (tarfile.TarInfo.islnk, "link"))


def read_entries(layers: DataFrame) -> DataFrame:
    """Rows (layer, path, kind, mode, size, target, data, error) of the entries of tar or tar.gz payloads (layer, content).

    A payload that cannot be read gives what came before the fault and one row with the error.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["layer", "path", "kind", "mode", "size", "target", "data", "error"]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.string())
        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(x.as_py() or b""), mode="r:*") as tar:
                        for m in tar:
                            kind = next((name for test, name in ENTRY_KINDS if test(m)), "other")
                            data = tar.extractfile(m).read() if kind == "file" else None
                            rows.append((d, m.name, kind, m.mode, m.size, m.linkname or None, data, None))
                except (tarfile.TarError, EOFError, OSError, zlib.error) as e:
                    rows.append((d, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names)

    return layers.select("layer", "content").mapInArrow(
        run, "layer long, path string, kind string, mode int, size long, target string, data binary, error string"
    )


def unpack_layers(layers: DataFrame) -> DataFrame:
    """Rows (layer, path, mode, size, data) of the regular files; see ``read_entries`` for the rest."""
    return read_entries(layers).where("kind = 'file'").select("layer", "path", "mode", "size", "data")


def pack_layers(entries: DataFrame) -> DataFrame:
    """One tar.gz payload for each layer; equal paths are kept apart by a counter."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, seen = io.BytesIO(), {}
        with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as z, tarfile.open(fileobj=z, mode="w") as tar:
            for path, mode, data in pdf.sort_values("path")[["path", "mode", "data"]].itertuples(index=False):
                n = seen[path] = seen.get(path, 0) + 1
                info = tarfile.TarInfo(path if n == 1 else f"{path}-{n}")
                info.size, info.mode = len(data), int(mode)
                tar.addfile(info, io.BytesIO(data))
        return pd.DataFrame({"layer": [pdf["layer"].iloc[0]], "content": [out.getvalue()]})

    return entries.select("layer", "path", "mode", "data").groupBy("layer").applyInPandas(run, "layer long, content binary")


class Bits:
    """Reads bits, the low ones of a byte first; ``at`` is the place of the next one."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return (int.from_bytes(self.data[first : first + 4], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        return v


class Writer:
    def __init__(self):
        self.out, self.acc, self.n = bytearray(), 0, 0

    def put(self, value: int, bits: int) -> None:
        self.acc |= value << self.n
        self.n += bits
        while self.n >= 8:
            self.out.append(self.acc & 255)
            self.acc >>= 8
            self.n -= 8

    def align(self) -> None:
        if self.n:
            self.put(0, 8 - self.n)


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Symbol to (code with its bits in stream order, length)."""
    code, out = 0, {}
    for n in range(1, max(lengths, default=0) + 1):
        for s, length in enumerate(lengths):
            if length == n:
                out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
                code += 1
        code <<= 1
    return out


def lookup(lengths: list[int]) -> tuple[list[tuple[int, int]], int]:
    """(symbol, length) for every value of the next bits, and how many bits those are."""
    width = max(lengths, default=0) or 1
    out = [(-1, 0)] * (1 << width)
    for s, (code, n) in canonical(lengths).items():
        for v in range(code, 1 << width, 1 << n):
            out[v] = (s, n)
    return out, width


def _symbol(bits: Bits, table: tuple[list[tuple[int, int]], int]) -> int:
    s, n = table[0][bits.peek(table[1])]
    if s < 0 or bits.at + n > 8 * len(bits.data):
        raise ValueError("no code for these bits")
    bits.at += n
    return s


def _dynamic(bits: Bits) -> tuple[list[int], list[int]]:
    n_lit, n_dist, n_code = bits.take(5) + 257, bits.take(5) + 1, bits.take(4) + 4
    lens = [0] * 19
    for s in CODE_ORDER[:n_code]:
        lens[s] = bits.take(3)
    table = lookup(lens)
    all_: list[int] = []
    while len(all_) < n_lit + n_dist:
        s = _symbol(bits, table)
        if s < 16:
            all_.append(s)
        elif s == 16:
            all_ += [all_[-1]] * (3 + bits.take(2))
        else:
            all_ += [0] * (3 + bits.take(3) if s == 17 else 11 + bits.take(7))
    return all_[:n_lit], all_[n_lit:]


FIXED = ([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8, [5] * 30)


def tokens_of(stream: bytes) -> tuple[bytes, list[tuple[bytes, int]], bytes]:
    """Tokens of a DEFLATE stream without its copies expanded, its block headers (bytes, bits), and what follows it.

    A literal stands for itself; ``AA AA`` is the literal AA, ``AA hi lo n``
    a copy of n + 3 bytes from that distance, ``AA FE hi lo`` one of 258 bytes
    in the long form, ``AA FF`` the end of a block.
    """
    bits, out, heads, last = Bits(stream), bytearray(), [], False
    while not last:
        start = bits.at
        last, kind = bool(bits.take(1)), bits.take(2)
        if kind == 0:
            bits.at = (bits.at + 7) // 8 * 8
            n = bits.take(16)
            bits.take(16)
        else:
            lit, dist = FIXED if kind == 1 else _dynamic(bits)
        size = bits.at - start
        heads.append((int("".join(str((stream[i >> 3] >> (i & 7)) & 1) for i in range(start, bits.at))[::-1], 2).to_bytes((size + 7) // 8, "little"), size))
        if kind == 0:
            at = bits.at // 8
            for b in stream[at : at + n]:
                out += bytes((ESCAPE, ESCAPE)) if b == ESCAPE else bytes((b,))
            bits.at += 8 * n
        else:
            lits, dists = lookup(lit), lookup(dist)
            while (s := _symbol(bits, lits)) != 256:
                if s < 256:
                    out += bytes((ESCAPE, ESCAPE)) if s == ESCAPE else bytes((s,))
                    continue
                n = LENGTH_BASE[s - 257] + bits.take(LENGTH_BITS[s - 257])
                d = _symbol(bits, dists)
                far = DIST_BASE[d] + bits.take(DIST_BITS[d]) - 1
                if s == 284 and n == 258:
                    out += bytes((ESCAPE, LONG_258, far >> 8, far & 255))
                else:
                    out += bytes((ESCAPE, far >> 8, far & 255, n - 3))
        out += bytes((ESCAPE, END))
    return bytes(out), heads, stream[(bits.at + 7) // 8 :]


def stream_of(tokens: bytes, heads: list[tuple[bytes, int]], rest: bytes) -> bytes:
    """The stream that ``tokens_of`` read, bit for bit."""
    w, at = Writer(), 0
    for raw, size in heads:
        w.put(int.from_bytes(raw, "little"), size)
        bits = Bits(raw + bytes(4))
        bits.take(1)
        kind = bits.take(2)
        if kind:
            lit, dist = (canonical(t) for t in (FIXED if kind == 1 else _dynamic(bits)))
        while True:
            b = tokens[at]
            at += 1
            if b == ESCAPE:
                nxt = tokens[at]
                if nxt == END:
                    at += 1
                    break
                if nxt != ESCAPE:
                    if nxt == LONG_258:
                        far, n, s = tokens[at + 1] << 8 | tokens[at + 2], 258, 27
                    else:
                        far, n = nxt << 8 | tokens[at + 1], tokens[at + 2] + 3
                        s = 28 if n == 258 else max(i for i in range(29) if LENGTH_BASE[i] <= n)
                    at += 3
                    w.put(*lit[257 + s])
                    w.put(n - LENGTH_BASE[s], LENGTH_BITS[s])
                    d = max(i for i in range(30) if DIST_BASE[i] <= far + 1)
                    w.put(*dist[d])
                    w.put(far + 1 - DIST_BASE[d], DIST_BITS[d])
                    continue
                at += 1
            if kind:
                w.put(*lit[b])
            else:
                w.put(b, 8)
        if kind:
            w.put(*lit[256])
    w.align()
    return bytes(w.out) + rest


def codec_report(layers: DataFrame, level: int = 6) -> DataFrame:
    """For each payload: size, DEFLATE size, token bytes, and whether re-encoding gives the same stream."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, x in zip(b.column(0).to_pylist(), b.column(1)):
                data = x.as_py() or b""
                c = zlib.compressobj(level, zlib.DEFLATED, -15)
                stream = c.compress(data) + c.flush()
                tokens, heads, rest = tokens_of(stream)
                rows.append((d, len(data), len(stream), len(tokens), stream_of(tokens, heads, rest) == stream))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], ["layer", "size", "deflated", "tokens", "identical"]
            )

    return layers.select("layer", "content").mapInArrow(run, "layer long, size long, deflated long, tokens long, identical boolean")


def pack_member(data: bytes) -> bytes:
    """A gzip member or zlib stream as one container: its header, tokens, block headers and trailer, each after its length."""
    if data[:2] == b"\x1f\x8b":
        at, n = gzip_payload(data)
        end = at + n
    else:
        at, end = 2, len(data) - 4
    tokens, heads, rest = tokens_of(data[at:end])
    parts = [data[:at], tokens, b"".join(struct.pack("<I", size) + raw for raw, size in heads), rest + data[end:]]
    return b"".join(struct.pack("<I", len(p)) + p for p in parts)


def unpack_member(container: bytes) -> bytes:
    parts, at = [], 0
    for _ in range(4):
        (n,) = struct.unpack_from("<I", container, at)
        parts.append(container[at + 4 : at + 4 + n])
        at += 4 + n
    heads, at = [], 0
    while at < len(parts[2]):
        (size,) = struct.unpack_from("<I", parts[2], at)
        n = (size + 7) // 8
        heads.append((parts[2][at + 4 : at + 4 + n], size))
        at += 4 + n
    return parts[0] + stream_of(parts[1], heads, b"") + parts[3]


def gzip_member(data: bytes, fields: int = 0, level: int = 6) -> bytes:
    """A gzip member; the bits of ``fields`` say which optional fields it has (2 check, 4 extra, 8 name, 16 comment)."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    head = b"\x1f\x8b\x08" + bytes([fields]) + bytes(6)
    head += struct.pack("<H", 5) + b"extra" if fields & 4 else b""
    head += b"name\0" if fields & 8 else b""
    head += b"comment\0" if fields & 16 else b""
    head += struct.pack("<H", zlib.crc32(head) & 0xFFFF) if fields & 2 else b""
    return head + c.compress(data) + c.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def container_report(layers: DataFrame) -> DataFrame:
    """Whether payloads, as gzip members with the optional fields in turn or as zlib streams, come back bit for bit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, x in zip(b.column(0).to_pylist(), b.column(1)):
                data = x.as_py() or b""
                turn = (d or 0) % 17
                member = zlib.compress(data, 6) if turn == 16 else gzip_member(data, 2 * turn, 1 + turn % 9)
                rows.append((d, len(data), unpack_member(pack_member(member)) == member))
            kinds = (pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], ["layer", "size", "identical"])

    return layers.select("layer", "content").mapInArrow(run, "layer long, size long, identical boolean")


def gzipped(layers: DataFrame, level: int = 6) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([gzip.compress(x.as_py() or b"", level, mtime=0) for x in b.column(1)], pa.binary())], ["layer", "content"])

    return layers.select("layer", "content").mapInArrow(run, "layer long, content binary")


def gunzip(layers: DataFrame) -> DataFrame:
    """Contents of gzip payloads of one or more members; one that cannot be read has no content and ``ok`` false."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes | None] = []
            for x in b.column(1):
                try:
                    out.append(gzip.decompress(x.as_py() or b""))
                except (OSError, EOFError, zlib.error):
                    out.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out, pa.binary()), pa.array([o is not None for o in out], pa.bool_())], ["layer", "content", "ok"]
            )

    return layers.select("layer", "content").mapInArrow(run, "layer long, content binary, ok boolean")


def layers_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("layer"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"))
