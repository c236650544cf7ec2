import gzip
import os
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.functions import chunkers
from siltstone.sources import archives


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([0, 1, 6, 9]), st.booleans())
def test_tokens_round_trip(data, level, fixed):
    c = zlib.compressobj(level, zlib.DEFLATED, -15, 9, zlib.Z_FIXED if fixed else zlib.Z_DEFAULT_STRATEGY)
    s = c.compress(data) + c.flush()
    assert archives.stream_of(*archives.tokens_of(s + b"rest")) == s + b"rest"


def test_escape_byte():
    for data in (bytes([0xAA]) * 700, b"\xaa\xffx\xaa"):
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        s = c.compress(data) + c.flush()
        assert archives.stream_of(*archives.tokens_of(s)) == s


def test_gzip_header_with_extra_field():
    plain = gzip.compress(b"hello" * 50)
    extra = plain[:3] + bytes([plain[3] | 4]) + plain[4:10] + b"\x03\x00abc" + plain[10:]
    at, n = archives.gzip_payload(extra)
    assert zlib.decompress(extra[at : at + n], -15) == b"hello" * 50


@pytest.mark.parametrize("cut", [lambda x: chunkers.fastcdc(x, 256, 512, 1024), lambda x: chunkers.rabin_karp(x, 256, 1024)])
def test_chunkers_cover(cut):
    for n in (0, 1, 100, 5000, 60000):
        data = os.urandom(n)
        spans = cut(data)
        assert b"".join(data[a : a + k] for a, k in spans) == data
        assert all(k <= 1024 for _, k in spans)


def test_chunks_survive_an_insertion():
    data = os.urandom(60000)
    a = {data[x : x + n] for x, n in chunkers.fastcdc(data, 256, 512, 1024)}
    moved = b"zz" + data
    b = {moved[x : x + n] for x, n in chunkers.fastcdc(moved, 256, 512, 1024)}
    assert len(a & b) > 0.8 * len(a)


def test_super_features_of_near_blocks():
    data = bytearray(os.urandom(4096))
    a = chunkers.super_features(bytes(data))
    data[100] ^= 1
    assert set(a) & set(chunkers.super_features(bytes(data)))


def test_tar_round_trip(spark):
    rows = [(1, "a", 0o644, b"x"), (1, "a", 0o600, b"y"), (1, "b/c", 0o755, b""), (2, "q", 0o644, b"zz")]
    e = spark.createDataFrame(rows, "layer long, path string, mode int, data binary")
    got = {(r.layer, r.path, bytes(r.data)) for r in archives.unpack_layers(archives.pack_layers(e)).collect()}
    assert got == {(1, "a", b"x"), (1, "a-2", b"y"), (1, "b/c", b""), (2, "q", b"zz")}


def test_long_form_of_258():
    """A fixed block: 'a', a copy of 258 in the long form (symbol 284, extra bits 31) at distance 1, end."""
    w = archives.Writer()
    lit, dist = (archives.canonical(t) for t in archives.FIXED)
    w.put(1, 1), w.put(1, 2)
    w.put(*lit[ord("a")]), w.put(*lit[284]), w.put(31, 5), w.put(*dist[0]), w.put(*lit[285]), w.put(*dist[0]), w.put(*lit[256])
    w.align()
    s = bytes(w.out)
    assert zlib.decompress(s, -15) == b"a" * 517
    assert archives.stream_of(*archives.tokens_of(s)) == s


def test_containers():
    data = os.urandom(500) + b"abc" * 500
    for fields in range(0, 32, 2):
        m = archives.gzip_member(data, fields)
        assert gzip.decompress(m) == data and archives.unpack_member(archives.pack_member(m)) == m
    z = zlib.compress(data)
    assert archives.unpack_member(archives.pack_member(z)) == z


def test_unreadable_layers_give_a_row(spark):
    df = spark.createDataFrame([(1, b"nothing"), (2, None), (3, gzip.compress(b"x" * 600)[:20])], "layer long, content binary")
    assert {r.layer for r in archives.read_entries(df).where("error IS NOT NULL").collect()} == {1, 2, 3}
    assert {r.layer: r.ok for r in archives.gunzip(df).collect()} == {1: False, 2: True, 3: False}


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000), st.binary(max_size=2000), st.integers(0, 1 << 20))
def test_delta_round_trip(data, source, n):
    source = source + data[n % (len(data) + 1) :] + source
    assert chunkers.delta_decode(chunkers.delta_encode(data, source), source) == data


def test_delta_reads_the_whole_source():
    source = os.urandom(100_000)
    for piece in (source, source[:20_000], source[-20_000:], source[40_000:60_000]):
        assert chunkers.delta_size(piece, source) < 60


def test_rolling_features_are_polynomial_hashes():
    data = os.urandom(1200)
    for f, best in enumerate(chunkers.rolling_features(data)):
        part = data[f * 100 : f * 100 + 100]
        want = 0
        for i in range(100 - 47):
            h = 0
            for b in part[i : i + 48]:
                h = (h * 37 + b) % 1_000_000_007
            want = max(want, h)
        assert best == want
