"""Words and shingles of UTF-8 texts as 64-bit codes, in numpy.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; A-Z count
as a-z where ``lower`` is set.  Codes depend on the bytes alone, so every
executor and every run gives the same ones.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
U64 = np.uint64
#: Pieces of about this many bytes are coded at a time; a longer word stays whole.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply and xor-shift rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_EXACT = mix(np.arange(1, 257, dtype=U64))
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]
_BASE = U64(0x9E3779B97F4A7C15)
_powers = {False: np.ones(1, U64), True: np.ones(1, U64)}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """At least ``n`` powers of the base, or of its inverse, modulo 2**64."""
    if len(_powers[inverse]) < n:
        base = U64(pow(int(_BASE), -1, 1 << 64)) if inverse else _BASE
        p = np.full(1 << max(8, (n - 1).bit_length()), base, U64)
        p[0] = 1
        _powers[inverse] = np.cumprod(p, dtype=U64)
    return _powers[inverse]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end."""
    space = np.ones(len(data) + 2, np.int8)
    space[1:-1] = SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(space))
    return edge[0::2], edge[1::2]


def _pieces(data: bytes):
    at, n = 0, len(data)
    while n - at > PIECE:
        end = at + PIECE
        rest = np.frombuffer(data, np.uint8, offset=end)
        step = 0
        while step < len(rest) and not SPACE[rest[step : step + PIECE]].any():
            step += PIECE
        end = n if step >= len(rest) else end + step + int(np.argmax(SPACE[rest[step : step + PIECE]]))
        yield data[at:end]
        at = end
    yield data[at:]


def word_codes(data: bytes, lower: bool = True) -> np.ndarray:
    """One code for each word, in order."""
    table = _LOWER if lower else _EXACT
    out = []
    for piece in _pieces(data) if len(data) > PIECE else (data,):
        starts, ends = word_spans(piece)
        if not len(starts):
            continue
        n = ends - starts
        first = np.cumsum(n) - n
        a = np.frombuffer(piece, np.uint8)
        codes = table[a[~SPACE[a]]]
        rel = np.arange(len(codes)) - np.repeat(first, n)
        out.append(mix(np.add.reduceat(codes * powers(int(n.max()))[rel], first) + n.astype(U64)))
    return np.concatenate(out) if out else np.empty(0, U64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Codes of the k-word windows; with fewer words, of the whole sequence; none without words."""
    if not len(words):
        return words
    k = min(k, len(words)) if len(words) < k else k
    n = len(words) - k + 1
    acc = np.full(n, U64(k), U64)
    for j in range(k):
        acc = mix(acc * _BASE + words[j : j + n])
    return acc
