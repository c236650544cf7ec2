"""Document quality from a byte-level convolutional network in numpy.

Bytes are embedded; filters of WIDTH bytes slide byte by byte (STEP = 1) over
chunks that overlap by more than a filter, so every window of WIDTH bytes of the
document is seen, wherever a pattern stands; each filter is max-pooled
over a chunk, the chunks' pools are joined as their maximum and their mean, and
a logistic layer turns that into one probability.  The network is fitted by
Adam on a bounded sample of training rows.

Edge cases: null and empty texts are one chunk of padding; without labels of
both kinds the score is constant (0.95 if all are 1, else 0.05); null ids and
repeated rows each give a row; an empty table gives none; very long texts are
worked off in blocks of chunks, in training as in scoring; of equal maxima the
first place counts; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.labelled import FOLDS, remainder, training_sample

DIM, WIDTH, STEP, FILTERS = 6, 8, 1, 24
CHUNK, OVERLAP = 1024, 64
#: Chunks convolved at a time.
AT_A_TIME = 32
THRESHOLD = 0.3
SAMPLE = 3000


def _chunks(data: bytes) -> np.ndarray:
    """Overlapping chunks of the padded bytes, one a row; the last is moved back to end with the text."""
    a = np.frombuffer(data, np.uint8)
    if len(a) <= CHUNK:
        n = max(WIDTH, -(-len(a) // STEP) * STEP)
        out = np.zeros((1, n), np.uint8)
        out[0, : len(a)] = a
        return out
    stride = CHUNK - OVERLAP
    starts = np.append(np.arange(0, len(a) - CHUNK, stride), len(a) - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(a, CHUNK)[starts]


class ByteCNN:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "w": rng.normal(0, 1 / np.sqrt(WIDTH * DIM), (WIDTH * DIM, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "o": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }

    def _windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunk, position, WIDTH * DIM) view of the embedded bytes."""
        x = self.p["e"][chunks]
        n, m = chunks.shape
        s = x.strides
        return np.lib.stride_tricks.as_strided(
            x, (n, (m - WIDTH) // STEP + 1, WIDTH * DIM), (s[0], STEP * s[1], s[2]), writeable=False
        )

    def _conv(self, chunks: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self._windows(chunks)).reshape(-1, WIDTH * DIM) @ self.p["w"]

    def pooled(self, data: bytes) -> np.ndarray:
        """Maximum and mean over all chunks of the chunks' pools."""
        chunks = _chunks(data)
        top, total = np.zeros(FILTERS, np.float32), np.zeros(FILTERS)
        for at in range(0, len(chunks), AT_A_TIME):
            part = chunks[at : at + AT_A_TIME]
            m = np.maximum(self._conv(part).reshape(len(part), -1, FILTERS).max(axis=1) + self.p["b"], 0)
            top = np.maximum(top, m.max(axis=0))
            total += m.sum(axis=0)
        return np.concatenate([top, (total / len(chunks)).astype(top.dtype)])

    def score(self, data: bytes) -> float:
        z = float(self.pooled(data) @ self.p["o"] + self.p["c"][0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def gradient(self, data: bytes, y: int, g: dict[str, np.ndarray]) -> float:
        """Adds the gradient of one document's log loss over all its chunks; gives the loss.

        The first pass keeps each chunk's maxima and their places, the second
        goes back to the bytes at those places only.
        """
        chunks = _chunks(data)
        n = len(chunks)
        m, arg = np.empty((n, FILTERS), self.p["b"].dtype), np.empty((n, FILTERS), np.int32)
        for lo in range(0, n, AT_A_TIME):
            part = chunks[lo : lo + AT_A_TIME]
            h = self._conv(part).reshape(len(part), -1, FILTERS)
            arg[lo : lo + len(part)] = a = h.argmax(axis=1)
            m[lo : lo + len(part)] = np.maximum(np.take_along_axis(h, a[:, None, :], 1)[:, 0] + self.p["b"], 0)
        best = m.argmax(axis=0)
        v = np.concatenate([m.max(axis=0), m.mean(axis=0, dtype=np.float64).astype(m.dtype)])
        p = 1 / (1 + np.exp(-np.clip(v @ self.p["o"] + self.p["c"][0], -30, 30)))
        d = m.dtype.type(p - y)
        g["o"] += d * v
        g["c"] += d
        top, mean = d * self.p["o"][:FILTERS], d * self.p["o"][FILTERS:] / n
        for lo in range(0, n, AT_A_TIME):
            part = chunks[lo : lo + AT_A_TIME]
            dm = np.repeat(mean[None], len(part), 0)
            here = (best >= lo) & (best < lo + len(part))
            dm[best[here] - lo, np.flatnonzero(here)] += top[here]
            dm *= m[lo : lo + len(part)] > 0
            g["b"] += dm.sum(axis=0)
            k, f = np.nonzero(dm)
            val = dm[k, f]
            at = part[k[:, None], arg[lo + k, f][:, None] * STEP + np.arange(WIDTH)]
            rows = self.p["e"][at].reshape(len(k), WIDTH * DIM)
            np.add.at(g["w"].T, f, val[:, None] * rows)
            np.add.at(g["e"], at, (val[:, None] * self.p["w"].T[f]).reshape(len(k), WIDTH, DIM))
        return float(-np.log(p + 1e-7) if y else -np.log(1 - p + 1e-7))


def fit(samples: list[tuple[bytes, int]], epochs: int = 3, batch: int = 16, rate: float = 0.01, seed: int = 7) -> ByteCNN:
    """A network for (text, label) rows."""
    net = ByteCNN(seed)
    positive = sum(y for _, y in samples)
    if not positive or positive == len(samples):
        net.p["o"][:] = 0
        net.p["c"][:] = 3.0 if positive else -3.0
        return net
    rows = samples
    net.p["c"][:] = np.log(positive / (len(rows) - positive))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    rng, t = np.random.default_rng(seed), 0
    steps = epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            g = {k: np.zeros_like(v) for k, v in net.p.items()}
            part = order[at : at + batch]
            for i in part:
                net.gradient(*rows[i], g)
            t += 1
            pace = rate * (1 - t / (steps + 1)) + 1e-4
            for k, v in net.p.items():
                grad = g[k] / len(part)
                m, s = moments[k]
                m[:] = 0.9 * m + 0.1 * grad
                s[:] = 0.99 * s + 0.01 * grad * grad
                v -= (pace * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame) -> ByteCNN:
    return fit(training_sample(docs, labels, "quality", SAMPLE))


def score_column(net: ByteCNN, text: str | Column = "text") -> Column:
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([net.score(x.as_py() or b"") for x in b], pa.float64())

    c = F.col(text) if isinstance(text, str) else text
    return score(c.cast("string").cast("binary"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    net = train(docs, labels)
    rows = docs.select("doc_id", score_column(net).alias("score"))
    return rows.select(
        "doc_id",
        (remainder("doc_id", FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
