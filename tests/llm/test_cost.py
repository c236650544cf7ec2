"""What the hot parts of op5, op6 and of the pipeline's last stage cost in time and memory."""

import random
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pytest

from siltstone.llm import byte_bpe, katz, suffix_dedup
from siltstone.llm.queries import VOCABULARY


@pytest.mark.parametrize("most", [40, 1 << 20, 1 << 45])
def test_distinct_ngrams(most):
    """Packed and unpacked keys give the rows and places of a plain unique."""
    rng = np.random.default_rng(1)
    rows = [rng.integers(0, m, 5000) for m in (12, most, most)]
    first, place = katz._distinct(*rows)
    want, at = np.unique(np.stack(rows, 1), axis=0, return_inverse=True)
    assert (np.stack([x[first] for x in rows], 1) == want).all() and (place == at.ravel()).all()


def test_distinct_ngrams_are_sorted_fast():
    """A stable sort of whole keys was most of the time of a block; every order of a block sorts again."""
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, m, 600_000) for m in (16, 1 << 18, 1 << 18)]
    key = (rows[0] << 36) | (rows[1] << 18) | rows[2]

    def least(f):
        took = []
        for _ in range(5):
            began = time.perf_counter()
            f()
            took.append(time.perf_counter() - began)
        return min(took)

    assert least(lambda: katz._distinct(*rows)) < 0.9 * least(lambda: np.unique(key, return_index=True, return_inverse=True))


def test_small_numbers_of_any_size():
    for v in ([], [0], [127, 128, 16383, 16384, 2**31, 2**32 - 1, 2**32, 2**55, 2**62, 0], range(100_000)):
        assert katz.unpack_small(katz.pack_small(np.array(v, np.int64))).tolist() == list(v)


def test_remembered_pieces_are_small():
    """Under 200 bytes for each piece that the encoder remembers (tuples of ints: 286), with the ids of a plain merge."""
    bpe = byte_bpe.ByteBPE(byte_bpe.read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(20_000)]
    tracemalloc.start()
    bpe.encode(" ".join(words))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(bpe._young) >= 19_000 and held / len(bpe._young) < 200
    ids = bpe.encode(" ".join(words))
    plain = [r for i, w in enumerate(words[:300]) for r in bpe.merge((" " * (i > 0) + w).encode())]
    assert ids[: len(plain)] == plain and all(type(i) is int for i in ids[:10])


def test_repeats_of_short_texts_cost_no_more_than_of_long_ones(spark):
    """A stage over a block takes its bytes together: 33,000 short texts took several times as long as one text of their length."""
    rng = random.Random(4)
    x = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=2_000_000))

    def least(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        block = suffix_dedup.blocks(df).toArrow().to_batches()
        took = []
        for _ in range(3):
            began = time.process_time()
            assert sum(b.num_rows for b in suffix_dedup._ask_prints(4)(block)) > 0
            took.append(time.process_time() - began)
        return min(took)

    assert least([x[i : i + 60] for i in range(0, len(x), 60)]) < 5 * least([x])
