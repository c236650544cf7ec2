import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone.operators import pairblocks, similarity
from siltstone.plans import catalogue


def hashes(rng, n, kinds):
    base = [rng.getrandbits(64) for _ in range(kinds)]
    return [rng.choice(base) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, 0, h & 0xFFFFFFFF, h >> 32) for i, h in rows], "vec_id long, label int, w0 long, w1 long")


@pytest.mark.parametrize("newest", [False, True])
def test_nearest_before_is_brute_force(spark, newest):
    """The least distance over the blocks, with ties, copies and rows without a hash, and a row for each block at most."""
    rng = random.Random(1)
    rows = [(7 * i - 100, h) for i, h in enumerate(hashes(rng, 400, 30))]
    df = frame(spark, rows).union(spark.createDataFrame([(-500, 0, None, 1), (5000, 0, 1, None)], "vec_id long, label int, w0 long, w1 long"))
    got = pairblocks.nearest_before(df, newest=newest, blocks=3).collect()
    assert len(got) <= 3 * len(rows)
    sign = -1 if newest else 1
    best = {}
    for r in got:
        best[r.vec_id] = min(best.get(r.vec_id, (99, 0)), (r.dist, sign * r.neighbour))
    want = {i: min(((h ^ g).bit_count(), sign * j) for j, g in rows[:k]) for k, (i, h) in enumerate(rows) if k}
    assert best == want


@pytest.mark.parametrize("name", ["best_reference", "two_tier_search"])
def test_pairs_are_not_joined_rows(spark, name):
    """No join compares the keys of a pair: a pair stays inside a cell (before, each was a joined row that was sorted or grouped)."""
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert joins and not any(re.search(r"[<>]|bit_count", x) for x in joins)


def test_two_tiers_over_copies(spark):
    """All copies in one bucket: the newest copy is found, and its tier goes by the gap."""
    rows = [(i, 5 if i in (0, 300, 310) else (1 << 40) + (i << 20)) for i in range(311)]
    got = {r.vec_id: (r.neighbour, r.dist, r.tier) for r in similarity.two_tier(frame(spark, rows).withColumn("n", F.col("vec_id") + 1), 15).collect()}
    assert got[310] == (300, 0, "buffer") and got[300][1] <= 15
    want = {}
    for i, h in rows:
        near = min((((h ^ g).bit_count(), -j) for j, g in rows[:i]), default=(99, 0))
        if near[0] <= 15:
            want[i] = (-near[1], near[0], "buffer" if i + near[1] <= 128 else "index")
    assert got == want


@pytest.mark.parametrize("name", ["vector_distances", "normalised_distances"])
def test_odd_vectors_as_in_sql(spark, tmp_path, name):
    """Zero vectors, copies, missing vectors and missing components (zero vectors were an error before)."""
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(64)], 0) for i in range(60)]
    rows[20] = (20, [0.0] * 64, 0)
    rows[21] = (21, [0.0] * 64, 0)
    rows[40] = (40, rows[41][1], 0)
    if name == "vector_distances":
        rows[5] = (5, None, 0)
        rows[6] = (6, [None, *rows[6][1][1:]], 0)
    rows.append((None, rows[7][1], 0))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = catalogue.queries()[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = c.sql(catalogue.oracle_sql()[name])
    known = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v
    key = lambda r: tuple(str(known(v)) for v in r)
    assert sorted(key([r[x] for x in want.columns]) for r in df.collect()) == sorted(map(key, want.fetchall()))


def test_rounding_is_half_away_from_zero():
    import numpy as np

    got = pairblocks.rounded(np.array([0.00005, 0.03125, -0.03125, -1e-16, 2.5, 0.90625, 1.23454999]))
    assert got.tolist() == [0.0001, 0.0313, -0.0313, 0.0, 2.5, 0.9063, 1.2345] and math.copysign(1, got[3]) == 1
