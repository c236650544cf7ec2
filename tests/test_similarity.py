import random

from pyspark.sql import functions as F

from siltstone.functions import chunkers
from siltstone.operators import cachesim, cluster, placement, similarity, trace
from siltstone.operators.ranking import global_row_number
from siltstone.plans import catalogue


def frame(spark, rows):
    return spark.createDataFrame([(i, 0, a, b) for i, (a, b) in enumerate(rows)], "vec_id long, label int, w0 long, w1 long")


def test_banded_equals_grid(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    rows = []
    for _ in range(60):
        v = base
        for k in rng.sample(range(64), rng.randint(0, 6)):
            v ^= 1 << k
        rows.append((v & 0xFFFFFFFF, v >> 32))
    h = frame(spark, rows)
    got = lambda df: {(r.a, r.b, r.dist) for r in df.collect()}
    assert got(similarity.hamming_banded(h, 4)) == got(similarity.hamming_pairs(h, 4)) != set()


def test_components_of_a_chain(spark):
    n = 40
    nodes = spark.range(n + 1).withColumnRenamed("id", "vec_id")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    got = {r.vec_id: r.cluster for r in cluster.components(nodes, edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, n: n}


def test_newest_wins_ties(spark):
    h = frame(spark, [(1, 0), (1, 0), (1, 0)])
    got = {(r.vec_id, r.neighbour, r.rank) for r in similarity.nearest_earlier(h, 1, 5).collect()}
    assert got == {(1, 0, 1), (2, 1, 1)}


def test_any_super_feature_finds_a_reference(spark):
    rows = [(1, "a", "p", "u", "x"), (2, "b", "p", "v", "y"), (3, "a", "p", "w", "y"), (4, "c", "q", "v", "x"), (5, "d", "r", "t", "y"), (6, "e", "s", "z", "k")]
    sf = spark.createDataFrame(rows, "doc_id long, sf0 string, sf1 string, sf2 string, sf3 string")
    got = {r.doc_id: r.reference for r in similarity.newest_earlier(sf, "sf0", "sf1", "sf2", "sf3").collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: 2, 5: 3, 6: None}


def test_compress_strategy_tries_every_super_feature(spark):
    """The query's totals are those of a plain OR over the four super-feature tables."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text")
    text = {r.doc_id: r.text.encode() for r in docs.collect()}
    newest, ref, only_first = [{} for _ in range(4)], {}, 0
    for r in sorted(similarity.superfeatures(docs).collect(), key=lambda r: r.doc_id):
        hits = [newest[k].get(r[f"sf{k}"]) for k in range(4)]
        ref[r.doc_id] = next((h for h in hits if h is not None), None)
        only_first += hits[0] is None and ref[r.doc_id] is not None
        for k in range(4):
            newest[k][r[f"sf{k}"]] = r.doc_id
    assert only_first
    seen, want = set(), {}
    for i in sorted(text):
        options = [(len(text[i]), "raw"), (chunkers.self_size(text[i]), "self")]
        if ref.get(i) is not None and text[ref[i]]:
            options.append((chunkers.delta_size(text[i], text[ref[i]]), "delta"))
        size, flag = (0, "dup") if text[i] in seen else min(options)
        seen.add(text[i])
        n, b, raw = want.get(flag, (0, 0, 0))
        want[flag] = (n + 1, b + size, raw + len(text[i]))
    got = {r.flag: (r.n, r.bytes, r.raw_bytes) for r in catalogue.queries()["compress_strategy"](spark, d).collect()}
    assert got == want


def test_query_distances_meet_every_vector(spark):
    rng = random.Random(3)
    v = {i: [rng.uniform(-1, 1) for _ in range(4)] for i in range(45)}
    df = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<float>")
    got = {(r.q, r.vec_id): r.l1 for r in similarity.query_distances(df).collect()}
    assert set(got) == {(q, i) for q in (0, 20, 40) for i in v if i != q}
    assert all(abs(x - sum(abs(a - b) for a, b in zip(v[q], v[i]))) < 1e-3 for (q, i), x in got.items())


def test_caches():
    lru = cachesim.LRU(2)
    assert [lru.access(k) for k in "abacab"] == [False, False, True, False, True, False]
    lfu = cachesim.LFU(2)
    assert [lfu.access(k) for k in "aabcab"] == [False, True, False, False, True, False]
    arc = cachesim.ARC(2)
    assert [arc.access(k) for k in "aabca"] == [False, True, False, False, True]
    fifo = cachesim.FIFO(2, ttl=5)
    assert [fifo.access("a", now=t) for t in (0, 4, 6)] == [False, True, False]


def test_exact_lru_is_lru(spark):
    rng = random.Random(4)
    keys = [rng.randint(0, 12) for _ in range(300)]
    rows = spark.createDataFrame([("c", i, str(k)) for i, k in enumerate(keys)], "cache string, seq long, key string")
    assert cachesim.exact_lru(rows, 5).first().hits == cachesim.simulate(rows, "lru", 5).first().hits


def test_leader_clusters(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for _ in range(150):
        v = rng.choice(base)
        for k in rng.sample(range(64), rng.randint(0, 9)):
            v ^= 1 << k
        rows.append((v & 0xFFFFFFFF, v >> 32))
    reps, want = [], []
    for i, (a, b) in enumerate(rows):
        near = [((a ^ rows[r][0]).bit_count() + (b ^ rows[r][1]).bit_count(), r) for r in reps]
        if near and min(near)[0] <= 8:
            want.append(min(near)[1])
        else:
            reps.append(i)
            want.append(i)
    for block in (4096, 40):
        assert {r.vec_id: r.cluster for r in cluster.leader_clusters(frame(spark, rows), 8, block).collect()} == dict(enumerate(want))


def test_two_tiers_find_the_nearest_earlier(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    rows = []
    for _ in range(120):
        v = base
        for k in rng.sample(range(64), rng.randint(0, 8)):
            v ^= 1 << k
        rows.append((v & 0xFFFFFFFF, v >> 32))
    h = frame(spark, rows).withColumn("n", F.col("vec_id") + 1)
    got = {r.vec_id: (r.dist, r.neighbour, r.tier) for r in similarity.two_tier(h, 9, buffer=10).collect()}
    want = {}
    for i, (a, b) in enumerate(rows):
        near = [((a ^ rows[j][0]).bit_count() + (b ^ rows[j][1]).bit_count(), -j) for j in range(i)]
        if near and min(near)[0] <= 9:
            d, j = min(near)
            want[i] = (d, -j, "buffer" if i + j <= 10 else "index")
    assert got == want


def test_best_by_delta(spark):
    rng = random.Random(7)
    text = [bytes(rng.choices(b"abcdefgh ", k=400)) for _ in range(3)]
    items = [(i, text[i % 3][: 300 + i] + bytes(rng.choices(b"xyz", k=20))) for i in range(9)]
    got = {r.item_id: (r.reference, r.cost) for r in similarity.best_by_delta(spark.createDataFrame(items, "item_id long, data binary")).collect()}
    for i, x in items:
        own = chunkers.self_size(x)
        best = min(((chunkers.delta_size(x, y), j) for j, y in items if j < i), default=(1 << 30, None))
        assert got[i] == ((best[1], best[0]) if best[0] < own else (None, own))


def test_weighted_caches():
    rng = random.Random(8)
    gone = []
    for policy in cachesim.POLICIES.values():
        sim = policy(500)
        for _ in range(3000):
            sim.access(rng.randint(0, 60), rng.randint(1, 90))
        if isinstance(sim, cachesim.ARC):
            assert sim.w["t1"] + sim.w["t2"] <= 500 and {n: sum(v.values()) for n, v in sim.lists.items()} == sim.w and sum(sim.w.values()) <= 1000
        elif not isinstance(sim, cachesim.Tiers):
            assert sim.used <= 500
    lru = cachesim.LRU(2, gone.append)
    [lru.access(k) for k in "abc"]
    assert gone == ["a"]
    tiers = cachesim.Tiers(8)
    assert [tiers.access(k) for k in "abcabc"] == [False, False, False, True, True, True] and sum(tiers.hits) == 3


def test_ring_is_the_plain_ring(spark):
    import hashlib

    at = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    servers = [f"s{i}" for i in range(5)]
    ring = sorted((at(f"{s}#{i}"), s) for s in servers for i in range(8))
    keys = [str(i) for i in range(300)]
    got = placement.ring_placement(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(s,) for s in servers], "server string"))
    assert {r.key: r.server for r in got.collect()} == {k: next((s for p, s in ring if p >= at(k)), ring[0][1]) for k in keys}


def test_slots_are_greedy(spark):
    rows = [(i, "r", f"2024-01-01 00:00:{i:02d}", float(3 + i % 4)) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, repo string, ts string, duration double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.event_id: r.start for r in trace.assign_slots(df, 2).collect()}
    t0 = min(got.values())
    free = [0.0, 0.0]
    for i, _, _, d in rows:
        free.sort()
        start = max(free[0], float(i))
        free[0] = start + d
        assert abs(got[i] - t0 - start) < 1e-6


def test_kmeans_report(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(10 * (i % 3), 0.1) for _ in range(4)]) for i in range(60)]
    r = cluster.kmeans_report(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 3).first()
    assert (r.vectors, r.clusters, r.misplaced) == (60, 3, 0)


def test_row_numbers_at_size(spark):
    """Exactly 1..n over many partitions, with a payload that is not part of the order."""
    n = 1_200_000
    df = spark.range(0, n, 1, 9).select((F.col("id") * 7919 % n).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("payload"), F.lit(1).alias("part"))
    got = global_row_number(df, "key")
    assert got.select("key", "rn").agg(F.count_distinct("rn"), F.min("rn"), F.max("rn"), F.sum((F.col("rn") != F.col("key") + 1).cast("long"))).first() == (n, 1, n, 0)
