import pytest
from pyspark.sql import functions as F

from siltstone.functions import references
from siltstone.operators import placement, registry, trace
from siltstone.operators.ranking import global_row_number


def test_sweep(spark):
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "digest string")
    assert {r.digest for r in registry.sweep(one("a", "b", "c", "d"), one("a", "b"), one("b", "c")).collect()} == {"d"}


def test_catalog_order(spark):
    names = "foo/a foo/b foo-bar/a bar/c bar/d bar/e foo/d/in foo-bar/b test".split()
    repos = spark.createDataFrame([(n,) for n in names], "repo string")
    got = [r.repo for r in registry.catalog_page(repos, "", 100).collect()]
    assert got == "bar/c bar/d bar/e foo/a foo/b foo/d/in foo-bar/a foo-bar/b test".split()
    assert [r.repo for r in registry.catalog_page(repos, "foo/b", 2).collect()] == ["foo/d/in", "foo-bar/a"]


@pytest.mark.parametrize(
    ("ref", "want"),
    [
        ("ubuntu", ("docker.io", "library/ubuntu", "latest", "")),
        ("foo/bar:v1", ("docker.io", "foo/bar", "v1", "")),
        ("localhost/x", ("localhost", "x", "latest", "")),
        ("reg.io:5000/a/b@sha256:00", ("reg.io:5000", "a/b", "", "sha256:00")),
    ],
)
def test_references(spark, ref, want):
    r = spark.range(1).select(*references.parse(F.lit(ref)).values()).first()
    assert tuple(r) == want


def test_short_codes_and_prefixes(spark):
    d = spark.createDataFrame([("1234",), ("1254",), ("ff00",)], "digest string")
    got = {r.digest: r.code for r in registry.short_codes(d, 1).collect()}
    assert got["1234"] == "123" and got["1254"] == "125" and got["ff00"][:2] == "ff"
    w = spark.createDataFrame([("12",), ("ff",), ("aa",)], "prefix string")
    got = {r.prefix: (r.matches, r.digest) for r in registry.prefix_lookup(d, w, 2).collect()}
    assert got == {"12": (2, None), "ff": (1, "ff00"), "aa": (0, None)}


def test_uploads_without_start_are_kept(spark):
    u = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2020-01-01'), (2, timestamp_ntz'2024-01-01'), (3, NULL) t(id, started_at)")
    assert [r.id for r in registry.purge(u, "2022-01-01").collect()] == [1]


def test_cap_passes_one_more(spark):
    r = spark.createDataFrame([(i, 7) for i in range(5)], "event_id long, written long")
    assert trace.cap_per_size(r, 2).count() == 3


def test_least_loaded(spark):
    f = spark.createDataFrame([(1, i, s) for i, s in enumerate([5, 4, 3, 3, 3])], "layer long, file long, size long")
    got = placement.least_loaded(f, ["a", "b"]).groupBy("server").agg(F.sum("size").alias("n")).collect()
    assert sorted(r.n for r in got) == [8, 10]


def test_ring_moves_few_keys(spark):
    keys = spark.range(500).select(F.col("id").cast("string").alias("key"))
    servers = lambda n: spark.range(n).select(F.concat(F.lit("s"), "id").alias("server"))
    a, b = (placement.ring_placement(keys, servers(n), 64) for n in (5, 6))
    moved = placement.moved_keys(a, b)
    assert 0 < moved.count() < 250 and {r.new for r in moved.collect()} == {"s5"}


def test_global_row_number(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = {r.k: r.rn for r in global_row_number(df, "k").collect()}
    assert got == {k: k + 1 for k in range(1000)}


def test_health(spark):
    rows = [(i, 1, f) for i, f in enumerate([True, True, False, True, True, True])]
    got = registry.health(spark.createDataFrame(rows, "event_id long, u long, failed boolean"), 3, "u").orderBy("event_id").collect()
    assert [r.unhealthy for r in got] == [False, False, False, False, False, True]
