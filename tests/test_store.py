"""Records, uploads, settings, manifests and plugins on small cases."""

import hashlib
import json

from pyspark.sql import functions as F

from siltstone import settings
from siltstone.functions import references
from siltstone.operators import manifests, placement, plugins, store
from siltstone.sources import checkpoints, tables


def test_settings():
    text = "a:\n  b: 1\n  c:\n    d: 'x y'\n# note\ne: 2\n"
    assert settings.parse(text) == {"a.b": "1", "a.c.d": "x y", "e": "2"}
    assert settings.load(text, {"REGISTRY_A_B": "5", "REGISTRY_NEW": "z", "OTHER": "q"}) == {"a.b": "5", "a.c.d": "x y", "e": "2", "new": "z"}
    assert settings.Engine.of({"dedup.warmup": "7", "dedup.factor": "1.5"}) == settings.Engine(dedup_warmup=7, dedup_factor=1.5)


def test_uploads(spark):
    rows = [
        (1, "create", 0, 0), (1, "patch", 1, 5), (1, "patch", 2, 6), (1, "commit", 0, 0), (2, "create", 0, 0), (2, "patch", 2, 5), (2, "commit", 0, 0),
        (3, "create", 0, 0), (3, "cancel", 0, 0), (4, "create", 0, 0), (5, "patch", 1, 1),
    ]
    got = {r.upload: (r.size, r.patches, r.state) for r in store.uploads(spark.createDataFrame(rows, "upload long, op string, n int, size long")).collect()}
    assert got == {1: (11, 2, "committed"), 2: (5, 1, "invalid"), 3: (0, 0, "cancelled"), 4: (0, 0, "open")}


def test_least_loaded_on_two_servers(spark):
    files = spark.createDataFrame([(1, i, n) for i, n in enumerate((5, 4, 3, 3, 3))], "layer long, file long, size long")
    load = lambda df: {r.server: r["sum(size)"] for r in df.groupBy("server").sum("size").collect()}
    assert sorted(load(placement.least_loaded(files, ["a", "b"])).values()) == [8, 10]
    seeds = spark.createDataFrame([(1, "a", 100)], "layer long, server string, load long")
    assert load(placement.least_loaded(files, ["a", "b"], seeds=seeds)) == {"b": 18}
    assert load(placement.least_loaded(files, ["a", "b"], local="home", least_files=5)) == {"home": 18}


def test_schema1(spark):
    empty = manifests.EMPTY_LAYER
    rows = [(1, ["sha256:aa", "sha256:bb"], [False, True, False]), (2, ["sha256:aa"], [False, False]), (3, [], [])]
    got = sorted(map(tuple, manifests.to_schema1(spark.createDataFrame(rows, "image long, layers array<string>, history array<boolean>")).collect()))
    ids, parent = [], ""
    for s in ("sha256:aa", empty, "sha256:bb"):
        parent = hashlib.sha256(f"{s[7:]} {parent}".encode()).hexdigest()
        ids.append(parent)
    assert got == [(1, 0, "sha256:bb", ids[2]), (1, 1, empty, ids[1]), (1, 2, "sha256:aa", ids[0])]


def test_manifests_are_marked_through_lists(spark):
    d = lambda x: {"mediaType": "m", "size": 1, "digest": x}
    rows = [
        ("l1", manifests.LIST, json.dumps({"schemaVersion": 2, "manifests": [d("l2"), d("i1")]})), ("l2", manifests.LIST, json.dumps({"schemaVersion": 2, "manifests": [d("i2")]})),
        ("i1", manifests.SCHEMA2 + "; charset=utf-8", json.dumps({"schemaVersion": 2, "config": d("c1"), "layers": [d("x"), d("y")]})),
        ("i2", manifests.SCHEMA1, json.dumps({"schemaVersion": 1, "fsLayers": [{"blobSum": "z"}]})), ("i3", manifests.SCHEMA2, json.dumps({"config": d("c3"), "layers": [d("w")]})),
        ("bad", manifests.SCHEMA2, "{"), ("other", "text/plain", "{}"),
    ]
    refs = manifests.references(spark.createDataFrame(rows, "digest string, content_type string, body string"))
    live = manifests.reachable(spark.createDataFrame([("l1",)], "digest string"), refs.select("digest", "target"))
    assert {r.digest for r in live.collect()} == {"l1", "l2", "i1", "i2", "c1", "x", "y", "z"}


def test_reference_errors(spark):
    good = ["a", "a/b", "example.org:5000/a/b:v1", "a@sha256:" + "0" * 64, "a__b/c-d", "localhost/a"]
    bad = {"": "empty", "a//b": "format", "-a": "format", "Abc/Def": "uppercase", "a" * 300: "too long", "a:": "format", "a@sha256:12": "format"}
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "r string")
    assert {r.r: r.e for r in df.select("r", references.reference_error(F.col("r")).alias("e")).collect()} == {**dict.fromkeys(good), **bad}


def test_walk_skips_below(spark):
    paths = spark.createDataFrame([("a/b/c",), ("a/_x/y",), ("d",)], "path string")
    assert {tuple(r) for r in tables.walk(paths, "^_").collect()} == {("a", "dir"), ("a/b", "dir"), ("a/b/c", "file"), ("d", "file")}


def test_plugins(spark):
    assert plugins.each_partition(spark.range(10), lambda rows: list(rows), ["id"]) == 10


def test_tables_are_dropped(spark):
    place = checkpoints.mark()
    _, one = checkpoints.table(spark.range(3))
    _, two = checkpoints.table(spark.range(3))
    checkpoints.drop_since(spark, place, two)
    assert not checkpoints.exists(spark, one) and checkpoints.exists(spark, two)
    checkpoints.drop(spark, two)


def test_trace_files(spark, tmp_path):
    rows = [(f"2024-01-01T00:00:{i:02d}", "GET", f"u{i}", 0.5, "x", i) for i in range(30)]
    names = ["timestamp", "http.request.method", "http.request.uri", "http.request.duration", "http.request.remoteaddr", "http.response.written"]
    df = spark.createDataFrame(rows, tables.TRACE)
    tables.write_trace(df, str(tmp_path / "t"), per_line=4)
    assert sorted(map(tuple, tables.read_trace(spark, str(tmp_path / "t")).collect())) == rows
    (tmp_path / "whole.json").write_text(json.dumps([dict(zip(names, r)) for r in rows], indent=1))
    assert sorted(map(tuple, tables.read_trace_files(spark, str(tmp_path / "whole.json")).collect())) == rows
