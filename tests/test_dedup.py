from pyspark.sql import functions as F

from siltstone.operators import dedup


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_chunks_of_empty_and_null(spark):
    d = docs(spark, [(1, "", "en", "a"), (2, None, "en", "a"), (3, "x" * 1025, "en", "a")])
    got = [(r.doc_id, r.ordinal, r.size) for r in dedup.document_chunks(d).orderBy("ordinal").collect()]
    assert got == [(3, 0, 512), (3, 1, 512), (3, 2, 1)]


def test_padding_makes_the_tail_full(spark):
    d = docs(spark, [(1, "ab", "en", "a")])
    import hashlib

    r = dedup.padded_chunks(d).first()
    assert r.hash == hashlib.sha256(b"ab" + bytes(510)).hexdigest() and r.size == 2


def test_restore_keeps_order_and_repeats(spark):
    a, b, c = "a" * 512, "b" * 512, "c" * 512
    d = docs(spark, [(1, a + b + a, "en", "s"), (2, b + c + b, "en", "s"), (3, a + a + "é", "en", "s")])
    got = {r.doc_id: r.restored_sha256 for r in dedup.restore(d).collect()}
    want = {r.doc_id: r.h for r in d.select("doc_id", F.sha2("text", 256).alias("h")).collect()}
    assert got == want


def test_keys_do_not_share_copies(spark):
    d = docs(spark, [(1, "x" * 100, "en", "a"), (2, "x" * 100, "fr", "a"), (3, "x" * 100, "en", "b")])
    c = dedup.document_chunks(d)
    assert dedup.keyed_ratio(c, "lang").first().reduced_bytes == 100
    assert dedup.keyed_ratio(c).first().reduced_bytes == 200
    got = {r.scheme: r.reduced_bytes for r in dedup.keying_comparison(c, {"one": (), "lang": ("lang",)}).collect()}
    assert got == {"one": 200, "lang": 100}


def test_index_split(spark):
    d = docs(spark, [(1, "x", "en", "a"), (2, "y", "en", "a"), (3, "x", "en", "a"), (4, "y", "en", "a")])
    c = dedup.document_chunks(d)
    index = c.where("doc_id = 1")
    assert {r.doc_id for r in dedup.index_hits(c, index).collect()} == {1, 3}
    assert [r.doc_id for r in dedup.index_misses(c, index).collect()] == [2]
