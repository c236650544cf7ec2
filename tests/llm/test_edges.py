"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names for every operator."""

import hashlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import (
    byte_bpe, byte_cnn, decontaminate, katz, labelled, line_dedup, minhash, quality_rules, secret_ledger, shared, suffix_dedup, toxicity,
)

PATH = P.path("byte_bpe_50k.tiktoken")
LONG = "lorem ipsum dolor sit amet " * 60_000
ROWS = [
    (1, "a b c d e f g h i j k l m n o p q r s t u v w x y z the end of a line", 0.5), (2, None, None), (3, "", 1.0),
    (None, "some words here that are long enough to count as a line", 2.0), (4, " \t\n\r\x0b\f", 0.0), (5, LONG, 0.0),
    (6, "Élan ñandú 東京 🙂 \x00 \x1c ſecret\n\nx", 0.0), (7, "same text twice same text twice same", 0.0), (7, "same text twice same text twice same", 0.0),
]
#: Columns that operators use inside themselves, added to the tables under test.
CLASH = (
    "data fold t h g n id key label rep sig codes low size block p ids missing local ranked vocab tokens blob t1 line line_no first copies "
    "dropped kept_in head row lines text_hash n_shingles h1 h2 component_id kept slot least kind bi bj side held_out predicted n_tokens "
    "item_id similarity n_windows start_word spans n_assign toxic quality doc_id_ total _gone _gone_of a b x y node score a.b"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, extra double")
    return df.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def labels(spark):
    df = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(8)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    return df.select("*", F.lit("clash").alias("text"), F.lit("clash").alias("label"), F.lit("clash").alias("n"))


@pytest.fixture(scope="module")
def benchmark(spark):
    df = spark.createDataFrame([(1, "m n o p q r s t u v"), (2, None), (None, "x"), (3, ""), (4, "same")], "item_id long, text string")
    return df.select("*", F.lit("clash").alias("doc_id"), F.lit("clash").alias("n"))


def operators(docs, labels, benchmark):
    return {
        "op1": lambda d: quality_rules.quality_rules(d),
        "op3": lambda d: toxicity.toxicity(d, labels),
        "op4": lambda d: line_dedup.line_dedup(d),
        "op5": lambda d: katz.score(d),
        "op6": lambda d: suffix_dedup.remove_repeats(d),
        "op7": lambda d: byte_bpe.round_trip(d, PATH, P.PATTERN),
        "op8": lambda d: byte_cnn.quality(d, labels),
        "op9": lambda d: minhash.near_duplicates(d),
        "op10": lambda d: secret_ledger.secret_scan(d, shared.new_path(docs.sparkSession)),
        "op2": lambda d: decontaminate.leaks(d, benchmark),
    }


@pytest.mark.parametrize("name", ["op1", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_one_row_a_document_and_empty_tables(docs, labels, benchmark, name):
    op = operators(docs, labels, benchmark)[name]
    rows = op(docs).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((r[0] for r in ROWS), key=str)
    assert op(docs.limit(0)).collect() == []


def test_defined_results(docs, labels, benchmark):
    by = lambda df: {r.doc_id: r for r in df.collect()}
    q = by(quality_rules.quality_rules(docs))
    assert q[2].n_words == q[3].n_words == 0 and q[2].base_failed and not q[2].kept
    k = by(katz.score(docs))
    assert k[2].n_tokens == k[3].n_tokens == 1 and k[None].held_out is None
    s = by(suffix_dedup.remove_repeats(docs))
    assert s[2].kept_sha256 == hashlib.sha256(b"").hexdigest() and s[None].n_removed == 0
    n = by(minhash.near_duplicates(docs))
    assert n[2].component_id == 2 and n[2].n_shingles == 0 and n[None].component_id is None and n[None].kept
    b = by(byte_bpe.round_trip(docs, PATH, P.PATTERN))
    assert b[5].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest() and b[2].n_tokens == 0
    leaks = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert leaks == {(1, 1), (7, 4)}
    assert decontaminate.leaks(docs, benchmark.limit(0)).collect() == [] == decontaminate.leaks(docs.limit(0), benchmark).collect()
    assert secret_ledger.secret_scan(docs, shared.new_path(docs.sparkSession)).where("doc_id = 6").first().n_assign == 0


def test_stages_keep_columns_and_clean_rows(spark, docs, labels, benchmark, tmp_path):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        extra = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "extra")]
        assert out.select(*extra).distinct().count() == 1, name  # every other column is as it was
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert {r[0] for r in corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)).select("doc_id").collect()} == {2, 3, None, 4, 5, 6}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_sample_is_bounded_and_outside_the_held_out_fold(spark):
    import zlib

    d = spark.range(500).selectExpr("id AS doc_id", "concat('t', id) AS text")
    lab = spark.range(500).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    got = labelled.training_sample(d, lab, "toxic", 50)
    assert len(got) == 50 and all(zlib.crc32(t[1:]) % 5 for t, _ in got)


def test_sample_is_bounded_in_bytes_and_rows_of_one_id(spark):
    d = spark.range(400).selectExpr("id AS doc_id", "repeat('x', 100) AS text").union(spark.range(400).selectExpr("id", "repeat('y', 50)"))
    lab = spark.range(400).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    got = labelled.training_sample(d, lab, "toxic", 200, most_bytes=5_000)
    assert len(got) == 50 and {t for t, _ in got} == {b"x" * 100}
    assert labelled.training_sample(d, lab.limit(0), "toxic") == []


def test_without_labels_scores_are_constant(docs, labels):
    none = labels.limit(0)
    assert {round(r.score, 2) for r in toxicity.toxicity(docs, none).collect()} == {0.05} == {round(r.score, 2) for r in byte_cnn.quality(docs, none).collect()}


def test_near_dedup_stage_keeps_other_texts_of_an_id(spark):
    w, v = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    df = spark.createDataFrame([(1, w), (2, w), (2, v)], "doc_id long, text string")
    assert sorted(map(tuple, dict(corpus_pipeline.STAGES)["near_dedup"](spark, df, "").collect())) == [(1, w), (2, v)]
