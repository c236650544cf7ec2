"""MinHash near-duplicates by a multi-index Hamming join of signatures.

A document's set of word shingles gives a signature of SYMBOLS b-bit minima.
Signatures that differ in at most RADIUS symbols are all found: RADIUS errors
over CHUNKS chunks leave some chunk with at most ERRORS = RADIUS // CHUNKS = 1
of them (pigeonhole), so each chunk is indexed once for every symbol it may
have wrong, with that symbol left out.  At a similarity of 0.8 a symbol
differs with probability 0.2, and more than RADIUS of 64 do so about once in
10**5 pairs; links are confirmed on the full sets.

Equal sets are one representative with a number of its own, so rows that share
an id but not their text are apart.  In each bucket of the index every member
is first compared with the bucket's leader only, the member that shares most
buckets with others; that is linear however large the bucket is.  A bucket
whose members are then still in different components is compared further: the
members of its largest component meet the others, in blocks, and the others meet
each other; so n members with s strays cost n * s comparisons and about
n + s * n / BLOCK rows.  Each pair is taken under its first common key only;
pairs within RADIUS whose sketches allow the similarity are confirmed.  No link
between different components is lost.

Edge cases: null, empty and wordless texts have an empty set, link with
nothing and are kept; with fewer words than a shingle the whole sequence is
one shingle; a null id links with nothing, has a null component_id and is
kept; repeated rows share a component, and so do equal sets; rows with one id
and different texts are judged one by one, each with the component of its own
text; ties for a leader go to the least number; very long texts are coded in
pieces; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import shared
from siltstone.llm.arrowrows import with_bytes
from siltstone.llm.textcodes import U64, mix, shingles, word_codes

SYMBOLS, BITS = 64, 16
CHUNKS, ERRORS = 14, 1
RADIUS = CHUNKS * (ERRORS + 1) - 1
#: Members of a bucket in one block of comparisons.
BLOCK = 1024
#: Codes in the sketch that decides which pairs are worth confirming.
SKETCH = 256
#: Rows of one call of the comparison, and pairs whose sketches are compared at a time.
PART, AT_A_TIME = 4096, 2048

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_ADD = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.int64).astype(U64)
_CUTS = np.linspace(0, SYMBOLS, CHUNKS + 1).round().astype(int)


def shingle_set(data: bytes, k: int) -> np.ndarray:
    """Sorted distinct shingle codes."""
    return np.unique(shingles(word_codes(data), k))


def signature(codes: np.ndarray) -> np.ndarray:
    """The low BITS of scrambled minima under SYMBOLS affine permutations."""
    least = np.full(SYMBOLS, np.iinfo(U64).max, U64)
    for at in range(0, len(codes), 2048):
        part = codes[at : at + 2048, None] * _MULTIPLY + _ADD
        np.minimum(least, part.min(axis=0), out=least)
    return mix(least).astype(np.uint16)


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature its keys: one for each chunk and symbol left out."""
    s = signatures.astype(U64)
    keys = []
    for c in range(CHUNKS):
        lo, hi = _CUTS[c], _CUTS[c + 1]
        for gone in range(lo, hi):
            acc = np.full(len(s), U64(gone + 1), U64)
            for j in range(lo, hi):
                if j != gone:
                    acc = mix(acc * U64(0x9E3779B97F4A7C15) + s[:, j] + U64(1))
            keys.append(acc)
    return np.stack(keys, axis=1)


def sign(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, a hash of the text (which tells rows of one id apart), size and 128-bit identity of the set, and the
    signature (empty for an empty set)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2, sig = [], [], [], []
            for x in b.column(1):
                codes = shingle_set(x.as_py(), k)
                one, two = set_identity(codes)
                n.append(len(codes)), h1.append(one), h2.append(two)
                sig.append(signature(codes).tobytes() if len(codes) else b"")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), *(pa.array(v, pa.int64()) for v in (n, h1, h2)), pa.array(sig, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "h1", "h2", "sig"],
            )

    rows = with_bytes(docs).withColumn("text_hash", F.xxhash64("data"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, sig binary")


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            part = b.slice(at, 2048)
            sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), SYMBOLS)
            slots = np.tile(np.arange(SYMBOLS, dtype=np.int8), len(sigs))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket_keys(sigs).ravel().view(np.int64)), pa.array(ids), pa.array(slots)], ["key", "rep", "slot"]
            )


def _confirm(similarity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * both >= similarity * (len(x) + len(y) - both))
            b = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"])

    return run


def set_identity(codes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    return int(mix(codes).sum(dtype=U64).astype(np.int64)), int(mix(codes * U64(3) + U64(len(codes))).sum(dtype=U64).astype(np.int64))


def sets_of(reps: DataFrame, docs: DataFrame, k: int) -> tuple[DataFrame, str]:
    """rep, codes (the full set) and low (a sketch: the top halves of its least codes), once for each of ``reps``
    (rep, least, h1, h2), from a text of the document ``least``."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, full, low = [], [], []
            for r, h1, h2, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                codes = shingle_set(x.as_py(), k)
                if set_identity(codes) == (h1, h2):
                    rep.append(r)
                    full.append(codes.tobytes())
                    low.append((codes[:SKETCH] >> U64(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep, pa.int64()), pa.array(full, pa.binary()), pa.array(low, pa.binary())], ["rep", "codes", "low"]
            )

    texts = with_bytes(docs).join(reps.select("rep", "h1", "h2", F.col("least").alias("doc_id")), "doc_id").select("rep", "h1", "h2", "data")
    return shared.table(texts.mapInArrow(sets, "rep long, codes binary, low binary").dropDuplicates(["rep"]))


def confirm(pairs: DataFrame, made: DataFrame, similarity: int) -> tuple[DataFrame, str]:
    """The pairs (a, b) of representatives whose full sets are similar enough.

    ``made`` has a row a representative, so a hub's pairs are plain join rows that may be split over tasks.
    """
    a = made.select(F.col("rep").alias("a"), F.col("codes").alias("x"))
    b = made.select(F.col("rep").alias("b"), F.col("codes").alias("y"))
    rows = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y")
    return shared.table(rows.mapInArrow(_confirm(similarity), "a long, b long"))


def first_slots(wrong: np.ndarray) -> np.ndarray:
    """The first key that two signatures share, from where they differ (a row each); SYMBOLS if none."""
    out = np.full(len(wrong), SYMBOLS)
    for c in range(CHUNKS - 1, -1, -1):
        lo, hi = _CUTS[c], _CUTS[c + 1]
        part = wrong[:, lo:hi]
        n = part.sum(axis=1)
        out = np.where(n == 0, lo, np.where(n == 1, lo + part.argmax(axis=1), out))
    return out


def _may_link(i: np.ndarray, j: np.ndarray, low: np.ndarray, size: np.ndarray, similarity: int) -> np.ndarray:
    """Which pairs of rows may reach the similarity, by their sketches.

    Sketches that hold whole sets decide exactly (halved codes can only add to
    the intersection); cut ones pass what lies within 4.5 standard deviations.
    """
    out = np.zeros(len(i), bool)
    none = np.uint64(1) << np.uint64(32)  # above every halved code
    for at in range(0, len(i), AT_A_TIME):
        x, y = i[at : at + AT_A_TIME], j[at : at + AT_A_TIME]
        cut = np.minimum(*(np.where(size[r] > SKETCH, low[r, -1], none) for r in (x, y)))[:, None]
        both = np.sort(np.concatenate([low[x], low[y]], axis=1), axis=1)
        real = (both < none) & (both <= cut)
        equal = ((both[:, 1:] == both[:, :-1]) & real[:, 1:]).sum(axis=1) + 1
        union = real.sum(axis=1) - equal + 1
        least = similarity / 100
        slack = 4.5 * np.sqrt(least * (1 - least) / np.maximum(union, 1))
        partly = (size[x] > SKETCH) | (size[y] > SKETCH)
        out[at : at + AT_A_TIME] = equal >= (least - np.where(partly, slack, 0.0)) * union
    return out


def _compare(similarity: int):
    """Pairs within the blocks of a part of the buckets that have a row of side 0: different labels, sizes that allow
    a link, signatures within RADIUS whose first common key is this bucket's, and sketches that allow a link.

    Rows are sorted by block, side 0 first; each step takes all pairs at one
    distance in that order, so many small buckets cost no more than a few large ones.
    """

    def run(t: pa.Table) -> pa.Table:
        cols = {c: t[c].to_numpy() for c in ("key", "kind", "bi", "bj", "side", "size", "rep", "label", "slot")}
        order = np.lexsort((cols["rep"], cols["side"], cols["bj"], cols["bi"], cols["kind"], cols["key"]))
        key, kind, bi, bj, side, size, rep, label, slot = (cols[c][order] for c in cols)
        n = len(order)
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)[order]
        low = np.full((n, SKETCH), 1 << 32, U64)
        for k, x in enumerate(t["low"].to_pylist()):
            low[k, : len(x) // 4] = np.frombuffer(x, np.uint32)
        low = low[order]
        differ = (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
        block = np.cumsum(np.append(True, differ))
        inner = (kind == 1) & (bi == bj)  # a block of strays by itself
        out, i, far = [np.empty((0, 2), np.int64)], np.flatnonzero(side == 0), 1
        while len(i := i[i + far < n]) and len(i := i[block[i + far] == block[i]]):
            j = i + far
            small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            ok = (label[i] != label[j]) & (small * 100 >= similarity * large) & (inner[i] | (side[j] == 1))
            x, y = i[ok], j[ok]
            if len(x):
                wrong = sig[x] != sig[y]
                ok = (wrong.sum(axis=1) <= RADIUS) & (first_slots(wrong) == slot[x])
                x, y = x[ok], y[ok]
            if len(x):
                ok = _may_link(x, y, low, size, similarity)
                out.append(np.sort(np.stack([rep[x[ok]], rep[y[ok]]], axis=1), axis=1))
            far += 1
        pairs = np.concatenate(out)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def block_rows(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """Which blocks each member of a bucket with several components goes to: key, slot, rep, label, kind, bi, bj, side.

    The largest component of a bucket (ties: the least label) has m members,
    the s others are strays.  Kind 0 blocks pair a block of strays (side 0)
    with a block of the largest component (side 1), kind 1 blocks two blocks of strays.
    """
    held = keys.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn(
        "label", F.coalesce("label", "rep")
    )
    parts = held.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    top = F.max(F.struct("m", (-F.col("label")).alias("less")))
    mixed = parts.groupBy("key").agg(top.alias("top"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    mixed = mixed.select(
        "key", (-F.col("top.less")).alias("main"), F.ceil((F.col("n") - F.col("top.m")) / BLOCK).cast("int").alias("s"),
        F.ceil(F.col("top.m") / BLOCK).cast("int").alias("b"),
    )
    rows = held.join(mixed, "key")
    stray = F.col("label") != F.col("main")
    own = F.pmod(F.xxhash64("rep", F.lit(1)), F.when(stray, F.col("s")).otherwise(F.col("b"))).cast("int")
    rows = rows.withColumn("stray", stray).withColumn("own", own)
    entry = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("bi"), j.cast("int").alias("bj"), side.cast("int").alias("side"))
    me, zero, one = F.col("own"), F.lit(0), F.lit(1)
    meets_main = F.transform(F.sequence(zero, F.col("b") - 1), lambda j: entry(0, me, j, zero))
    meets_strays = F.transform(F.sequence(zero, F.col("s") - 1), lambda j: entry(1, F.least(me, j), F.greatest(me, j), F.when(me <= j, zero).otherwise(one)))
    main = F.transform(F.sequence(zero, F.col("s") - 1), lambda i: entry(0, i, me, one))
    goes = F.when(F.col("stray"), F.concat(meets_main, meets_strays)).otherwise(main)
    return rows.select("key", "slot", "rep", "label", F.explode(goes).alias("to")).select("key", "slot", "rep", "label", "to.*")


def rest_pairs(keys: DataFrame, reps: DataFrame, made: DataFrame, labels: DataFrame, similarity: int) -> DataFrame:
    """Pairs within RADIUS that share a bucket but not a component, and may link by their sketches."""
    spark = keys.sparkSession
    blocks, path = shared.table(block_rows(keys, labels))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks.count() // PART))
    rows = blocks.join(reps.select("rep", "sig", "size").join(made.select("rep", "low"), "rep"), "rep")
    part = F.pmod(F.xxhash64("key", "kind", "bi", "bj"), F.lit(parts))
    pairs, _ = shared.table(rows.groupBy(part.alias("part")).applyInArrow(_compare(similarity), "a long, b long").distinct())
    shared.drop(spark, path)
    return pairs


def near_duplicates(docs: DataFrame, k: int = 5, similarity: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    ``k`` is the number of words in a shingle; ``similarity`` the least Jaccard
    similarity of linked sets in hundredths.  Components do not depend on the
    order of the rows.
    """
    return components_of(docs, k, similarity).select("doc_id", "n_shingles", "component_id", "kept")


def without_duplicates(docs: DataFrame, k: int = 5, similarity: int = 80) -> DataFrame:
    """The rows that are kept, with all columns; rows of one id are judged by their texts."""
    gone = components_of(docs, k, similarity).where("NOT kept").select("doc_id", "text_hash").distinct()
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(data).alias("text_hash"))
    return rows.join(gone, ["doc_id", "text_hash"], "left_anti").select("row.*")


def components_of(docs: DataFrame, k: int, similarity: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept of every row."""
    spark = docs.sparkSession
    place = shared.mark()
    signed, signed_path = shared.table(sign(docs, k))
    reps, _ = shared.table(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.min("n_shingles").alias("size"))
        .withColumn("rep", F.monotonically_increasing_id())
    )
    index = reps.select("rep", "sig").mapInArrow(_keys, "key long, rep long, slot byte")
    shares = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keys, _ = shared.table(index.join(shares, "key"))
    degree = keys.groupBy("rep").agg(F.sum("n").alias("degree"))
    best = F.max(F.struct("degree", (-F.col("rep")).alias("less")))
    leaders = keys.join(degree, "rep").groupBy("key").agg((-best["less"]).alias("leader"))
    stars, _ = shared.table(
        keys.join(leaders, "key")
        .where("rep <> leader")
        .select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b"))
        .distinct()
    )
    wanted = reps.join(keys.select("rep").distinct(), "rep", "left_semi").select("rep", "least", "h1", "h2")
    made, _ = sets_of(wanted, docs, k)
    links, _ = confirm(stars, made, similarity)
    labels = shared.components(links)
    more = rest_pairs(keys.select("key", "slot", "rep"), reps, made, labels, similarity)
    if more.limit(1).count():
        rest, _ = confirm(more.join(stars, ["a", "b"], "left_anti"), made, similarity)
        if rest.limit(1).count():
            labels = shared.components(links.unionByName(rest))
    numbered = reps.select("h1", "h2", "rep", "least").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    numbered = numbered.withColumn("label", F.coalesce("label", "rep"))
    least = numbered.groupBy("label").agg(F.min("least").alias("component"))
    of_set, of_set_path = shared.table(numbered.join(least, "label").select("h1", "h2", "component"))
    shared.drop_since(spark, place, signed_path, of_set_path)
    mine = signed.drop("sig").join(of_set, ["h1", "h2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == own, F.lit(True))
    return mine.select("doc_id", "text_hash", "n_shingles", own.alias("component_id"), kept.alias("kept"))
