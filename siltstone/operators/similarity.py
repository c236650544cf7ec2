"""Binary hashes, Hamming joins, nearest neighbours, super-features and distances."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import pairblocks

WORD = 32


def sign_words(embedding: Column, dims: int) -> list[Column]:
    """Sign bits (x >= 0) of a vector, packed low bit first into longs of 32 bits."""
    out = []
    for lo in range(0, dims, WORD):
        part = F.slice(embedding, lo + 1, WORD)
        bits = F.transform(part, lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        out.append(F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a + b))
    return out


def sign_hash(vectors: DataFrame, dims: int = 64) -> DataFrame:
    """vec_id, label and the words w0, w1, … of the sign hash."""
    words = sign_words(F.col("embedding"), dims)
    return vectors.select("vec_id", "label", *[w.alias(f"w{i}") for i, w in enumerate(words)])


def hamming(a: str, b: str, words: int = 2) -> Column:
    return sum((F.bit_count(F.col(f"{a}.w{i}").bitwiseXOR(F.col(f"{b}.w{i}"))) for i in range(words)), F.lit(0))


#: Rows of a side of one cell of the square of all pairs.
CELL = 4096


def _cells(rows: DataFrame) -> int:
    """Sides of the square so that a cell holds about CELL rows a side: tasks grow with the data, their size does not."""
    return max(4, -(-rows.count() // CELL))


def grid_pairs(hashes: DataFrame, cells: int | None = None) -> DataFrame:
    """Every pair a.vec_id < b.vec_id as an equi-join on the cells of a square.

    Rows go to one row and one column of the square, so each cell gets a
    bounded share of both sides and no task sees the whole of either.
    """
    cells = cells or _cells(hashes)
    part = F.pmod(F.xxhash64("vec_id"), F.lit(cells)).cast("int")
    a = hashes.withColumn("i", part).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).alias("a")
    b = hashes.withColumn("j", part).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).alias("b")
    same = (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    return a.join(b, same & (F.col("a.vec_id") < F.col("b.vec_id")))


def hamming_pairs(hashes: DataFrame, radius: int, cells: int | None = None) -> DataFrame:
    """Pairs within a wide radius (theta join)."""
    d = hamming("a", "b")
    return grid_pairs(hashes, cells).where(d <= radius).select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), d.alias("dist"))


def bands(radius: int, bits: int = 64) -> Column:
    """The radius + 1 bands of the words w0, w1, … as an array of (band, value): within the radius one is equal."""
    cuts = [round(i * bits / (radius + 1)) for i in range(radius + 2)]
    out = []
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        value = [F.call_function("shiftright", F.col(f"w{k // WORD}"), F.lit(k % WORD)).bitwiseAND(F.lit(1).cast("long")) for k in range(lo, hi)]
        packed = sum((F.shiftleft(v, j) for j, v in enumerate(value)), F.lit(0).cast("long"))
        out.append(F.struct(F.lit(i).alias("band"), packed.alias("value")))
    return F.array(*out)


def hamming_banded(hashes: DataFrame, radius: int, bits: int = 64) -> DataFrame:
    """Pairs within a narrow radius: of radius + 1 bands one must be equal, so bands are join keys."""
    rows = hashes.withColumn("k", F.explode(bands(radius, bits)))
    a, b = rows.alias("a"), rows.alias("b")
    d = hamming("a", "b")
    return (
        a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.vec_id") < F.col("b.vec_id")))
        .where(d <= radius).select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), d.alias("dist")).distinct()
    )


def nearest_earlier(hashes: DataFrame, k: int, radius: int, cells: int | None = None) -> DataFrame:
    """The ``k`` nearest earlier vectors within ``radius``, the newest first among ties."""
    pairs = hamming_pairs(hashes, radius, cells)
    w = Window.partitionBy("b").orderBy("dist", F.col("a").desc())
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        F.col("b").alias("vec_id"), F.col("a").alias("neighbour"), "dist", "rank"
    )


def running_best(candidates: DataFrame) -> DataFrame:
    """Least distance over the first 1, 2, … candidates of each vector."""
    w = Window.partitionBy("vec_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return candidates.select("vec_id", "rank", F.min("dist").over(w).alias("best"))


def depth_totals(candidates: DataFrame) -> DataFrame:
    """Sum of the best distance by depth."""
    return running_best(candidates).groupBy("rank").agg(F.count(F.lit(1)).alias("vectors"), F.sum("best").cast("long").alias("total"))


def query_distances(vectors: DataFrame, every: int = 20) -> DataFrame:
    """L1, L2, cosine and angle distances, and Jaccard of the sets of positive places, from the query vectors (ids
    divisible by ``every``) to all others."""
    return pairblocks.queries_against_all(vectors, pairblocks.all_distances, ["l1", "l2", "cosine", "angle", "jaccard"], every)


def _queries_against_all(rows: DataFrame, key: str, value: str, every: int) -> DataFrame:
    """q, x (its value), key, y: rows whose id is divisible by ``every`` against all others, in blocks."""
    q = rows.where(F.col(key) % every == 0).select(F.col(key).alias("q"), F.col(value).alias("x"))
    blocks = max(8, _cells(q))
    q = q.withColumn("blk", F.pmod(F.xxhash64("q"), F.lit(blocks)))
    v = rows.select(key, F.col(value).alias("y")).withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return q.join(v, "blk").where(F.col("q") != F.col(key)).drop("blk")


def normalised(vectors: DataFrame, every: int = 20) -> DataFrame:
    """Cosine and angle of vectors brought to length one beforehand, so a pair costs one product."""
    return pairblocks.queries_against_all(vectors, pairblocks.unit_distances, ["normalised_cosine", "normalised_angle"], every)


def sparse_jaccard(sets: DataFrame, every: int = 20) -> DataFrame:
    """Jaccard distance of sets (item_id, s), the queries against all others."""
    rows = _queries_against_all(sets.select("item_id", F.array_distinct("s").alias("s")), "item_id", "s", every)
    both = F.size(F.array_intersect("x", "y"))
    return rows.select("q", "item_id", F.round(1 - both / (F.size("x") + F.size("y") - both), 6).alias("distance"))


def best_by_delta(items: DataFrame) -> DataFrame:
    """item_id, reference, cost and own_cost: the earlier item of least coded size (ties: least id), if that beats coding alone.

    All pairs of distinct items are the operator; they are made in cells of bounded sides.
    """
    from siltstone.functions.chunkers import delta_size, self_size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cost = [delta_size(y.as_py(), x.as_py()) for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cost, pa.int64())], ["a", "b", "cost"])

    @F.arrow_udf("bigint")
    def alone(data: pa.Array) -> pa.Array:
        return pa.array([self_size(x.as_py()) for x in data], pa.int64())

    pairs = grid_pairs(items.withColumnRenamed("item_id", "vec_id")).select(
        F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), F.col("a.data").alias("x"), F.col("b.data").alias("y")
    )
    best = pairs.mapInArrow(run, "a long, b long, cost long").groupBy("b").agg(F.min(F.struct("cost", "a")).alias("m"))
    own = items.select(F.col("item_id"), alone("data").alias("own_cost"))
    got = own.join(best, own["item_id"] == best["b"], "left")
    return got.select(
        "item_id", F.when(F.col("m.cost") < F.col("own_cost"), F.col("m.a")).alias("reference"),
        F.least("own_cost", F.coalesce("m.cost", "own_cost")).alias("cost"), "own_cost",
    )


def medoids(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Member of each cluster with the least sum of distances to its others (ties: least id).

    ``members``: vec_id, cluster; ``pairs``: cluster, a, b, dist with a < b.
    """
    cost = pairs.select("cluster", F.col("a").alias("vec_id"), "dist").union(pairs.select("cluster", F.col("b").alias("vec_id"), "dist"))
    total = cost.groupBy("cluster", "vec_id").agg(F.sum("dist").alias("cost"))
    full = members.join(total, ["cluster", "vec_id"], "left").withColumn("cost", F.coalesce("cost", F.lit(0)).cast("long"))
    best = F.min(F.struct("cost", "vec_id"))
    return full.groupBy("cluster").agg(best.alias("m"), F.count(F.lit(1)).alias("members")).select(
        "cluster", "members", F.col("m.vec_id").alias("medoid"), F.col("m.cost").alias("cost")
    )


def ranked_queries(hashes: DataFrame, k: int, every: int = 20, cells: int | None = None) -> DataFrame:
    """The ``k`` nearest other vectors of each query (ids divisible by ``every``): q, rank, and whether labels agree."""
    cells = cells or _cells(hashes)
    q = hashes.where(F.col("vec_id") % every == 0)
    part = F.pmod(F.xxhash64("vec_id"), F.lit(cells)).cast("int")
    a = q.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).alias("a")
    b = hashes.withColumn("j", part).alias("b")
    pairs = a.join(b, (F.col("a.j") == F.col("b.j")) & (F.col("a.vec_id") != F.col("b.vec_id"))).select(
        F.col("a.vec_id").alias("q"), F.col("b.vec_id").alias("v"), hamming("a", "b").alias("dist"),
        (F.col("a.label") == F.col("b.label")).cast("int").alias("hit"),
    )
    w = Window.partitionBy("q").orderBy("dist", "v")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k_accuracy(ranked: DataFrame, *ks: int) -> DataFrame:
    """Share of queries with a neighbour of their class among the first k."""
    by_q = ranked.groupBy("q").agg(*[F.max(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"h{k}") for k in ks])
    return by_q.agg(*[F.round(F.avg(f"h{k}"), 6).alias(f"top{k}") for k in ks])


def mean_average_precision(ranked: DataFrame) -> DataFrame:
    """Mean over queries of the mean over hits of hits so far / rank; queries without a hit count 0."""
    w = Window.partitionBy("q").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    p = ranked.withColumn("p", F.when(F.col("hit") == 1, F.sum("hit").over(w) / F.col("rank")))
    return p.groupBy("q").agg(F.coalesce(F.avg("p"), F.lit(0.0)).alias("ap")).agg(F.round(F.avg("ap"), 6).alias("map"))


def hash_consistency(hashes: DataFrame, bits: int = 8) -> DataFrame:
    """For each class the greatest share of one hash prefix."""
    mask = (1 << bits) - 1
    n = hashes.groupBy("label", F.col("w0").bitwiseAND(F.lit(mask).cast("long")).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("label").agg(F.max("n").alias("most"), F.sum("n").alias("vectors"))


def superfeatures(docs: DataFrame, features: int = 12, groups: int = 3) -> DataFrame:
    """Super-features from word features: the least md5 under each salt, sorted in groups, one of each group hashed.

    Features are minima over distinct words instead of a rolling hash, which
    keeps the operator in SQL; see ``functions.chunkers`` for the rolling one.
    All of it is work on one row, so there is no exchange.
    """
    words = F.array_distinct(F.split("text", " "))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", words.alias("w"))
    salted = lambda i: F.array_min(F.transform("w", lambda x: F.md5(F.concat(F.lit(f"{i}:"), x))))
    f = rows.select("doc_id", *[salted(i).alias(f"f{i}") for i in range(features)])
    each = features // groups
    parts = [F.array_sort(F.array(*[F.col(f"f{g * each + i}") for i in range(each)])) for g in range(groups)]
    tops = [F.md5(F.concat_ws("|", *[p[i] for p in parts])) for i in range(each)]
    return f.select("doc_id", *[t.alias(f"sf{i}") for i, t in enumerate(tops)])


def newest_earlier(sf: DataFrame, *columns: str) -> DataFrame:
    """For each row the newest earlier row with the same super-feature: the first hit in the order of ``columns``."""
    found = [F.lag("doc_id").over(Window.partitionBy(c).orderBy("doc_id")) for c in columns]
    return sf.select("doc_id", F.coalesce(*found).alias("reference"))


def candidates(sf: DataFrame, *columns: str, most: int = 20) -> DataFrame:
    """Up to ``most`` distinct earlier rows that share a super-feature with a row, newest first.

    A hot super-feature is bounded before the union: of each one a row keeps
    its ``most`` predecessors, which a window collects as it slides.
    """
    listed = sf.select("doc_id", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).alias("v")) for i, c in enumerate(columns)])).alias("f"))
    w = Window.partitionBy("f").orderBy("doc_id").rowsBetween(-most, -1)
    near = listed.select("doc_id", F.collect_list("doc_id").over(w).alias("c")).select("doc_id", F.explode("c").alias("candidate"))
    top = near.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_set("candidate"), asc=False), 1, most).alias("c"))
    return top.select("doc_id", F.posexplode("c").alias("rank", "candidate")).select("doc_id", "candidate", (F.col("rank") + 1).alias("rank"))


class HashIndex:
    """An index of sign hashes as tables of bands: insert, remove, export, load and search within a radius."""

    def __init__(self, rows: DataFrame, radius: int):
        self.rows, self.radius = rows, radius

    @classmethod
    def create(cls, spark: SparkSession, radius: int) -> HashIndex:
        return cls(spark.createDataFrame([], "vec_id long, w0 long, w1 long, k struct<band:int,value:bigint>"), radius)

    @classmethod
    def load(cls, spark: SparkSession, path: str, radius: int) -> HashIndex:
        return cls(spark.read.parquet(path), radius)

    def insert(self, hashes: DataFrame) -> HashIndex:
        """Vectors under every band; ids that are there already stay as they are."""
        new = hashes.join(self.rows.select("vec_id").distinct(), "vec_id", "left_anti").select("vec_id", "w0", "w1", F.explode(bands(self.radius)).alias("k"))
        return HashIndex(self.rows.unionByName(new), self.radius)

    def remove(self, ids: DataFrame) -> HashIndex:
        return HashIndex(self.rows.join(ids.select("vec_id").distinct(), "vec_id", "left_anti"), self.radius)

    def export(self, path: str) -> None:
        self.rows.write.parquet(path)

    def search(self, queries: DataFrame) -> DataFrame:
        """All entries other than itself within the radius of each query: q, vec_id, dist."""
        a = queries.select("vec_id", "w0", "w1", F.explode(bands(self.radius)).alias("k")).alias("a")
        b = self.rows.alias("b")
        d = hamming("a", "b")
        near = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.vec_id") != F.col("b.vec_id"))).where(d <= self.radius)
        return near.select(F.col("a.vec_id").alias("q"), F.col("b.vec_id").alias("vec_id"), d.alias("dist")).distinct()


def two_tier(hashes: DataFrame, radius: int, buffer: int = 128) -> DataFrame:
    """The nearest earlier vector of each within ``radius``, over a buffer of the last ``buffer`` and an index of the rest.

    Rows have ordinals ``n``.  Both tiers are searched in full, as one: at a wide radius bands of a few bits would list
    more candidates than there are pairs.  Ties go to the newest.
    """
    near = pairblocks.nearest_before(hashes, "n", newest=True).where(F.col("dist") <= radius)
    tier = F.when(F.col("at") - F.col("neighbour_at") <= buffer, "buffer").otherwise("index").alias("tier")
    hit = near.select("vec_id", F.struct("dist", (-F.col("neighbour_at")).alias("m"), "neighbour", tier).alias("h"))
    return hit.groupBy("vec_id").agg(F.min("h").alias("h")).select("vec_id", "h.neighbour", "h.dist", "h.tier")
