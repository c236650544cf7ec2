"""Queries over features, candidates, references, batched inference and tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import chunkers
from siltstone.operators import cachesim, cluster, dedup, inference, plugins, similarity
from siltstone.plans.catalogue import HASHES, HOST, PIECE, REQS, SF, _accesses, _chunks, _docs, _hashes
from siltstone.plans.register import T, query

LISTED = SF + """, l AS (SELECT doc_id, 0 AS k, sf0 AS v FROM s UNION ALL SELECT doc_id, 1, sf1 FROM s UNION ALL SELECT doc_id, 2, sf2 FROM s UNION ALL SELECT doc_id, 3, sf3 FROM s),
c AS (SELECT DISTINCT a.doc_id, b.doc_id AS candidate FROM l a JOIN l b ON a.k = b.k AND a.v = b.v AND b.doc_id < a.doc_id),
r AS (SELECT doc_id, candidate, row_number() OVER (PARTITION BY doc_id ORDER BY candidate DESC)::INT AS rank FROM c)
"""


@query(LISTED + "SELECT * FROM r WHERE rank <= 20")
def superfeature_candidates(spark, d):
    return similarity.candidates(similarity.superfeatures(_docs(spark, d)), "sf0", "sf1", "sf2", "sf3")


@query(SF + "SELECT sum(n - 1)::BIGINT AS repeats, sum(b - m)::BIGINT AS bytes FROM (SELECT sf2, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS b, min(octet_length(encode(text))) AS m FROM s JOIN documents USING (doc_id) GROUP BY sf2)")
def superfeature_duplicates(spark, d):
    """Files that share a super-feature with an earlier one, and their bytes."""
    docs = _docs(spark, d)
    sf = similarity.superfeatures(docs).select("doc_id", "sf2").join(docs.select("doc_id", F.octet_length("text").alias("b")), "doc_id")
    got = sf.groupBy("sf2").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"), F.min("b").alias("m"))
    return got.agg(F.sum(F.col("n") - 1).alias("repeats"), F.sum(F.col("b") - F.col("m")).cast("long").alias("bytes"))


@query(SF + "SELECT sf2, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS files FROM s GROUP BY sf2 HAVING count(*) > 1")
def superfeature_files(spark, d):
    got = similarity.superfeatures(_docs(spark, d)).groupBy("sf2").agg(F.sort_array(F.collect_list("doc_id")).alias("f")).where(F.size("f") > 1)
    return got.select("sf2", F.array_join(F.transform("f", lambda x: x.cast("string")), ",").alias("files"))


@query()
def rolling_superfeatures(spark, d):
    """Super-features of the rolling hash over the bytes themselves."""
    return chunkers.feature_table(_docs(spark, d)).select("doc_id", *[F.col("sf")[i].alias(f"sf{i}") for i in range(4)])


@query("SELECT count(*) AS docs, 0::BIGINT AS apart FROM documents WHERE text <> ''")
def rolling_superfeatures_agree(spark, d):
    """Equal payloads have equal super-features."""
    docs = _docs(spark, d)
    got = chunkers.feature_table(docs).join(docs.select("doc_id", F.sha2("text", 256).alias("h")), "doc_id")
    kinds = got.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("sf").alias("lo"), F.max("sf").alias("hi"))
    return kinds.agg(F.sum("n").alias("docs"), F.sum((F.col("lo") != F.col("hi")).cast("long")).alias("apart"))


@query(PIECE + HOST + """, s AS (SELECT doc_id, host, sum(size)::BIGINT AS z FROM hc GROUP BY doc_id, host)
SELECT doc_id, string_agg(host || '=' || z, ',' ORDER BY host) AS slice_sizes, (sum(z)::BIGINT * 1000000 // any_value(n_chars))::BIGINT AS compress_ppm FROM s JOIN documents USING (doc_id) GROUP BY doc_id""")
def layer_size_map(spark, d):
    """Bytes of each layer by host, and its size against the stored one."""
    docs = _docs(spark, d).select("doc_id", F.col("n_chars").alias("stored"))
    return dedup.size_map(_chunks(spark, d), docs)


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS n, round(list_sum([(('0x' || substr(h, 2 * i + 1, 2))::INT - 128) / 128.0::DOUBLE FOR i IN range(0, octet_length(encode(text)))]) / octet_length(encode(text)), 6) AS mean FROM (SELECT *, hex(encode(text)) AS h FROM documents WHERE text <> '')")
def byte_normalise(spark, d):
    return inference.normalised_means(_docs(spark, d))


@query(HASHES + "SELECT vec_id, w0, w1, ((row_number() OVER (ORDER BY vec_id) - 1) // 256)::BIGINT AS batch FROM h")
def batched_inference(spark, d):
    """Hashes made in batches of 256 in the order of ids, with the order restored."""
    return inference.in_batches(T(spark, d, "embeddings"), 256)


@query(HASHES + """, o AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS n FROM h), z AS (SELECT a.vec_id, b.vec_id AS neighbour, b.n, (bit_count(xor(a.w0, b.w0)) + bit_count(xor(a.w1, b.w1)))::INT AS dist, CASE WHEN a.n - b.n <= 128 THEN 'buffer' ELSE 'index' END AS tier FROM o a JOIN o b ON b.n < a.n)
SELECT vec_id, neighbour, dist, tier FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, n DESC) AS k FROM z WHERE dist <= 15) WHERE k = 1""")
def two_tier_search(spark, d):
    from siltstone.operators.ranking import global_row_number

    return similarity.two_tier(global_row_number(_hashes(spark, d), "vec_id", name="n"), 15)


@query("""WITH e AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings), n AS (SELECT vec_id, [x / sqrt(list_sum([y * y FOR y IN v])) FOR x IN v] AS u FROM e)
SELECT a.vec_id AS q, b.vec_id AS vec_id, round(1 - list_sum([a.u[i] * b.u[i] FOR i IN range(1, 65)]), 4) AS normalised_cosine, round(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, list_sum([a.u[i] * b.u[i] FOR i IN range(1, 65)])))), 4) AS normalised_angle FROM n a JOIN n b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id""")
def normalised_distances(spark, d):
    return similarity.normalised(T(spark, d, "embeddings"))


@query("""WITH w AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS s FROM benchmark)
SELECT a.item_id AS q, b.item_id AS item_id, round(1 - len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS distance FROM w a JOIN w b ON a.item_id % 20 = 0 AND a.item_id <> b.item_id""")
def sparse_jaccard(spark, d):
    rows = T(spark, d, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("s"))
    return similarity.sparse_jaccard(rows)


@query()
def best_delta_reference(spark, d):
    """For each benchmark text the earlier one that it codes smallest against, unless it codes as small by itself."""
    return similarity.best_by_delta(T(spark, d, "benchmark").select("item_id", F.col("text").cast("binary").alias("data")))


@query("SELECT count(*) AS items, 0::BIGINT AS later, 0::BIGINT AS dearer FROM benchmark")
def best_delta_reference_bounds(spark, d):
    """Every item is there once, no reference is later than its item, and none costs more than coding alone."""
    got = best_delta_reference(spark, d)
    return got.agg(
        F.count(F.lit(1)).alias("items"), F.sum(F.coalesce((F.col("reference") >= F.col("item_id")).cast("long"), F.lit(0))).alias("later"),
        F.sum((F.col("cost") > F.col("own_cost")).cast("long")).alias("dearer"),
    )


@query(HASHES + "SELECT count(*) AS vectors, true AS within, true AS leaders FROM h")
def leader_clusters_hold(spark, d):
    """Each member is within the radius of its leader, and leaders lead themselves."""
    h = _hashes(spark, d)
    got = cluster.leader_clusters(h, 20)
    rows = got.join(h, "vec_id").alias("a").join(h.alias("b"), F.col("cluster") == F.col("b.vec_id"))
    leads = got.where("vec_id = cluster").select(F.col("vec_id").alias("lead"))
    rows = rows.join(leads, F.col("cluster") == F.col("lead"), "left")
    return rows.agg(
        F.count(F.lit(1)).alias("vectors"), F.min((similarity.hamming("a", "b") <= 20).cast("int")).cast("boolean").alias("within"),
        F.min(F.col("lead").isNotNull().cast("int")).cast("boolean").alias("leaders"),
    )


@query("SELECT count(*) AS vectors, 10::BIGINT AS clusters, 0::BIGINT AS misplaced FROM embeddings")
def kmeans_holds(spark, d):
    """No vector lies clearly nearer to the mean of another cluster than to that of its own."""
    return cluster.kmeans_report(T(spark, d, "embeddings"), 10)


@query("SELECT 'k-means||' AS init, count(*) AS vectors FROM embeddings UNION ALL SELECT 'random', count(*) FROM embeddings")
def kmeans_initialisations(spark, d):
    v = T(spark, d, "embeddings")
    parts = [cluster.kmeans(v, 10, init=i).select(F.lit(i).alias("init")) for i in ("k-means||", "random")]
    return parts[0].unionByName(parts[1]).groupBy("init").agg(F.count(F.lit(1)).alias("vectors"))


# Caches by weight, with expiry and in tiers ----------------------------------------------------


def _weighted(spark, d):
    r = T(spark, d, "events")
    return _accesses(spark, d).join(r.select(F.col("event_id").alias("seq"), F.round(F.abs("value") * 100).cast("long").alias("size"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("now")), "seq")


CACHES = REQS + "SELECT (user_id % 10)::VARCHAR AS cache, count(*) AS accesses, true AS bounded FROM r GROUP BY 1"


def _report(spark, d, policy: str, capacity: int, **options):
    """Accesses of each cache, and whether its hits lie between none and all repeats."""
    a = _weighted(spark, d)
    got = cachesim.simulate(a, policy, capacity, **options)
    most = a.groupBy("cache").agg((F.count(F.lit(1)) - F.count_distinct("key")).alias("most"))
    return got.join(most, "cache").select("cache", "accesses", ((F.col("hits") >= 0) & (F.col("hits") <= F.col("most"))).alias("bounded"))


@query(CACHES)
def arc_weighted(spark, d):
    return _report(spark, d, "arc", 200_000)


@query(CACHES)
def lfu_weighted(spark, d):
    return _report(spark, d, "lfu", 200_000)


@query(CACHES)
def tier_weighted(spark, d):
    return _report(spark, d, "tiers", 200_000)


@query(REQS + """, a AS (SELECT (user_id % 10)::VARCHAR AS cache, event_id AS seq, uri, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM r)
SELECT cache, count(*) AS accesses, count(DISTINCT uri) AS keys FROM a GROUP BY cache""")
def fifo_ttl(spark, d):
    """First in, first out with a time to live that never ends and room for all: only first accesses miss."""
    a = _weighted(spark, d)
    got = cachesim.simulate(a, "fifo", 1 << 40, ttl=1e18)
    return got.select("cache", "accesses", (F.col("accesses") - F.col("hits")).alias("keys"))


@query(REQS + "SELECT method, count(*) AS n FROM r GROUP BY method")
def simulate_plugin(spark, d):
    """A named plugin run over the trace."""
    from siltstone.operators import trace

    plugins.register("methods", lambda rows, args: rows.groupBy(args["by"]).agg(F.count(F.lit(1)).alias("n")))
    return plugins.simulate("methods", trace.requests(T(spark, d, "events")), {"by": "method"})

