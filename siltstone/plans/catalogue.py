"""All registered queries of the library, each with its DuckDB twin where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import chunkers, references
from siltstone.operators import cachesim, cluster, dedup, ingest, pairblocks, placement, registry, similarity, trace
from siltstone.plans.register import QUERIES, SQL, Query, T, query
from siltstone.sources import archives
from siltstone.streaming import events as ev


def _docs(spark, d):
    return T(spark, d, "documents")


def _chunks(spark, d):
    return dedup.document_chunks(_docs(spark, d))


def _reqs(spark, d):
    return trace.requests(T(spark, d, "events"))


def _hashes(spark, d):
    return similarity.sign_hash(T(spark, d, "embeddings"))


PIECE = """WITH pc AS (SELECT doc_id, lang, source, i::INT AS ordinal, unhex(substr(h, i * 1024 + 1, 1024)) AS b
  FROM (SELECT doc_id, lang, source, h, unnest(range(0, (length(h) + 1023) // 1024)) AS i
        FROM (SELECT doc_id, lang, source, hex(encode(text)) AS h FROM documents))),
c AS (SELECT doc_id, lang, source, ordinal, sha256(b) AS hash, octet_length(b)::BIGINT AS size FROM pc),
g AS (SELECT hash, count(*) AS n, sum(size)::BIGINT AS b, min(size) AS s FROM c GROUP BY hash)
"""
HOST = ", hc AS (SELECT *, 'host' || (('0x' || substr(hash, 1, 4))::BIGINT % 4) AS host FROM c)\n"
FIRST = ", fc AS (SELECT hash, doc_id, ordinal, size FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id, ordinal) AS rn FROM c) WHERE rn = 1)\n"
REQS = """WITH r AS (SELECT event_id, ts, user_id, event_type, value AS duration,
  CASE WHEN event_type IN ('view', 'click', 'error') THEN 'GET' ELSE 'PUT' END AS method, 'repo' || (user_id % 10) AS repo,
  'v2/repo' || (user_id % 10) || '/' || CASE WHEN event_type = 'error' THEN 'manifests' ELSE 'blobs' END || '/' || regexp_extract(props, '"k": ([0-9]+)', 1) AS uri,
  round(value * 100)::BIGINT AS written FROM events)
"""
HASHES = """WITH h AS (SELECT vec_id, label,
  list_sum([CASE WHEN embedding[i] >= 0 THEN 1::BIGINT << (i - 1) ELSE 0::BIGINT END FOR i IN range(1, 33)])::BIGINT AS w0,
  list_sum([CASE WHEN embedding[i + 32] >= 0 THEN 1::BIGINT << (i - 1) ELSE 0::BIGINT END FOR i IN range(1, 33)])::BIGINT AS w1 FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, (bit_count(xor(a.w0, b.w0)) + bit_count(xor(a.w1, b.w1)))::INT AS dist,
  a.label AS la, b.label AS lb FROM h a JOIN h b ON a.vec_id < b.vec_id)
"""


# Dedup reports, index, recipes -------------------------------------------------------------

@query(PIECE + "SELECT coalesce(sum(n), 0)::BIGINT AS chunks, count(*) AS unique_chunks, coalesce(sum(b), 0)::BIGINT AS bytes, coalesce(sum(s), 0)::BIGINT AS stored_bytes FROM g")
def dedup_report(spark, d):
    return dedup.dedup_report(_chunks(spark, d))


@query(PIECE + "SELECT doc_id, ordinal, hash, size FROM c")
def chunk_fixed(spark, d):
    return _chunks(spark, d).select("doc_id", "ordinal", "hash", "size")


@query(PIECE + "SELECT doc_id, ordinal, sha256(unhex(rpad(hex(b), 1024, '0'))) AS hash, octet_length(b)::BIGINT AS size FROM pc")
def chunk_padded(spark, d):
    return dedup.padded_chunks(_docs(spark, d))


@query(PIECE + "SELECT sum((n - 1) * s)::BIGINT AS saved_bytes, sum(b)::BIGINT AS bytes FROM g")
def mle_dedup_savings(spark, d):
    return dedup.savings(_chunks(spark, d))


@query(PIECE + "SELECT sum(CASE WHEN n = 1 THEN s ELSE 0 END)::BIGINT AS unique_bytes, sum(CASE WHEN n > 1 THEN s ELSE 0 END)::BIGINT AS first_of_dup_bytes, sum(b)::BIGINT AS total_bytes FROM g")
def mle_size_breakdown(spark, d):
    return dedup.size_breakdown(_chunks(spark, d))


@query(PIECE + "SELECT sum(b - s)::BIGINT AS reduced_bytes, sum(b)::BIGINT AS total_bytes, sum(CASE WHEN n > 1 THEN s ELSE 0 END)::BIGINT AS dup_first_bytes, sum(CASE WHEN n = 1 THEN s ELSE 0 END)::BIGINT AS once_bytes FROM g")
def dedup_4tuple(spark, d):
    return dedup.four_tuple(_chunks(spark, d))


@query(PIECE + ", k AS (SELECT lang, hash, sum(size) AS b, min(size) AS s FROM c GROUP BY lang, hash) SELECT sum(b - s)::BIGINT AS reduced_bytes, sum(b)::BIGINT AS total_bytes, round(sum(b - s)::DOUBLE / sum(b), 6) AS ratio FROM k")
def cluster_dedup_ratio(spark, d):
    return dedup.keyed_ratio(_chunks(spark, d), "lang")


@query(PIECE + "SELECT sum(b - s)::BIGINT AS reduced_bytes, sum(b)::BIGINT AS total_bytes, round(sum(b - s)::DOUBLE / sum(b), 6) AS ratio FROM g")
def optimal_dedup_ratio(spark, d):
    return dedup.keyed_ratio(_chunks(spark, d))


@query(PIECE + """, t AS (SELECT 'optimal' AS scheme, '' AS key, hash, size FROM c UNION ALL SELECT 'lang', lang, hash, size FROM c UNION ALL SELECT 'source', source, hash, size FROM c),
k AS (SELECT scheme, key, hash, sum(size) AS b, min(size) AS s FROM t GROUP BY ALL)
SELECT scheme, sum(b - s)::BIGINT AS reduced_bytes, sum(b)::BIGINT AS total_bytes FROM k GROUP BY scheme""")
def keying_comparison(spark, d):
    return dedup.keying_comparison(_chunks(spark, d), {"optimal": (), "lang": ("lang",), "source": ("source",)})


@query(PIECE + FIRST + "SELECT * FROM fc")
def first_chunk_per_hash(spark, d):
    return dedup.first_chunks(_chunks(spark, d))


@query(PIECE + "SELECT doc_id, ordinal, hash, size FROM c WHERE doc_id % 2 = 1 AND hash IN (SELECT hash FROM c WHERE doc_id % 2 = 0)")
def chunk_index_hit(spark, d):
    c = _chunks(spark, d)
    return dedup.index_hits(c.where("doc_id % 2 = 1"), c.where("doc_id % 2 = 0")).select("doc_id", "ordinal", "hash", "size")


@query(PIECE + "SELECT hash, arg_min(doc_id, doc_id * 1000000 + ordinal) AS doc_id, arg_min(ordinal, doc_id * 1000000 + ordinal) AS ordinal, min(size) AS size FROM c WHERE doc_id % 2 = 1 AND hash NOT IN (SELECT hash FROM c WHERE doc_id % 2 = 0) GROUP BY hash")
def chunk_index_new(spark, d):
    c = _chunks(spark, d)
    return dedup.index_misses(c.where("doc_id % 2 = 1"), c.where("doc_id % 2 = 0"))


@query("SELECT doc_id, ((octet_length(encode(text)) + 511) // 512)::BIGINT AS chunks, sha256(encode(text)) AS restored_sha256 FROM documents WHERE text <> ''")
def restore_roundtrip(spark, d):
    return dedup.restore(_docs(spark, d))


@query(PIECE + "SELECT doc_id, ordinal, size, coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM c")
def recipe_offsets(spark, d):
    return dedup.recipe_offsets(_chunks(spark, d))


@query(PIECE + HOST + "SELECT doc_id, host, count(*) AS fcnt, sum(size)::BIGINT AS slice_size FROM hc GROUP BY doc_id, host")
def slices_per_host(spark, d):
    return dedup.slices(_chunks(spark, d))


@query(PIECE + HOST + """, s AS (SELECT doc_id, host, count(*) AS n, sum(size)::BIGINT AS z FROM hc GROUP BY doc_id, host),
m AS (SELECT doc_id, host FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY z DESC, host) AS rn FROM s) WHERE rn = 1)
SELECT s.doc_id, sum(z)::BIGINT AS uncompression_size, sum(n)::BIGINT AS fcnt, count(*) AS n_hosts, min(m.host) AS master FROM s JOIN m ON s.doc_id = m.doc_id GROUP BY s.doc_id""")
def layer_recipe(spark, d):
    return dedup.layer_recipe(_chunks(spark, d))


@query(PIECE + FIRST + "SELECT host, count(*) AS files, sum(size)::BIGINT AS bytes FROM (SELECT *, 'host' || (('0x' || substr(hash, 1, 4))::BIGINT % 4) AS host FROM fc) WHERE host <> 'host0' GROUP BY host")
def forward_map(spark, d):
    return dedup.forward_map(_chunks(spark, d))


@query("SELECT lang, source, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY CUBE (lang, source)")
def cube_report(spark, d):
    return _docs(spark, d).cube("lang", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, lang, CASE WHEN rn <= n // 2 THEN 'train' ELSE 'test' END AS part FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, substr(m, 1, 1) ORDER BY m, doc_id) AS rn, count(*) OVER (PARTITION BY lang, substr(m, 1, 1)) AS n FROM (SELECT doc_id, lang, md5(doc_id::VARCHAR) AS m FROM documents))")
def train_test_split(spark, d):
    m = _docs(spark, d).select("doc_id", "lang", F.md5(F.col("doc_id").cast("string")).alias("m"))
    g = Window.partitionBy("lang", F.substring("m", 1, 1))
    rows = m.withColumn("rn", F.row_number().over(g.orderBy("m", "doc_id"))).withColumn("n", F.count(F.lit(1)).over(g))
    return rows.select("doc_id", "lang", F.when(F.col("rn") <= F.floor(F.col("n") / 2), "train").otherwise("test").alias("part"))


@query("SELECT lang, count(*) AS n, count(DISTINCT text) AS n_unique, max(c) AS freq FROM (SELECT lang, text, count(*) OVER (PARTITION BY lang, text) AS c FROM documents) GROUP BY lang")
def describe_texts(spark, d):
    n = _docs(spark, d).groupBy("lang", F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("c"))
    return n.groupBy("lang").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_unique"), F.max("c").alias("freq"))


# Traces ------------------------------------------------------------------------------------

@query(REQS + "SELECT event_id, uri, written, path FROM r JOIN (SELECT (p_partkey * 7 % 5000) AS size, min('layer/' || p_partkey) AS path FROM part GROUP BY 1) ON size = written WHERE method = 'GET' AND uri LIKE '%blobs%' AND written > 500")
def trace_filter_map(spark, d):
    files = T(spark, d, "part").select((F.col("p_partkey") * 7 % 5000).alias("size"), F.concat(F.lit("layer/"), "p_partkey").alias("path"))
    return trace.map_to_files(_reqs(spark, d), files, 500)


@query(REQS + "SELECT event_id, written, rn::INT AS rn FROM (SELECT event_id, written, row_number() OVER (PARTITION BY written ORDER BY event_id) AS rn FROM r) WHERE rn <= 3")
def trace_cap_per_size(spark, d):
    return trace.cap_per_size(_reqs(spark, d), 2)


@query(REQS + "SELECT event_id, epoch_us(ts) - min(epoch_us(ts)) OVER () AS delay_us FROM r")
def trace_delay(spark, d):
    return trace.delays(_reqs(spark, d))


@query(REQS + "SELECT * FROM (SELECT event_id, epoch_us(ts) - min(epoch_us(ts)) OVER () AS delay_us FROM r) WHERE delay_us <= 86400000000")
def trace_limit_seconds(spark, d):
    return trace.limit_seconds(_reqs(spark, d), 86400)


@query(REQS + "SELECT event_id FROM r ORDER BY ts, event_id LIMIT 500")
def trace_limit_requests(spark, d):
    return trace.limit_requests(_reqs(spark, d), 500)


RESPONSES = """, x AS (SELECT epoch_us(ts) / 1000000.0::DOUBLE AS t, duration / 100 AS dur, CASE WHEN event_type = 'error' THEN 'failed' WHEN duration < 50 THEN 'yes' ELSE 'no' END AS ot, written AS size FROM r)
"""


@query(REQS + RESPONSES + """SELECT sum(CASE WHEN ot <> 'failed' THEN 1 ELSE 0 END)::BIGINT AS successful, sum(CASE WHEN ot = 'failed' THEN 1 ELSE 0 END)::BIGINT AS failed,
round(max(CASE WHEN ot <> 'failed' THEN t + dur END) - min(t), 3) AS duration, sum(CASE WHEN ot <> 'failed' THEN size END)::BIGINT AS bytes,
round(avg(CASE WHEN ot <> 'failed' THEN dur END), 6) AS avg_latency, round(avg(CASE WHEN ot = 'yes' THEN 1.0::DOUBLE WHEN ot = 'no' THEN 0.0::DOUBLE END), 6) AS on_time,
round(sum(CASE WHEN ot <> 'failed' THEN 1 ELSE 0 END) / (max(CASE WHEN ot <> 'failed' THEN t + dur END) - min(t)), 6) AS throughput FROM x""")
def replay_stats(spark, d):
    r = _reqs(spark, d).select(
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("time"), (F.col("duration") / 100).alias("duration"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("duration") < 50, "yes").otherwise("no").alias("on_time"),
        F.col("written").alias("size"),
    )
    return trace.replay_stats(r)


@query(REQS + "SELECT uri, event_id, written FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY event_id) AS rn FROM r) WHERE rn = 1")
def warmup_first_seen(spark, d):
    return trace.warmup(_reqs(spark, d))


@query(REQS + ", w AS (SELECT uri, arg_min(written, event_id) AS written FROM r GROUP BY uri) SELECT sum(written)::BIGINT AS warmup_bytes, sum(DISTINCT written)::BIGINT AS stored_bytes, round(sum(written)::DOUBLE / sum(DISTINCT written)::DOUBLE, 6) AS ratio FROM w")
def warmup_dedup_ratio(spark, d):
    return trace.warmup_size(_reqs(spark, d))


def _known(spark, d):
    """What warm-up stored: uris that end in an even digit; those in 0 are bad."""
    u = _reqs(spark, d).select("uri").distinct().where(F.col("uri").rlike("[02468]$"))
    return u.select("uri", F.when(F.col("uri").endswith("0"), "bad").otherwise(F.sha2("uri", 256)).alias("digest"))


KNOWN = ", k AS (SELECT DISTINCT uri, CASE WHEN uri LIKE '%0' THEN 'bad' ELSE sha256(uri) END AS digest FROM r WHERE regexp_matches(uri, '[02468]$'))\n"


@query(REQS + KNOWN + "SELECT event_id, CASE WHEN digest IS NULL THEN 'PUT' ELSE 'GET' END AS verb, (row_number() OVER (ORDER BY event_id) - 1) % 10 AS client FROM r LEFT JOIN k ON r.uri = k.uri WHERE coalesce(digest, '') <> 'bad'")
def replay_plan(spark, d):
    return trace.replay_plan(_reqs(spark, d), _known(spark, d), 10)


@query(REQS + "SELECT repo, uri, count(*) AS pulls FROM r WHERE method = 'GET' GROUP BY repo, uri")
def pull_counts(spark, d):
    return trace.pulls(_reqs(spark, d))


@query(REQS + "SELECT uri FROM r GROUP BY uri HAVING count(*) >= 15")
def hot_layers(spark, d):
    n = _reqs(spark, d).groupBy("uri").agg(F.count(F.lit(1)).alias("n"))
    return n.where("n >= 15").select("uri")


@query(REQS + KNOWN + "SELECT repo, r.uri AS uri, count(*) AS pulls FROM r WHERE method = 'GET' AND uri NOT IN (SELECT uri FROM k) GROUP BY repo, r.uri HAVING count(*) >= 2")
def preconstruct_candidates(spark, d):
    return trace.pulls(_reqs(spark, d)).where("pulls >= 2").join(_known(spark, d), "uri", "left_anti").select("repo", "uri", "pulls")


@query(REQS + ", m AS (SELECT uri, CASE WHEN event_type = 'error' OR written % 3 = 0 THEN 'bad' ELSE sha256(uri) END AS digest FROM r) SELECT uri, coalesce(min(CASE WHEN digest <> 'bad' THEN digest END), 'bad') AS digest FROM m GROUP BY uri")
def trace_merge_good_wins(spark, d):
    bad = (F.col("event_type") == "error") | (F.col("written") % 3 == 0)
    return trace.merge_good_wins(_reqs(spark, d).select("uri", F.when(bad, "bad").otherwise(F.sha2("uri", 256)).alias("digest")))


@query(REQS + "SELECT event_id, upper(trim(' ' || lower(method) || ' ')) AS reqtype, 'user' || user_id AS usr, split_part(uri, '/', 2) AS name FROM r")
def request_attributes(spark, d):
    r = _reqs(spark, d)
    return r.select(
        "event_id", F.upper(F.trim(F.concat(F.lit(" "), F.lower("method"), F.lit(" ")))).alias("reqtype"),
        F.concat(F.lit("user"), "user_id").alias("usr"), F.split("uri", "/")[1].alias("name"),
    )


@query()
def slot_simulation(spark, d):
    return trace.assign_slots(_reqs(spark, d), 4)


@query(REQS + "SELECT repo, count(*) AS requests, true AS in_time, 4 AS slots FROM r GROUP BY repo")
def slot_simulation_totals(spark, d):
    """No request starts before its time, and every worker is used."""
    r = _reqs(spark, d)
    at = r.select("repo", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    got = trace.assign_slots(r, 4).join(at, "event_id")
    return got.groupBy("repo").agg(
        F.count(F.lit(1)).alias("requests"), F.min((F.col("start") >= F.col("t")).cast("int")).cast("boolean").alias("in_time"),
        F.count_distinct("slot").cast("int").alias("slots"),
    )


# Registry ----------------------------------------------------------------------------------

@query("SELECT doc_id AS digest FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def gc_mark_sweep(spark, d):
    docs, labels = _docs(spark, d).select(F.col("doc_id").alias("digest")), T(spark, d, "labels")
    return registry.sweep(docs, *[labels.where(f"toxic = {t}").select(F.col("doc_id").alias("digest")) for t in (0, 1)])


@query("SELECT o_orderkey AS digest FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def gc_shared_refs(spark, d):
    return registry.sweep(T(spark, d, "orders").select(F.col("o_orderkey").alias("digest")), T(spark, d, "lineitem").select(F.col("l_orderkey").alias("digest")))


@query("SELECT DISTINCT l_orderkey AS manifest, l_partkey AS target FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def manifest_missing_refs(spark, d):
    refs = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("manifest"), F.col("l_partkey").alias("target"))
    return registry.missing_references(refs, T(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("target")))


@query("SELECT c_custkey, o_orderkey, o_orderpriority AS tag FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer)")
def tag_lookup(spark, d):
    c = T(spark, d, "customer")
    first = c.agg(F.min("c_mktsegment").alias("c_mktsegment"))
    return c.join(first, "c_mktsegment").join(T(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).select(
        "c_custkey", "o_orderkey", F.col("o_orderpriority").alias("tag")
    )


@query("SELECT o_custkey::VARCHAR AS repo, o_orderpriority AS tag, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS digest FROM orders GROUP BY 1, 2")
def latest_tags(spark, d):
    o = T(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("repo"), F.col("o_orderpriority").alias("tag"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("digest")
    )
    return registry.latest_tags(o)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def repo_membership(spark, d):
    o = T(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return T(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


URL = "WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS u FROM pages)\n"


def _urls(spark, d):
    return T(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("u"))


@query(URL + "SELECT DISTINCT u AS repo FROM u WHERE translate(u, '/', chr(1)) > translate('m.', '/', chr(1)) ORDER BY translate(u, '/', chr(1)) LIMIT 50")
def catalog_page(spark, d):
    return registry.catalog_page(_urls(spark, d).select(F.col("u").alias("repo")), "m.", 50)


REF = """, f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN u WHEN 1 THEN u || ':v' || page_id WHEN 2 THEN regexp_replace(u, '^[^/]*/', '') ELSE u || '@sha256:' || sha256(u) END AS ref FROM u),
n AS (SELECT page_id, ref, CASE WHEN contains(ref, '@') THEN regexp_extract(ref, '@(.+)$', 1) ELSE '' END AS digest, regexp_replace(ref, '@.+$', '') AS name FROM f),
b AS (SELECT *, regexp_extract(name, ':([0-9A-Za-z_][0-9A-Za-z_.-]{0,127})$', 1) AS tag0, regexp_replace(name, ':[0-9A-Za-z_][0-9A-Za-z_.-]{0,127}$', '') AS bare FROM n),
h AS (SELECT *, split_part(bare, '/', 1) AS head FROM b),
q AS (SELECT *, contains(bare, '/') AND (contains(head, '.') OR contains(head, ':') OR head = 'localhost') AS has FROM h)
"""


def _refs(spark, d):
    u, p = F.col("u"), F.col("page_id") % 4
    ref = F.when(p == 0, u).when(p == 1, F.concat(u, F.lit(":v"), "page_id")).when(p == 2, F.regexp_replace(u, "^[^/]*/", "")).otherwise(F.concat(u, F.lit("@sha256:"), F.sha2(u, 256)))
    return _urls(spark, d).select("page_id", "u", ref.alias("ref"))


@query(URL + REF + "SELECT page_id, CASE WHEN has THEN head ELSE 'docker.io' END AS domain, CASE WHEN has THEN regexp_replace(bare, '^[^/]*/', '') WHEN contains(bare, '/') THEN bare ELSE 'library/' || bare END AS path, CASE WHEN tag0 <> '' THEN tag0 WHEN digest = '' THEN 'latest' ELSE '' END AS tag, digest FROM q")
def ref_parse_normalize(spark, d):
    return _refs(spark, d).select("page_id", *[c.alias(n) for n, c in references.parse(F.col("ref")).items()])


@query(URL + "SELECT page_id, '/docker/registry/v2/blobs/sha256/' || substr(sha256(url), 1, 2) || '/' || sha256(url) || '/data' AS blob_path, '/docker/registry/v2/repositories/' || u || '/_layers/sha256/' || sha256(url) || '/link' AS link_path FROM u")
def path_for(spark, d):
    h = F.concat(F.lit("sha256:"), F.sha2("url", 256))
    return _urls(spark, d).select("page_id", references.blob_path(h).alias("blob_path"), references.layer_link_path(F.col("u"), h).alias("link_path"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE sha256(url) END AS digest FROM pages")
def digest_from_path(spark, d):
    good = references.blob_path(F.sha2("url", 256))
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/blobs/sha256/zz/"), "url")).otherwise(good)
    return _urls(spark, d).select("page_id", references.digest_of_path(path).alias("digest"))


@query("SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9/.-]+', '', 'g') AS path FROM pages")
def sanitize_path(spark, d):
    return T(spark, d, "pages").select("page_id", references.sanitize(F.col("url")).alias("path"))


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '^https://') AND NOT regexp_matches(url, 'example\\.net')")
def foreign_layer_urls(spark, d):
    return registry.allowed_urls(T(spark, d, "pages"), "^https://", r"example\.net").select("page_id")


@query("SELECT o_orderkey AS upload_id FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-01-01'")
def purge_uploads(spark, d):
    u = T(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("upload_id"), F.col("o_orderdate").alias("started_at"))
    return registry.purge(u, "1998-01-01").select("upload_id")


@query("SELECT event_id FROM events WHERE event_type NOT IN ('error')")
def media_type_filter(spark, d):
    return ev.without_ignored(T(spark, d, "events")).select("event_id")


@query("WITH o AS (SELECT DISTINCT s_nationkey AS m FROM supplier WHERE s_acctbal > 5000), n AS (SELECT DISTINCT c_nationkey AS m FROM customer WHERE c_acctbal > 9900) SELECT m AS member, 'removed' AS change FROM o WHERE m NOT IN (SELECT m FROM n) UNION ALL SELECT m, 'added' FROM n WHERE m NOT IN (SELECT m FROM o)")
def membership_diff(spark, d):
    old = T(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("member"))
    return registry.membership_changes(old, T(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("member")))


def _digests(spark, d):
    return _docs(spark, d).select(F.sha2("text", 256).alias("digest"))


@query("WITH g AS (SELECT DISTINCT sha256(text) AS digest FROM documents), w AS (SELECT DISTINCT substr(md5(i::VARCHAR), 1, 3) AS prefix FROM range(0, 500) t(i)), m AS (SELECT substr(digest, 1, 3) AS prefix, count(*) AS n, min(digest) AS x FROM g GROUP BY 1) SELECT w.prefix, coalesce(n, 0)::BIGINT AS matches, CASE WHEN n = 1 THEN x END AS digest FROM w LEFT JOIN m ON w.prefix = m.prefix")
def short_digest_prefix(spark, d):
    wanted = spark.range(500).select(F.substring(F.md5(F.col("id").cast("string")), 1, 3).alias("prefix")).distinct()
    return registry.prefix_lookup(_digests(spark, d), wanted, 3)


@query("""WITH g AS (SELECT DISTINCT sha256(text) AS x FROM documents), n AS (SELECT x, lag(x) OVER (ORDER BY x) AS a, lead(x) OVER (ORDER BY x) AS b FROM g),
l AS (SELECT x, coalesce(list_max([CASE WHEN substr(x, 1, i) = substr(a, 1, i) THEN i ELSE 0 END FOR i IN range(0, 65)]), 0) AS ca, coalesce(list_max([CASE WHEN substr(x, 1, i) = substr(b, 1, i) THEN i ELSE 0 END FOR i IN range(0, 65)]), 0) AS cb FROM n)
SELECT x AS digest, substr(x, 1, greatest(4, ca + 1, cb + 1)::INT) AS code FROM l""")
def short_code_table(spark, d):
    return registry.short_codes(_digests(spark, d), 4)


@query("SELECT o_orderkey AS name, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'r' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') THEN 'a' END AS target FROM orders")
def link_resolution(spark, d):
    li = T(spark, d, "lineitem")
    table = lambda flag: li.where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("name")).distinct().withColumn("target", F.lit(flag.lower()))
    return registry.resolve_links(T(spark, d, "orders").select(F.col("o_orderkey").alias("name")), table("R"), table("A"))


@query("SELECT 'src1' AS repo, digest FROM (SELECT DISTINCT sha256(text) AS digest FROM documents WHERE source = 'src0') WHERE substr(digest, 1, 1) < '8' AND digest NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src1')")
def cross_repo_mount(spark, d):
    blobs = _docs(spark, d).select(F.col("source").alias("repo"), F.sha2("text", 256).alias("digest"))
    return registry.mount(blobs, "src0", "src1", blobs.where("substring(digest, 1, 1) < '8'").select("digest").distinct())


@query("SELECT conv_id AS manifest, '[\"' || string_agg(sha256(text), '\",\"' ORDER BY turn) || '\"]' AS layers FROM conversations GROUP BY conv_id")
def manifest_build(spark, d):
    refs = T(spark, d, "conversations").select(F.col("conv_id").alias("manifest"), F.col("turn").alias("ordinal"), F.sha2("text", 256).alias("target"))
    return registry.build_manifest(refs)


@query("SELECT l_orderkey AS \"list\", arg_min(l_partkey, l_linenumber * 100000000 + l_partkey) AS manifest FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' GROUP BY 1")
def platform_select(spark, d):
    m = T(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("list"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("manifest"),
        F.when(F.col("l_returnflag") == "A", "linux").otherwise("other").alias("os"), F.when(F.col("l_linestatus") == "F", "amd64").otherwise("arm").alias("architecture"),
    )
    return registry.select_platform(m)


# Similarity --------------------------------------------------------------------------------

@query(HASHES + "SELECT * FROM h")
def sign_hash(spark, d):
    return _hashes(spark, d)


@query(HASHES + "SELECT a, b, dist FROM p WHERE dist <= 20")
def hamming_pairs(spark, d):
    return similarity.hamming_pairs(_hashes(spark, d), 20)


@query(HASHES + "SELECT a, b, dist FROM p WHERE dist <= 15")
def hamming_banded(spark, d):
    return similarity.hamming_banded(_hashes(spark, d), 15)


KNN = ", n AS (SELECT b AS vec_id, a AS neighbour, dist, row_number() OVER (PARTITION BY b ORDER BY dist, a DESC)::INT AS rank FROM p WHERE dist <= 26)\n"


@query(HASHES + KNN + "SELECT * FROM n WHERE rank <= 20")
def hamming_knn(spark, d):
    return similarity.nearest_earlier(_hashes(spark, d), 20, 26)


@query(HASHES + KNN + "SELECT vec_id, rank, min(dist) OVER (PARTITION BY vec_id ORDER BY rank) AS best FROM n WHERE rank <= 20")
def candidate_depth_min(spark, d):
    return similarity.running_best(similarity.nearest_earlier(_hashes(spark, d), 20, 26))


@query(HASHES + KNN + ", b AS (SELECT rank, min(dist) OVER (PARTITION BY vec_id ORDER BY rank) AS best FROM n WHERE rank <= 20) SELECT rank, count(*) AS vectors, sum(best)::BIGINT AS total FROM b GROUP BY rank")
def candidate_depth_totals(spark, d):
    return similarity.depth_totals(similarity.nearest_earlier(_hashes(spark, d), 20, 26))


@query("""WITH e AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings),
j AS (SELECT a.vec_id AS q, b.vec_id AS vec_id, a.v AS x, b.v AS y FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
m AS (SELECT *, list_sum([x[i] * y[i] FOR i IN range(1, 65)]) AS xy, list_sum([z * z FOR z IN x]) AS xx, list_sum([z * z FOR z IN y]) AS yy FROM j)
SELECT q, vec_id, round(list_sum([abs(x[i] - y[i]) FOR i IN range(1, 65)]), 4) AS l1, round(sqrt(list_sum([(x[i] - y[i]) ** 2 FOR i IN range(1, 65)])), 4) AS l2,
round(1 - xy / sqrt(xx * yy), 4) AS cosine, round(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, xy / sqrt(xx * yy)))), 4) AS angle,
round(1 - list_sum([CASE WHEN x[i] > 0 AND y[i] > 0 THEN 1 ELSE 0 END FOR i IN range(1, 65)])::DOUBLE / greatest(1, list_sum([CASE WHEN x[i] > 0 OR y[i] > 0 THEN 1 ELSE 0 END FOR i IN range(1, 65)])), 4) AS jaccard FROM m""")
def vector_distances(spark, d):
    return similarity.query_distances(T(spark, d, "embeddings"))


COMPONENTS = HASHES.replace("WITH h", "WITH RECURSIVE h") + """, e AS (SELECT a, b FROM p WHERE dist <= 20 UNION ALL SELECT b, a FROM p WHERE dist <= 20),
r AS (SELECT vec_id AS v, vec_id AS l FROM h UNION SELECT e.b, r.l FROM r JOIN e ON e.a = r.v),
k AS (SELECT v AS vec_id, min(l) AS cluster FROM r GROUP BY v)
"""


def _components(spark, d):
    h = _hashes(spark, d)
    return cluster.components(h, similarity.hamming_pairs(h, 20))


@query(COMPONENTS + "SELECT * FROM k")
def cluster_components(spark, d):
    return _components(spark, d)


@query(COMPONENTS + ", z AS (SELECT cluster, count(*) AS n FROM k GROUP BY cluster), s AS (SELECT n, count(*) AS c FROM z GROUP BY n) SELECT n AS members, c AS clusters, round(sum(c) OVER (ORDER BY n)::DOUBLE / sum(c) OVER ()::DOUBLE, 6) AS ecdf FROM s")
def cluster_sizes_ecdf(spark, d):
    n = _components(spark, d).groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    sizes = n.groupBy("members").agg(F.count(F.lit(1)).alias("clusters"))  # a row for each size that occurs
    w = Window.orderBy("members").rowsBetween(Window.unboundedPreceding, 0)
    total = sizes.agg(F.sum("clusters").alias("all"))
    return sizes.withColumn("upto", F.sum("clusters").over(w)).crossJoin(total).select(
        "members", "clusters", F.round(F.col("upto") / F.col("all"), 6).alias("ecdf")
    )


@query(HASHES + """, c AS (SELECT label, x, sum(dist) AS cost FROM (SELECT la AS label, a AS x, dist FROM p WHERE la = lb UNION ALL SELECT la, b, dist FROM p WHERE la = lb) GROUP BY label, x),
f AS (SELECT h.label AS cluster, h.vec_id, coalesce(cost, 0)::BIGINT AS cost FROM h LEFT JOIN c ON h.vec_id = c.x)
SELECT cluster, count(*) AS members, arg_min(vec_id, cost * 1000000 + vec_id) AS medoid, min(cost) AS cost FROM f GROUP BY cluster""")
def cluster_medoid(spark, d):
    h = _hashes(spark, d)
    pairs = similarity.grid_pairs(h).where("a.label = b.label").select(
        F.col("a.label").alias("cluster"), F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), similarity.hamming("a", "b").alias("dist")
    )
    return similarity.medoids(h.select("vec_id", F.col("label").alias("cluster")), pairs)


RANKED = HASHES + """, k AS (SELECT q, v, hit, row_number() OVER (PARTITION BY q ORDER BY dist, v) AS rank FROM (SELECT a AS q, b AS v, dist, (la = lb)::INT AS hit FROM p UNION ALL SELECT b, a, dist, (la = lb)::INT FROM p) WHERE q % 20 = 0),
t AS (SELECT * FROM k WHERE rank <= 5)
"""


@query(RANKED + "SELECT round(avg(h1), 6) AS top1, round(avg(h5), 6) AS top5 FROM (SELECT q, max(CASE WHEN rank <= 1 THEN hit ELSE 0 END) AS h1, max(hit) AS h5 FROM t GROUP BY q)")
def topk_accuracy(spark, d):
    return similarity.top_k_accuracy(similarity.ranked_queries(_hashes(spark, d), 5), 1, 5)


@query(RANKED + ", s AS (SELECT q, CASE WHEN hit = 1 THEN sum(hit) OVER (PARTITION BY q ORDER BY rank) / rank END AS p FROM t) SELECT round(avg(ap), 6) AS map FROM (SELECT coalesce(avg(p), 0) AS ap FROM s GROUP BY q)")
def map_at_k(spark, d):
    return similarity.mean_average_precision(similarity.ranked_queries(_hashes(spark, d), 5))


@query(HASHES + "SELECT label, max(n) AS most, sum(n)::BIGINT AS vectors FROM (SELECT label, w0 & 255 AS x, count(*) AS n FROM h GROUP BY 1, 2) GROUP BY label")
def hash_consistency(spark, d):
    return similarity.hash_consistency(_hashes(spark, d))


SF = """WITH w AS (SELECT doc_id, unnest(list_distinct(string_split(text, ' '))) AS w FROM documents),
f AS (SELECT doc_id, """ + ", ".join(f"min(md5('{i}:' || w)) AS f{i}" for i in range(12)) + """ FROM w GROUP BY doc_id),
g AS (SELECT doc_id, list_sort([f0, f1, f2, f3]) AS a, list_sort([f4, f5, f6, f7]) AS b, list_sort([f8, f9, f10, f11]) AS c FROM f),
s AS (SELECT doc_id, """ + ", ".join(f"md5(a[{i + 1}] || '|' || b[{i + 1}] || '|' || c[{i + 1}]) AS sf{i}" for i in range(4)) + " FROM g)\n"


@query(SF + "SELECT sf2, count(*) AS files, min(doc_id) AS first FROM s GROUP BY sf2 HAVING count(*) > 1")
def superfeature_groups(spark, d):
    sf = similarity.superfeatures(_docs(spark, d))
    return sf.groupBy("sf2").agg(F.count(F.lit(1)).alias("files"), F.min("doc_id").alias("first")).where("files > 1")


@query(SF + "SELECT doc_id, coalesce(" + ", ".join(f"lag(doc_id) OVER (PARTITION BY sf{i} ORDER BY doc_id)" for i in range(4)) + ") AS reference FROM s")
def superfeature_reference(spark, d):
    return similarity.newest_earlier(similarity.superfeatures(_docs(spark, d)), "sf0", "sf1", "sf2", "sf3")


@query()
def leader_clusters(spark, d):
    return cluster.leader_clusters(_hashes(spark, d), 20)


@query()
def kmeans_clusters(spark, d):
    return cluster.kmeans(T(spark, d, "embeddings"), 10)


# Ingest rules ------------------------------------------------------------------------------

LAYERS = "WITH l AS (SELECT source AS repo, doc_id AS seq, octet_length(encode(text))::BIGINT AS stored, n_chars AS compressed FROM documents)\n"


def _layers(spark, d):
    return _docs(spark, d).select(F.col("source").alias("repo"), F.col("doc_id").alias("seq"), F.octet_length("text").cast("long").alias("stored"), F.col("n_chars").alias("compressed"))


@query(LAYERS + "SELECT repo, seq FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq) AS n FROM l) WHERE n > 10 AND stored > 1.03 * compressed")
def mode_keep_raw(spark, d):
    return ingest.keep_raw(_layers(spark, d), 10, 1.03).select("repo", "seq")


@query("WITH l AS (SELECT lang || source AS repo, doc_id AS seq FROM documents) SELECT repo, seq FROM l WHERE repo IN (SELECT repo FROM l GROUP BY repo HAVING count(*) < 6)")
def mode_few_layers(spark, d):
    rows = _docs(spark, d).select(F.concat("lang", "source").alias("repo"), F.col("doc_id").alias("seq"))
    return ingest.few_layers(rows, 6)


@query("SELECT doc_id, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS valid FROM documents")
def descriptor_validation(spark, d):
    digest = F.when(F.col("doc_id") % 5 == 0, "sha256:zz").otherwise(F.concat(F.lit("sha256:"), F.sha2("text", 256)))
    size = F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.octet_length("text"))
    return _docs(spark, d).select("doc_id", ingest.valid_descriptor(digest, size, F.col("lang")).alias("valid"))


@query("SELECT hash, min(doc_id) AS doc_id FROM (SELECT sha256(text) AS hash, doc_id FROM documents) WHERE doc_id >= 500 AND hash NOT IN (SELECT sha256(text) FROM documents WHERE doc_id < 500) GROUP BY hash")
def insert_if_absent(spark, d):
    rows = _docs(spark, d).select(F.sha2("text", 256).alias("hash"), "doc_id")
    return ingest.insert_if_absent(rows.where("doc_id < 500"), rows.where("doc_id >= 500"), "hash", "doc_id")


@query("""WITH s AS (SELECT l_orderkey AS upload, l_linenumber AS n, max(l_partkey) AS state FROM lineitem GROUP BY 1, 2), w AS (SELECT o_orderkey AS upload, 3 AS "offset" FROM orders)
SELECT w.upload, w."offset", e.state AS exact, (SELECT arg_max(state, n) FROM s WHERE s.upload = w.upload AND n <= 3) AS nearest FROM w LEFT JOIN s e ON e.upload = w.upload AND e.n = 3""")
def resume_state(spark, d):
    s = T(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("upload"), F.col("l_linenumber").alias("at")).agg(F.max("l_partkey").alias("state"))
    return ingest.resume_state(s, T(spark, d, "orders").select(F.col("o_orderkey").alias("upload"), F.lit(3).alias("offset")))


@query(PIECE + "SELECT doc_id, ordinal, (ordinal * 512)::BIGINT AS \"offset\", size % 4096 AS size, (doc_id % 268435456)::BIGINT AS ref, (ordinal % 4)::BIGINT AS flag FROM c")
def recipe_bit_packing(spark, d):
    c = _chunks(spark, d)
    high, low = ingest.recipe_bits(F.col("ordinal") * 512, F.col("size") % 4096, F.col("doc_id"), F.col("ordinal") % 4)
    packed = c.select("doc_id", "ordinal", high.alias("high"), low.alias("low"))
    return packed.select("doc_id", "ordinal", *[v.alias(k) for k, v in ingest.recipe_fields(F.col("high"), F.col("low")).items()])


@query(REQS + "SELECT lower(method) AS op, repo, written::VARCHAR AS size FROM r")
def operation_log(spark, d):
    lines = _reqs(spark, d).select(F.concat(F.lower("method"), F.lit(" repo:"), "repo", F.lit(" size:"), F.col("written").cast("string")).alias("value"))
    return ingest.parse_log(lines).select("op", F.col("fields.repo").alias("repo"), F.col("fields.size").alias("size"))


@query(HASHES + ", m AS (SELECT b, min(dist) AS cost, arg_min(a, dist * 1000000 + a) AS a FROM p GROUP BY b) SELECT vec_id AS b, CASE WHEN cost < 24 THEN a END AS reference, least(24, coalesce(cost, 24))::INT AS cost FROM h LEFT JOIN m ON vec_id = b")
def best_reference(spark, d):
    h = _hashes(spark, d)
    near = pairblocks.nearest_before(h).select(F.col("neighbour").alias("a"), F.col("vec_id").alias("b"), F.col("dist").alias("cost"))
    return ingest.best_reference(near, h.select(F.col("vec_id").alias("b"), F.lit(24).alias("own_cost")))


@query(HASHES + """, t AS (SELECT 8 * i AS threshold FROM range(1, 6) x(i)), n AS (SELECT b, min(dist) AS dist FROM p GROUP BY b), k AS (SELECT threshold, sum(CASE WHEN dist <= threshold THEN dist ELSE 24 END + threshold // 8)::BIGINT AS cost FROM n, t GROUP BY threshold),
u AS (SELECT *, sum(CASE WHEN cost > before THEN 1 ELSE 0 END) OVER (ORDER BY threshold) AS ups FROM (SELECT *, lag(cost) OVER (ORDER BY threshold) AS before FROM k))
SELECT max(threshold)::INT AS threshold, arg_max(cost, threshold) AS cost FROM u WHERE ups = 0""")
def threshold_sweep(spark, d):
    h = _hashes(spark, d)
    near = similarity.grid_pairs(h).groupBy(F.col("b.vec_id").alias("b")).agg(F.min(similarity.hamming("a", "b")).alias("dist"))
    t = near.withColumn("threshold", F.explode(F.array(*[F.lit(8 * i) for i in range(1, 6)])))
    cost = F.when(F.col("dist") <= F.col("threshold"), F.col("dist")).otherwise(24) + F.floor(F.col("threshold") / 8)
    return ingest.threshold_sweep(t.groupBy("threshold").agg(F.sum(cost).cast("long").alias("cost")))


@query("SELECT run, epoch FROM (SELECT user_id % 10 AS run, event_id AS epoch, count(*) OVER w AS n, max(value + 500) OVER w AS hi, min(value + 500) OVER w AS lo FROM events WINDOW w AS (PARTITION BY user_id % 10 ORDER BY event_id ROWS 9 PRECEDING)) WHERE n = 10 AND hi - lo < 0.05 * lo")
def early_stop(spark, d):
    return ingest.early_stop(T(spark, d, "events").select((F.col("user_id") % 10).alias("run"), F.col("event_id").alias("epoch"), (F.col("value") + 500).alias("loss")))


@query("SELECT doc_id, n_chars > 0 AND NOT contains(source, '7') AS kept FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def failed_file_exclusion(spark, d):
    bad = T(spark, d, "labels").where("quality = 0").select("doc_id")
    return _docs(spark, d).join(bad, "doc_id", "left_anti").select("doc_id", ((F.col("n_chars") > 0) & ~F.col("source").contains("7")).alias("kept"))


@query(REQS + ", a AS (SELECT repo, lag(event_id) OVER (PARTITION BY repo, uri ORDER BY event_id) IS NOT NULL AS hit FROM r) SELECT repo, count(*) AS accesses, sum(hit::INT)::BIGINT AS hits, round(sum(hit::INT)::DOUBLE / count(*), 6) AS rate FROM a GROUP BY repo")
def cache_hit_rate(spark, d):
    n = _reqs(spark, d).groupBy("repo", "uri").agg(F.count(F.lit(1)).alias("n"))
    got = n.groupBy("repo").agg(F.sum("n").alias("accesses"), F.sum(F.col("n") - 1).alias("hits"))
    return got.withColumn("rate", F.round(F.col("hits") / F.col("accesses"), 6))


# Codec, content-defined chunks, archives ---------------------------------------------------

@query()
def fastcdc_chunks(spark, d):
    return chunkers.chunk_table(_docs(spark, d), lambda x: chunkers.fastcdc(x, 256, 512, 1024))


@query()
def rabin_chunks(spark, d):
    return chunkers.chunk_table(_docs(spark, d), lambda x: chunkers.rabin_karp(x, 512, 2048))


REBUILT = "SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes, true AS gapless, count(*) AS docs FROM documents WHERE text <> '' GROUP BY ALL"


def _rebuilt(chunks: DataFrame) -> DataFrame:
    """Chunks of each payload put together again: their bytes, and whether each starts where the one before it ends."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    rows = chunks.withColumn("due", F.coalesce(F.lag(F.col("start") + F.col("size")).over(w), F.lit(0)))
    return rows.groupBy("doc_id").agg(
        F.sum("size").alias("bytes"), F.min((F.col("start") == F.col("due")).cast("int")).cast("boolean").alias("gapless"),
        F.count(F.when(F.col("ordinal") == 0, 1)).alias("docs"),
    )


@query(REBUILT)
def fastcdc_rebuilt(spark, d):
    return _rebuilt(fastcdc_chunks(spark, d))


@query(REBUILT)
def rabin_rebuilt(spark, d):
    return _rebuilt(rabin_chunks(spark, d))


@query()
def compress_strategy(spark, d):
    """Totals by encoding: repeats are dup, others go against the newest earlier document that shares a super-feature."""
    docs = _docs(spark, d).where("text IS NOT NULL").select("doc_id", "text", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    ref = similarity.newest_earlier(similarity.superfeatures(docs), "sf0", "sf1", "sf2", "sf3")
    data = docs.select(F.col("doc_id").alias("reference"), F.col("text").cast("binary").alias("ref"))
    rows = docs.join(first, "h").join(ref, "doc_id", "left").join(data, "reference", "left")
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("data"), F.col("ref").alias("reference"), (F.col("doc_id") != F.col("first")).alias("dup"))
    got = chunkers.strategy(rows)
    return got.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.sum("raw").alias("raw_bytes"))


@query("SELECT count(*) AS docs, sum(raw)::BIGINT AS raw_bytes, (SELECT count(*) - count(DISTINCT text) FROM documents WHERE text IS NOT NULL) AS dups FROM (SELECT octet_length(encode(text)) AS raw FROM documents WHERE text IS NOT NULL)")
def compress_strategy_totals(spark, d):
    """What the strategies must add up to: every payload once, and one dup for each repeat."""
    return compress_strategy(spark, d).agg(
        F.sum("n").alias("docs"), F.sum("raw_bytes").alias("raw_bytes"), F.coalesce(F.sum(F.when(F.col("flag") == "dup", F.col("n"))), F.lit(0)).alias("dups")
    )


@query("SELECT doc_id AS layer, octet_length(encode(coalesce(text, '')))::BIGINT AS size, true AS identical FROM documents")
def token_codec_identity(spark, d):
    return token_codec_roundtrip(spark, d).select("layer", "size", "identical")


@query()
def token_codec_roundtrip(spark, d):
    return archives.codec_report(archives.layers_of(_docs(spark, d)))


@query()
def gzip_tar_scan(spark, d):
    """Documents packed into one tar.gz a source and language, and unpacked again."""
    entries = _docs(spark, d).select(
        F.pmod(F.xxhash64("source", "lang"), F.lit(1 << 40)).alias("layer"), F.concat(F.lit("doc/"), "doc_id").alias("path"), F.lit(0o644).alias("mode"),
        F.coalesce("text", F.lit("")).cast("binary").alias("data"),
    )
    out = archives.unpack_layers(archives.pack_layers(entries))
    return out.select("layer", "path", "mode", "size", F.sha2("data", 256).alias("digest"))


@query("SELECT 'doc/' || doc_id AS path, 420 AS mode, octet_length(encode(coalesce(text, '')))::BIGINT AS size, sha256(encode(coalesce(text, ''))) AS digest FROM documents")
def gzip_tar_entries(spark, d):
    return gzip_tar_scan(spark, d).select("path", "mode", "size", "digest")


# Placement, caches -------------------------------------------------------------------------

@query("""WITH s AS (SELECT s_name AS server, ('0x' || substr(md5(s_name || '#' || i), 1, 8))::BIGINT AS pos FROM supplier, range(0, 8) t(i)),
k AS (SELECT p_partkey AS key, ('0x' || substr(md5(p_partkey::VARCHAR), 1, 8))::BIGINT AS h FROM part),
r AS (SELECT key, arg_min(server, pos) FILTER (WHERE pos >= h) AS a, arg_min(server, pos) AS b FROM k, s GROUP BY key) SELECT key, coalesce(a, b) AS server FROM r""")
def ring_placement(spark, d):
    keys = T(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"))
    servers = T(spark, d, "supplier").select(F.col("s_name").alias("server"))
    return placement.ring_placement(keys, servers).select(F.col("key").cast("long").alias("key"), "server")


@query()
def lpt_placement(spark, d):
    files = T(spark, d, "part").select((F.col("p_partkey") % 50).alias("layer"), F.col("p_partkey").alias("file"), F.round(F.col("p_retailprice") * 100).cast("long").alias("size"))
    return placement.least_loaded(files, [f"server{i}" for i in range(5)])


@query("""WITH f AS (SELECT p_partkey % 50 AS layer, round(p_retailprice * 100)::BIGINT AS size FROM part)
SELECT layer, count(*) AS files, sum(size)::BIGINT AS bytes, least(5, count(*)) AS servers, true AS even FROM f GROUP BY layer""")
def lpt_placement_totals(spark, d):
    """Loads of a layer's servers differ by no more than its largest file."""
    got = lpt_placement(spark, d).groupBy("layer", "server").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.max("size").alias("m"))
    even = (F.count(F.lit(1)) < 5) | (F.max("b") - F.min("b") <= F.max("m"))
    return got.groupBy("layer").agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"), F.count(F.lit(1)).alias("servers"), even.alias("even"))


def _accesses(spark, d):
    return _reqs(spark, d).select((F.col("user_id") % 10).cast("string").alias("cache"), F.col("event_id").alias("seq"), F.col("uri").alias("key"))


LRU = REQS + """, a AS (SELECT (user_id % 10)::VARCHAR AS cache, event_id AS seq, uri, lag(event_id) OVER (PARTITION BY user_id % 10, uri ORDER BY event_id) AS prev, lead(event_id) OVER (PARTITION BY user_id % 10, uri ORDER BY event_id) AS nxt FROM r),
x AS (SELECT n.cache, n.seq, count(m.seq) AS dd FROM a n LEFT JOIN a m ON m.cache = n.cache AND m.seq > n.prev AND m.seq < n.seq AND (m.nxt IS NULL OR m.nxt > n.seq) WHERE n.prev IS NOT NULL GROUP BY 1, 2)
SELECT t.cache, coalesce(h, 0)::BIGINT AS hits, t.c AS accesses FROM (SELECT cache, count(*) AS c FROM a GROUP BY cache) t LEFT JOIN (SELECT cache, count(*) AS h FROM x WHERE dd < 50 GROUP BY cache) y ON t.cache = y.cache"""


@query(LRU)
def lru_sim(spark, d):
    return cachesim.simulate(_accesses(spark, d), "lru", 50)


@query()
def lfu_sim(spark, d):
    return cachesim.simulate(_accesses(spark, d), "lfu", 50)


@query()
def arc_sim(spark, d):
    return cachesim.simulate(_accesses(spark, d), "arc", 50)


@query(LRU)
def lru_hit_rate_exact(spark, d):
    return cachesim.exact_lru(_accesses(spark, d), 50)


# Events ------------------------------------------------------------------------------------

@query("""WITH s AS (SELECT event_id, user_id, event_type = 'error' AS failed FROM events), g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM s),
k AS (SELECT event_id, user_id, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, grp ORDER BY event_id)::BIGINT AS streak FROM g) SELECT event_id, user_id, streak, streak >= 2 AS unhealthy FROM k""")
def health_status(spark, d):
    return registry.health(T(spark, d, "events").select("event_id", "user_id", (F.col("event_type") == "error").alias("failed")), 2, "user_id")


def _time(spark, d):
    return ev.timed(T(spark, d, "events"))


def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows_tumbling(spark, d):
    return _ntz(ev.windowed(_time(spark, d), "1 hour"))


@query("SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' * i AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, range(0, 2) t(i) GROUP BY 1, 2")
def event_windows_sliding(spark, d):
    return _ntz(ev.windowed(_time(spark, d), "1 hour", "30 minutes"))


SESSION = """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '{0}' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k"""


@query(SESSION.format("2 hours"))
def event_windows_session(spark, d):
    return _ntz(ev.sessions(_time(spark, d), "2 hours"))


@query(SESSION.format("30 minutes"))
def ttl_sessions(spark, d):
    return _ntz(ev.sessions(_time(spark, d), "30 minutes"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, d):
    return ev.first_seen(T(spark, d, "events").select("user_id", "event_type"), ["user_id", "event_type"])


@query("SELECT event_type, count(*) AS events, sum(CASE WHEN value < 50 THEN 1 ELSE 0 END)::BIGINT AS success, sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END)::BIGINT AS failures FROM events GROUP BY event_type")
def endpoint_metrics(spark, d):
    ok = F.col("value") < 50
    return T(spark, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum(ok.cast("long")).alias("success"), F.sum((~ok).cast("long")).alias("failures")
    )


@query("SELECT event_id::VARCHAR AS id, CASE event_type WHEN 'view' THEN 'pull' WHEN 'click' THEN 'pull' WHEN 'purchase' THEN 'push' WHEN 'signup' THEN 'mount' ELSE 'delete' END AS action, 'repo' || (user_id % 10) AS repository, round(value * 100)::BIGINT AS size FROM events")
def event_envelopes(spark, d):
    return ev.envelopes(T(spark, d, "events")).select("id", "action", "target.repository", "target.size")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(spark, sf_dir)


def queries() -> dict[str, Query]:
    from siltstone.plans import features, manifests, storage  # noqa: F401  (they register theirs)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
