"""Queries over files, stores, key-value records, uploads and caches of descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone import settings
from siltstone.functions import codecs
from siltstone.operators import dedup, ingest, placement, registry, similarity, store, trace
from siltstone.plans.catalogue import HASHES, REQS, _docs, _hashes, _reqs
from siltstone.plans.register import T, query
from siltstone.sources import archives, tables
from siltstone.sources.checkpoints import new_path

# Files -------------------------------------------------------------------------------------


def _trace(spark, d) -> DataFrame:
    r = _reqs(spark, d)
    return r.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.col("method").alias("http.request.method"), F.col("uri").alias("http.request.uri"),
        F.col("duration").alias("http.request.duration"), F.concat(F.lit("10.0.0."), F.col("user_id") % 250).alias("http.request.remoteaddr"),
        F.col("written").alias("http.response.written"),
    )


@query(REQS + "SELECT method, uri, written, 'client' || (user_id % 250) AS client, count(*) AS n FROM r GROUP BY ALL")
def trace_json_scan(spark, d):
    """The trace written as JSON arrays and scanned again."""
    path = new_path(spark)
    tables.write_trace(_trace(spark, d), path)
    got = tables.read_trace(spark, path)
    return got.groupBy(
        F.col("`http.request.method`").alias("method"), F.col("`http.request.uri`").alias("uri"), F.col("`http.response.written`").alias("written"),
        F.replace(F.col("`http.request.remoteaddr`"), F.lit("10.0.0."), F.lit("client")).alias("client"),
    ).agg(F.count(F.lit(1)).alias("n"))


FILES = "(SELECT (p_partkey * 7 % 5000) AS size, min('layer/' || p_partkey) AS path, string_agg('layer/' || p_partkey, ',' ORDER BY 'layer/' || p_partkey) AS paths FROM part GROUP BY 1)"


def _files(spark, d):
    return T(spark, d, "part").select((F.col("p_partkey") * 7 % 5000).alias("size"), F.concat(F.lit("layer/"), "p_partkey").alias("path"))


MAPPED = "SELECT event_id, written, 'v2/layer/blobs/' || sha256(path) AS uri, 'layer' AS repo, sha256(path) AS sha FROM r JOIN " + FILES + " ON size = written WHERE method = 'GET' AND uri LIKE '%blobs%' AND written > 500"


@query(REQS + MAPPED)
def trace_rewrite_json(spark, d):
    """Mapped requests with the uri, repository and digest of their file, through a JSON sink."""
    got = trace.map_to_files(_reqs(spark, d), _files(spark, d), 500)
    sha = F.sha2("path", 256)
    rows = got.select("event_id", "written", F.concat(F.lit("v2/layer/blobs/"), sha).alias("uri"), F.split("path", "/")[0].alias("repo"), sha.alias("sha"))
    return tables.json_reload(rows, new_path(spark))


@query("SELECT size, paths FROM " + FILES)
def files_by_size(spark, d):
    n = _files(spark, d).groupBy("size").agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("paths"))
    return n


@query(HASHES + "SELECT vec_id, label, w0, w1 FROM h")
def hashes_csv_reload(spark, d):
    return tables.csv_reload(_hashes(spark, d), new_path(spark))


@query("SELECT min(vec_id) OVER (PARTITION BY label) AS head, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS pos, vec_id AS block_id FROM embeddings")
def cluster_log_reload(spark, d):
    path = new_path(spark)
    tables.write_cluster_log(T(spark, d, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("block_id")), path)
    return tables.read_cluster_log(spark, path)


@query("SELECT lang AS class, doc_id, sha256(text) AS digest FROM documents")
def materialise_classes(spark, d):
    path = new_path(spark)
    tables.write_by_class(_docs(spark, d).select(F.col("lang").alias("class"), "doc_id", "text"), path, "class")
    return spark.read.parquet(path).select("class", "doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS digest, sum(octet_length(encode(text)))::BIGINT AS size FROM conversations GROUP BY conv_id")
def concat_files(spark, d):
    rows = T(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["text"]), "")
    return rows.select("conv_id", F.sha2(whole, 256).alias("digest"), F.octet_length(whole).cast("long").alias("size"))


@query("SELECT doc_id, ((octet_length(encode(text)) + 511) // 512)::BIGINT AS chunks, sha256(encode(text)) AS digest FROM documents WHERE text <> ''")
def store_and_recipe(spark, d):
    path = new_path(spark)
    tables.write_store(dedup._pieces(_docs(spark, d), dedup.CHUNK, ("doc_id",)), path)
    parts = tables.read_store(spark, path).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.hex("data").alias("h")))).alias("p"))
    data = F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), ""))
    return parts.select("doc_id", F.size("p").cast("long").alias("chunks"), F.sha2(data, 256).alias("digest"))


@query(HASHES + "SELECT vec_id, label, w0, w1 FROM h")
def sorted_results(spark, d):
    return tables.sorted_table(_hashes(spark, d), new_path(spark), "vec_id")


@query("SELECT doc_id, sha256(unhex(substr(hex(encode(coalesce(text, ''))), (doc_id % 700) * 2 + 1, 200))) AS digest FROM documents")
def ranged_read(spark, d):
    data = F.coalesce("text", F.lit("")).cast("binary")
    return _docs(spark, d).select("doc_id", F.sha2(tables.read_range(data, F.col("doc_id") % 700, F.lit(100)), 256).alias("digest"))


WALK = """WITH u AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^?#]*[^/?#])', 1) AS p FROM pages), s AS (SELECT p, string_split(p, '/') AS x FROM u WHERE p <> ''),
e AS (SELECT array_to_string(x[1:i], '/') AS path, max(i < len(x)) AS dir FROM (SELECT x, unnest(range(1, len(x) + 1)) AS i FROM s) GROUP BY 1),
k AS (SELECT path, dir, CASE WHEN dir THEN string_split(path, '/') ELSE string_split(path, '/')[1:len(string_split(path, '/')) - 1] END AS f FROM e)
"""


@query(WALK + "SELECT path, CASE WHEN dir THEN 'dir' ELSE 'file' END AS kind FROM k WHERE NOT coalesce(list_bool_or([regexp_matches(z, '^m') FOR z IN f]), false)")
def walk_tree(spark, d):
    p = T(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^?#]*[^/?#])", 1).alias("path")).distinct()
    return tables.walk(p, "^m")


@query("SELECT doc_id, sha256(encode(coalesce(text, ''))) AS digest, true AS ok FROM documents")
def gunzip_payloads(spark, d):
    return archives.gunzip(archives.gzipped(archives.layers_of(_docs(spark, d)))).select(F.col("layer").alias("doc_id"), F.sha2("content", 256).alias("digest"), "ok")


@query("SELECT doc_id AS layer, octet_length(encode(coalesce(text, '')))::BIGINT AS size, true AS identical FROM documents")
def container_roundtrip(spark, d):
    """gzip members (with all optional fields in turn) and zlib streams as token containers, rebuilt bit for bit."""
    return archives.container_report(archives.layers_of(_docs(spark, d)))


@query("SELECT codec, doc_id, true AS identical FROM documents, (VALUES ('zlib'), ('lzma'), ('dictionary'), ('stream'), ('partial'), ('delta')) t(codec)")
def codec_roundtrips(spark, d):
    return codecs.round_trips(_docs(spark, d)).select("codec", "doc_id", "identical")


@query("SELECT doc_id, true AS combined FROM documents")
def checksums_combine(spark, d):
    """crc32 and adler32 of a payload equal those combined from its halves."""
    return codecs.checksums(_docs(spark, d)).select("doc_id", ((F.col("crc32") == F.col("crc32_halves")) & (F.col("adler32") == F.col("adler32_halves")) & (F.col("crc32") == F.col("crc32_sql"))).alias("combined"))


@query()
def xxh64_digests(spark, d):
    return codecs.xxh64(_docs(spark, d))


@query("SELECT s_nationkey AS k, substr(sha256(string_agg(s_name, '|' ORDER BY s_name)), 1, 16) AS digest FROM supplier GROUP BY 1")
def names_digest(spark, d):
    return T(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list("s_name")), "|"), 256), 1, 16).alias("digest"))


@query("SELECT doc_id, sha256(encode(coalesce(text, ''))) AS digest, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents")
def digest_of_files(spark, d):
    data = F.coalesce("text", F.lit("")).cast("binary")
    return _docs(spark, d).select("doc_id", F.sha2(data, 256).alias("digest"), F.octet_length(data).cast("long").alias("size"))


# Key-value records, descriptors --------------------------------------------------------------

KV = """WITH l AS (SELECT l_partkey % 500 AS p, l_orderkey * 10 + l_linenumber AS t, l_quantity AS q, l_suppkey AS s FROM lineitem)
"""


def _kv(spark, d) -> DataFrame:
    li = T(spark, d, "lineitem").select((F.col("l_partkey") % 500).alias("p"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.col("l_quantity").alias("q"), F.col("l_suppkey").alias("s"))
    value = F.to_json(F.struct(F.col("q").alias("Size"), F.col("s").alias("HostServerIp")))
    at = F.struct("at", "q", "s")
    return li.select(store.key("File", F.col("p").cast("string")).alias("key"), at.alias("at"), value.alias("value"))


@query(KV + "SELECT 'File::' || p AS key, arg_max(q, (t, q, s)) AS size, arg_max(s, (t, q, s)) AS host FROM l GROUP BY p")
def kv_set_get(spark, d):
    """The last value set for each key, decoded."""
    got = store.latest(_kv(spark, d)).withColumn("v", F.from_json("value", "Size double, HostServerIp long"))
    return got.select("key", F.col("v.Size").alias("size"), F.col("v.HostServerIp").alias("host"))


@query(KV + "SELECT 'File::' || p AS key, arg_min(q, (t, q, s)) AS size, count(*) AS tries FROM l GROUP BY p")
def kv_set_if_absent(spark, d):
    got = store.first(_kv(spark, d)).withColumn("v", F.from_json("value", "Size double"))
    return got.select("key", F.col("v.Size").alias("size"), "tries")


@query("""WITH k AS (SELECT 'Layer:Recipe::' || doc_id AS a, 'Slice:Recipe::' || doc_id || '::host' || (doc_id % 4) AS b, 'RLMap::' || source AS c, 'ULMap::' || lang AS e FROM documents),
u AS (SELECT a AS key FROM k UNION SELECT b FROM k UNION SELECT c FROM k UNION SELECT e FROM k) SELECT regexp_extract(key, '^(.*?)::', 1) AS family, count(*) AS keys FROM u GROUP BY 1""")
def kv_families(spark, d):
    docs = _docs(spark, d).select(F.explode(F.array(
        store.key("Layer:Recipe", F.col("doc_id").cast("string")), store.key("Slice:Recipe", F.col("doc_id").cast("string"), F.concat(F.lit("host"), F.col("doc_id") % 4)),
        store.key("RLMap", F.col("source")), store.key("ULMap", F.col("lang")),
    )).alias("key")).distinct()
    return docs.groupBy(store.family(F.col("key")).alias("family")).agg(F.count(F.lit(1)).alias("keys"))


DESCRIPTORS = """WITH b AS (SELECT DISTINCT sha256(text) AS digest, octet_length(encode(text))::BIGINT AS size FROM documents),
m AS (SELECT DISTINCT source AS repo, sha256(text) AS digest FROM documents), q AS (SELECT DISTINCT a.source AS repo, sha256(b.text) AS digest FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
"""


@query(DESCRIPTORS + "SELECT q.repo, q.digest, m.digest IS NOT NULL AS hit, CASE WHEN m.digest IS NOT NULL THEN b.size END AS size FROM q LEFT JOIN m ON m.repo = q.repo AND m.digest = q.digest LEFT JOIN b ON b.digest = q.digest")
def descriptor_cache(spark, d):
    """Stat through a cache: a repository sees a descriptor only if the blob is in its set."""
    docs = _docs(spark, d).withColumn("digest", F.sha2("text", 256))
    blobs = docs.select("digest", F.octet_length("text").cast("long").alias("size")).distinct()
    members = docs.select(F.col("source").alias("repo"), "digest").distinct()
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("digest").alias("wanted"))
    asked = docs.select("doc_id", F.col("source").alias("repo")).join(nxt, "doc_id").select("repo", F.col("wanted").alias("digest")).distinct()
    return store.stat(asked, members, blobs)


@query(DESCRIPTORS + "SELECT q.repo, count(*) AS lookups, count(m.digest) AS hits, count(*) - count(m.digest) AS misses FROM q LEFT JOIN m ON m.repo = q.repo AND m.digest = q.digest GROUP BY q.repo")
def cached_statter(spark, d):
    got = descriptor_cache(spark, d)
    hits = F.sum(F.col("hit").cast("long"))
    return got.groupBy("repo").agg(F.count(F.lit(1)).alias("lookups"), hits.alias("hits"), (F.count(F.lit(1)) - hits).alias("misses"))


@query("SELECT sha256(text) AS digest, octet_length(encode(any_value(text)))::BIGINT AS size, count(*) AS paths FROM documents WHERE text IS NOT NULL GROUP BY 1")
def blob_stat(spark, d):
    docs = _docs(spark, d).where("text IS NOT NULL")
    return docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min(F.octet_length("text")).cast("long").alias("size"), F.count(F.lit(1)).alias("paths"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE source <> 'src0' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 3)")
def vacuum(spark, d):
    """What stays after removing some blobs and one repository."""
    links = _docs(spark, d).select("doc_id", F.col("source").alias("repo"), F.sha2("text", 256).alias("digest"))
    gone = links.where("doc_id % 10 = 3").select("digest")
    return store.vacuum(links, gone, ["src0"]).select("doc_id", "digest")


@query("SELECT doc_id, sha256(text) AS digest, 'fetch' AS plan FROM documents WHERE doc_id % 3 = 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 <> 0)")
def lazy_population(spark, d):
    """Blobs that are asked for and absent here: to be fetched from the master."""
    rows = _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("digest"))
    have = rows.where("doc_id % 3 <> 0").select("digest")
    return rows.where("doc_id % 3 = 0").join(have, "digest", "left_anti").select("doc_id", "digest", F.lit("fetch").alias("plan"))


@query("SELECT doc_id, CASE WHEN contains(text, 'a') AND n_chars % 7 = 0 THEN 'move' WHEN n_chars = 0 THEN 'empty' ELSE 'dedup' END AS action FROM documents")
def dedup_marker(spark, d):
    """Layers with a marker are moved as they are, empty files are left out."""
    return _docs(spark, d).select("doc_id", store.dedup_action(F.col("text").contains("a") & (F.col("n_chars") % 7 == 0), F.col("n_chars")).alias("action"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'cache' WHEN doc_id % 3 = 0 THEN 'recipe' WHEN text IS NOT NULL THEN 'raw' END AS found_in FROM documents")
def restore_preference(spark, d):
    """Where a layer is served from: cache before recipe before raw blob."""
    docs = _docs(spark, d)
    names = docs.select(F.col("doc_id").alias("name"))
    at = lambda rows, what: rows.select(F.col("doc_id").alias("name"), F.lit(what).alias("target"))
    got = registry.resolve_links(names, at(docs.where("doc_id % 5 = 0"), "cache"), at(docs.where("doc_id % 3 = 0"), "recipe"), at(docs.where("text IS NOT NULL"), "raw"))
    return got.select(F.col("name").alias("doc_id"), F.col("target").alias("found_in"))


@query("SELECT sha256(text) AS digest, count(*) AS added, sum(CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS removed FROM documents GROUP BY 1 HAVING sum(CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END) = 0")
def digest_set_members(spark, d):
    """Digests added and not removed."""
    log = _docs(spark, d).select(F.sha2("text", 256).alias("digest"), F.when(F.col("doc_id") % 4 == 0, "remove").otherwise("add").alias("op"))
    return store.digest_set(log)


@query("SELECT doc_id, sha256(text) = CASE WHEN doc_id % 6 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS verified FROM documents WHERE text IS NOT NULL")
def digest_verification(spark, d):
    told = F.when(F.col("doc_id") % 6 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", ingest.verified(F.concat(F.lit("sha256:"), told), F.col("text")).alias("verified"))


@query("SELECT source AS repo, doc_id AS seq FROM documents WHERE octet_length(encode(text)) > 1.03 * n_chars")
def mode_always_raw(spark, d):
    layers = _docs(spark, d).select(F.col("source").alias("repo"), F.col("doc_id").alias("seq"), F.octet_length("text").alias("stored"), F.col("n_chars").alias("compressed"))
    return layers.where(F.col("stored") > 1.03 * F.col("compressed")).select("repo", "seq")


UPLOADS = """WITH p AS (SELECT l_orderkey AS upload, l_linenumber AS n, l_quantity::BIGINT AS size FROM lineitem),
s AS (SELECT upload, sum(size)::BIGINT AS size, count(*) AS patches, max(n) = count(*) AND min(n) = 1 AND count(DISTINCT n) = count(*) AS whole FROM p GROUP BY upload)
"""


@query(UPLOADS + "SELECT o_orderkey AS upload, coalesce(size, 0)::BIGINT AS size, coalesce(patches, 0)::BIGINT AS patches, CASE o_orderstatus WHEN 'F' THEN CASE WHEN coalesce(whole, false) THEN 'committed' ELSE 'invalid' END WHEN 'O' THEN 'cancelled' ELSE 'open' END AS state FROM orders LEFT JOIN s ON o_orderkey = upload")
def upload_sessions(spark, d):
    """Sessions from create, patch, commit and cancel records."""
    o = T(spark, d, "orders")
    end = F.when(F.col("o_orderstatus") == "F", "commit").when(F.col("o_orderstatus") == "O", "cancel")
    patches = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("upload"), F.lit("patch").alias("op"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("long").alias("size"))
    ops = o.select(F.col("o_orderkey").alias("upload"), F.lit("create").alias("op"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("size"))
    ends = o.where(end.isNotNull()).select(F.col("o_orderkey").alias("upload"), end.alias("op"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("size"))
    return store.uploads(ops.unionByName(patches).unionByName(ends))


@query("SELECT * FROM (VALUES ('cache.size', '64'), ('cache.policy', 'arc'), ('dedup.warmup', '200'), ('http.addr', ':5000')) t(key, value)")
def settings_table(spark, d):
    """Settings from text with one value overridden by the environment."""
    got = settings.load("cache:\n  size: 32\n  policy: arc\ndedup:\n  warmup: 200\nhttp:\n  addr: ':5000'\n", {"REGISTRY_CACHE_SIZE": "64"})
    return spark.createDataFrame(sorted(got.items()), "key string, value string")


# Placement -----------------------------------------------------------------------------------

RING = """WITH s AS (SELECT s_name AS server, ('0x' || substr(md5(s_name || '#' || i), 1, 8))::BIGINT AS pos, s_suppkey FROM supplier, range(0, 8) t(i)),
k AS (SELECT p_partkey AS key, ('0x' || substr(md5(p_partkey::VARCHAR), 1, 8))::BIGINT AS h FROM part),
a AS (SELECT key, coalesce(arg_min(server, pos) FILTER (WHERE pos >= h), arg_min(server, pos)) AS server FROM k, s GROUP BY key),
b AS (SELECT key, coalesce(arg_min(server, pos) FILTER (WHERE pos >= h), arg_min(server, pos)) AS server FROM k, (SELECT * FROM s WHERE s_suppkey % 10 <> 1) GROUP BY key)
"""


@query(RING + "SELECT a.key, a.server AS old, b.server AS new FROM a JOIN b ON a.key = b.key WHERE a.server <> b.server")
def rebalance_moves(spark, d):
    """Keys that move when some servers leave."""
    keys = T(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"))
    s = T(spark, d, "supplier")
    before, after = (placement.ring_placement(keys, x.select(F.col("s_name").alias("server"))) for x in (s, s.where("s_suppkey % 10 <> 1")))
    return placement.moved_keys(before, after).withColumn("key", F.col("key").cast("long"))


REPLICAS = """WITH s AS (SELECT s_name AS server, ('0x' || substr(md5(s_name || '#' || i), 1, 8))::BIGINT AS pos FROM supplier, range(0, 8) t(i)),
k AS (SELECT p_partkey AS key, c, ('0x' || substr(md5(p_partkey || '@' || c), 1, 8))::BIGINT AS h FROM part, range(0, 3) t(c)),
a AS (SELECT DISTINCT key, server FROM (SELECT key, c, coalesce(arg_min(server, pos) FILTER (WHERE pos >= h), arg_min(server, pos)) AS server FROM k, s GROUP BY key, c))
"""


@query(REPLICAS + "SELECT key, count(*) AS replicas, CASE WHEN bool_or(server = (SELECT min(s_name) FROM supplier)) THEN 'local' ELSE 'master' END AS route FROM a GROUP BY key")
def replica_routes(spark, d):
    """Replicas of each key, and whether one server finds it at home or fetches it from the master."""
    keys = T(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"))
    servers = T(spark, d, "supplier").select(F.col("s_name").alias("server"))
    here = servers.agg(F.min("server")).first()[0]
    return placement.routes(keys, servers, 3, here).withColumn("key", F.col("key").cast("long"))


@query("""WITH f AS (SELECT p_partkey % 50 AS layer, round(p_retailprice * 100)::BIGINT AS size FROM part), t AS (SELECT layer, count(*) AS n, sum(size)::BIGINT AS b FROM f GROUP BY layer)
SELECT layer, n AS files, b AS bytes, NOT (n > 5 AND b > 1000000) AS all_local FROM t""")
def lpt_local_rule(spark, d):
    files = T(spark, d, "part").select((F.col("p_partkey") % 50).alias("layer"), F.col("p_partkey").alias("file"), F.round(F.col("p_retailprice") * 100).cast("long").alias("size"))
    seeds = files.select("layer").distinct().select("layer", F.lit("server0").alias("server"), F.lit(1000).cast("long").alias("load"))
    got = placement.least_loaded(files, [f"server{i}" for i in range(5)], seeds=seeds, local="home", least_files=5, least_bytes=1_000_000)
    return got.groupBy("layer").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.min((F.col("server") == "home").cast("int")).cast("boolean").alias("all_local"))


@query(REQS + "SELECT uri, min(event_id) AS leader, count(*) AS waiters, epoch_us(ts) // 3600000000 AS slot FROM r GROUP BY uri, epoch_us(ts) // 3600000000")
def single_flight(spark, d):
    """One build for each key among the requests of a slot of time; the others wait for it."""
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)).cast("long")
    return _reqs(spark, d).groupBy("uri", slot.alias("slot")).agg(F.min("event_id").alias("leader"), F.count(F.lit(1)).alias("waiters"))


@query(REQS + ", x AS (SELECT event_id, user_id % 10 AS client, epoch_us(ts) AS t FROM r), y AS (SELECT *, min(t) OVER () AS t0, lag(t) OVER (PARTITION BY client ORDER BY t, event_id) AS p FROM x) SELECT event_id, client, t - coalesce(p, t0) AS wait_us FROM y")
def replay_pacing(spark, d):
    """How long each client waits before its next request."""
    return trace.pacing(_reqs(spark, d).withColumn("client", F.col("user_id") % 10))


@query("SELECT event_type, sum(CASE WHEN value >= 90 THEN 1 ELSE 0 END)::BIGINT AS pending, sum(CASE WHEN value < 50 THEN 1 ELSE 0 END)::BIGINT AS ok_200, sum(CASE WHEN value >= 50 AND value < 70 THEN 1 ELSE 0 END)::BIGINT AS accepted_202, sum(CASE WHEN value >= 70 AND value < 90 THEN 1 ELSE 0 END)::BIGINT AS errors_500 FROM events GROUP BY event_type")
def endpoint_status(spark, d):
    v = F.col("value")
    status = F.when(v < 50, 200).when(v < 70, 202).when(v < 90, 500)
    rows = T(spark, d, "events").select("event_type", status.alias("status"))
    count = lambda c: F.sum(c.cast("long"))
    s = F.col("status")
    return rows.groupBy("event_type").agg(
        count(s.isNull()).alias("pending"), count(s.eqNullSafe(200)).alias("ok_200"), count(s.eqNullSafe(202)).alias("accepted_202"), count(s.eqNullSafe(500)).alias("errors_500")
    )


@query("SELECT lang, count(*) AS n, count(DISTINCT text) AS n_unique, (SELECT sha256(text) FROM documents b WHERE b.lang = a.lang GROUP BY text ORDER BY count(*) DESC, sha256(text) LIMIT 1) AS top FROM documents a GROUP BY lang")
def describe_top(spark, d):
    n = _docs(spark, d).groupBy("lang", F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("c"))
    best = F.min(F.struct((-F.col("c")).alias("c"), "h"))["h"]
    return n.groupBy("lang").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_unique"), best.alias("top"))


@query(HASHES + """, q AS (SELECT vec_id, w0, w1 FROM h WHERE vec_id % 7 <> 3), z AS (SELECT a.vec_id AS q, b.vec_id AS vec_id, (bit_count(xor(a.w0, b.w0)) + bit_count(xor(a.w1, b.w1)))::INT AS dist FROM h a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT * FROM z WHERE dist <= 20""")
def index_operations(spark, d):
    """An index of hashes: inserted, partly removed, exported, imported, and searched within a radius."""
    h = _hashes(spark, d)
    index = similarity.HashIndex.create(spark, 20).insert(h.where("vec_id % 2 = 0")).insert(h.where("vec_id % 2 = 1"))
    path = new_path(spark)
    index.remove(h.where("vec_id % 7 = 3").select("vec_id")).export(path)
    return similarity.HashIndex.load(spark, path, 20).search(h.where("vec_id % 20 = 0"))
