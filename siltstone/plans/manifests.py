"""Queries over manifests, paths, references and descriptors as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import references
from siltstone.operators import manifests, registry
from siltstone.plans.catalogue import _docs, _reqs, _urls
from siltstone.plans.register import T, query

URL = "WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS u, sha256(url) AS h FROM pages)\n"
_FIELDS = {"name": "u", "tag": "'v' || page_id", "hex": "h", "two": "substr(h, 1, 2)", "id": "page_id::VARCHAR", "offset": "(page_id % 9)::VARCHAR"}


def _path_sql() -> str:
    parts = []
    for kind, template in references.PATHS.items():
        text = "'" + template + "'"
        for name, value in _FIELDS.items():
            text = text.replace("{" + name + "}", f"' || {value} || '")
        parts.append(f"SELECT page_id, '{kind}' AS kind, {text} AS path FROM u")
    return URL + " UNION ALL ".join(parts)


@query(_path_sql())
def path_templates(spark, d):
    rows = _urls(spark, d)
    given = {"name": F.col("u"), "tag": F.concat(F.lit("v"), "page_id"), "digest": F.concat(F.lit("sha256:"), F.sha2("url", 256)), "id": F.col("page_id"), "offset": F.col("page_id") % 9}
    each = [F.struct(F.lit(k).alias("kind"), references.path_for(k, **given).alias("path")) for k in references.PATHS]
    return rows.select("page_id", F.explode(F.array(*each)).alias("p")).select("page_id", "p.*")


@query(URL + "SELECT DISTINCT u AS repo FROM u WHERE u <> '' AND page_id % 3 <> 0 AND NOT regexp_matches(u, '(^|/)_')")
def repository_enumeration(spark, d):
    """Repositories found by their layer folders among all paths of a store."""
    rows = _urls(spark, d)
    digest = F.concat(F.lit("sha256:"), F.sha2("url", 256))
    path = F.when(F.col("page_id") % 3 == 0, references.path_for("upload_data", name=F.col("u"), id=F.col("page_id"))).otherwise(references.path_for("layer_link", name=F.col("u"), digest=digest))
    return rows.select(references.repository_of(path).alias("repo")).where("repo IS NOT NULL").distinct()


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'uppercase' WHEN 1 THEN 'empty' WHEN 2 THEN 'format' WHEN 3 THEN 'too long' END AS error FROM pages""")
def reference_errors(spark, d):
    p, base = F.col("page_id") % 5, F.concat(F.lit("repo"), "page_id")
    ref = F.when(p == 0, F.concat(F.lit("lib/Up"), base)).when(p == 1, "").when(p == 2, F.concat(base, F.lit("//x"))).when(p == 3, F.repeat(base, 300)).otherwise(F.concat(F.lit("example.org:5000/a/"), base, F.lit(":v1")))
    return T(spark, d, "pages").select("page_id", references.reference_error(ref).alias("error"))


@query("SELECT doc_id, sha256(text) AS digest, 'layer/' || doc_id AS file_path, 'host' || (doc_id % 4) AS host, n_chars AS size FROM documents")
def descriptor_json(spark, d):
    """File descriptors encoded as JSON and decoded."""
    docs = _docs(spark, d)
    value = F.to_json(F.struct(
        F.sha2("text", 256).alias("Digest"), F.concat(F.lit("layer/"), "doc_id").alias("FilePath"), F.concat(F.lit("host"), F.col("doc_id") % 4).alias("HostServerIp"), F.col("n_chars").alias("Size"),
    ))
    back = F.from_json(value, "Digest string, FilePath string, HostServerIp string, Size long")
    return docs.select("doc_id", back.alias("v")).select("doc_id", F.col("v.Digest").alias("digest"), F.col("v.FilePath").alias("file_path"), F.col("v.HostServerIp").alias("host"), F.col("v.Size").alias("size"))


@query("WITH r AS (SELECT event_id, 'v2/repo' || (user_id % 10) || '/' || CASE WHEN event_type = 'error' THEN 'manifests' ELSE 'blobs' END || '/' || regexp_extract(props, '\"k\": ([0-9]+)', 1) AS uri FROM events) SELECT event_id, replace(uri, '/blobs/', '/layers/') AS uri, regexp_extract(uri, '[^/]*$') AS last, substr('x/' || sha256(uri) || '/data.gz', length('x/' || sha256(uri) || '/data.gz') - 71, 64) AS slice FROM r")
def uri_rewrite(spark, d):
    uri = F.col("uri")
    file = F.concat(F.lit("x/"), F.sha2(uri, 256), F.lit("/data.gz"))
    return _reqs(spark, d).select("event_id", F.replace(uri, F.lit("/blobs/"), F.lit("/layers/")).alias("uri"), F.substring_index(uri, "/", -1).alias("last"), F.substring(file, F.length(file) - 71, F.lit(64)).alias("slice"))


# Manifests: conversations are images whose turns are layers; every seventh has a list above it.

IMAGES = """WITH c AS (SELECT conv_id, turn, 'sha256:' || sha256(text) AS layer, octet_length(encode(text)) AS size FROM conversations),
i AS (SELECT conv_id, 'sha256:' || sha256('image' || conv_id) AS digest, 'sha256:' || sha256('config' || conv_id) AS config, 'sha256:' || sha256('list' || conv_id) AS list FROM (SELECT DISTINCT conv_id FROM conversations))
"""


def _images(spark, d) -> DataFrame:
    """Manifests (digest, content_type, body) of schema 2, of schema 1 for every third, and lists."""
    hashed = lambda what: F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(what), F.col("conv_id").cast("string")), 256))
    c = T(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("layer"), F.octet_length("text").cast("long").alias("size"))
    rows = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "layer", "size"))).alias("l"))
    layers = F.transform("l", lambda x: F.struct(F.lit("layer").alias("mediaType"), x["size"].alias("size"), x["layer"].alias("digest")))
    new = F.to_json(F.struct(F.lit(2).alias("schemaVersion"), F.lit(manifests.SCHEMA2).alias("mediaType"), F.struct(F.lit("config").alias("mediaType"), F.lit(1).alias("size"), hashed("config").alias("digest")).alias("config"), layers.alias("layers")))
    old = F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.transform(F.reverse("l"), lambda x: F.struct(x["layer"].alias("blobSum"))).alias("fsLayers")))
    third = F.col("conv_id") % 3 == 0
    images = rows.select(hashed("image").alias("digest"), F.when(third, manifests.SCHEMA1).otherwise(F.lit(manifests.SCHEMA2 + "; charset=utf-8")).alias("content_type"), F.when(third, old).otherwise(new).alias("body"))
    above = F.to_json(F.struct(F.lit(2).alias("schemaVersion"), F.lit(manifests.LIST).alias("mediaType"), F.array(F.struct(F.lit(manifests.SCHEMA2).alias("mediaType"), F.lit(1).cast("long").alias("size"), hashed("image").alias("digest"))).alias("manifests")))
    lists = rows.where("conv_id % 7 = 0").select(hashed("list").alias("digest"), F.lit(manifests.LIST).alias("content_type"), above.alias("body"))
    return images.unionByName(lists)


REFS = IMAGES + """, r AS (SELECT i.digest, CASE WHEN i.conv_id % 3 = 0 THEN 'schema1' ELSE 'schema2' END AS form, c.layer AS target,
  (CASE WHEN i.conv_id % 3 = 0 THEN row_number() OVER (PARTITION BY i.conv_id ORDER BY turn DESC, layer DESC, size DESC) ELSE row_number() OVER (PARTITION BY i.conv_id ORDER BY turn, layer, size) END - 1)::INT AS ordinal FROM i JOIN c ON i.conv_id = c.conv_id
UNION ALL SELECT digest, 'schema2', config, -1 FROM i WHERE conv_id % 3 <> 0 UNION ALL SELECT list, 'list', digest, 0 FROM i WHERE conv_id % 7 = 0)
"""


@query(REFS + "SELECT digest, form, ordinal, target FROM r")
def manifest_references(spark, d):
    """References of stored manifests, parsed by their media type."""
    form = F.when(F.col("media_type") == manifests.SCHEMA1, "schema1").when(F.col("media_type") == manifests.SCHEMA2, "schema2").otherwise("list")
    return manifests.references(_images(spark, d)).select("digest", form.alias("form"), "ordinal", "target")


@query(IMAGES + "SELECT digest, conv_id % 5 <> 0 AS \"exists\" FROM i")
def manifest_exists(spark, d):
    """Which of the known manifests a store still holds after some were deleted."""
    hashed = F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("image"), F.col("conv_id").cast("string")), 256))
    ids = T(spark, d, "conversations").select("conv_id").distinct()
    deleted = ids.where("conv_id % 5 = 0").select(hashed.alias("digest"))
    held = registry.sweep(_images(spark, d).select("digest"), deleted).withColumn("there", F.lit(True))
    return ids.select(hashed.alias("digest")).join(held, "digest", "left").select("digest", F.coalesce("there", F.lit(False)).alias("exists"))


@query(REFS + """, roots AS (SELECT list AS digest FROM i WHERE conv_id % 7 = 0), m AS (SELECT i.digest FROM i JOIN roots ON i.list = roots.digest),
live AS (SELECT digest FROM roots UNION SELECT digest FROM m UNION SELECT target FROM r WHERE digest IN (SELECT digest FROM m)),
b AS (SELECT target AS digest FROM r UNION SELECT digest FROM i UNION SELECT list FROM i WHERE conv_id % 7 = 0) SELECT digest FROM b WHERE digest NOT IN (SELECT digest FROM live)""")
def gc_through_lists(spark, d):
    """Blobs and manifests that no manifest list reaches, through any depth."""
    from siltstone.sources.checkpoints import table

    images = _images(spark, d)
    refs, _ = table(manifests.references(images).select("digest", "target"))
    roots = images.where(F.col("content_type") == manifests.LIST).select("digest")
    every = refs.select(F.col("target").alias("digest")).union(images.select("digest")).distinct()
    return registry.sweep(every, manifests.reachable(roots, refs))


SCHEMA1 = """WITH RECURSIVE h AS (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag = 'N', sha256(l_partkey::VARCHAR)) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, l_returnflag = 'N' AS empty, 'sha256:' || sha256(l_partkey::VARCHAR) AS layer FROM lineitem),
s AS (SELECT image, i, n, CASE WHEN empty THEN 'sha256:a3ed95caeb02ffe68cdd9fd84406680ae93d633cb16422d00e8a7c22955b46d4' ELSE layer END AS blob_sum FROM h),
c AS (SELECT image, i, n, blob_sum, sha256(substr(blob_sum, 8) || ' ') AS id FROM s WHERE i = 1 UNION ALL SELECT s.image, s.i, s.n, s.blob_sum, sha256(substr(s.blob_sum, 8) || ' ' || c.id) FROM s JOIN c ON s.image = c.image AND s.i = c.i + 1)
"""


@query(SCHEMA1 + "SELECT image, (n - i)::INT AS position, blob_sum, id FROM c")
def manifest_to_schema1(spark, d):
    """Images (orders; lines are history, some without content) in the older form."""
    li = T(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", (F.col("l_returnflag") == "N").alias("empty"), F.concat(F.lit("sha256:"), F.sha2(F.col("l_partkey").cast("string"), 256)).alias("layer")).alias("e"))
    rows = li.groupBy(F.col("l_orderkey").alias("image")).agg(F.sort_array(F.collect_list("e")).alias("e"))
    images = rows.select("image", F.transform("e", lambda x: x["empty"]).alias("history"), F.transform(F.filter("e", lambda x: ~x["empty"]), lambda x: x["layer"]).alias("layers"))
    return manifests.to_schema1(images)


def _tag_log(spark, d):
    return T(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("repo"), F.col("o_orderpriority").alias("tag"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("digest"), (F.col("o_orderstatus") == "P").alias("untag"),
    )


@query("""WITH t AS (SELECT o_custkey::VARCHAR AS repo, o_orderpriority AS tag, o_orderdate AS put, o_orderkey AS digest, o_orderstatus = 'P' AS untag FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY repo, tag ORDER BY put DESC, digest DESC) AS k, count(*) FILTER (WHERE NOT untag) OVER (PARTITION BY repo, tag) AS versions FROM t)
SELECT repo, tag, digest, versions FROM l WHERE k = 1 AND NOT untag""")
def tag_history(spark, d):
    """Current digest of each tag that was not removed last, and how many versions its index holds."""
    last = F.max(F.struct("at", "digest", "untag")).alias("l")
    got = _tag_log(spark, d).groupBy("repo", "tag").agg(last, F.count(F.when(~F.col("untag"), 1)).alias("versions"))
    return got.where("NOT l.untag").select("repo", "tag", F.col("l.digest").alias("digest"), "versions")
