"""Reference strings, blob paths and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_DOMAIN, DEFAULT_TAG, OFFICIAL = "docker.io", "latest", "library/"


def parse(ref: Column) -> dict[str, Column]:
    """domain, path, tag and digest of a reference, normalised.

    The part before the first slash is a domain if it has a dot or a colon or
    is localhost; without one the default domain holds, and there a path of
    one component is an official one.  Without tag and digest the tag is latest.
    """
    digest = F.regexp_extract(ref, r"@(.+)$", 1)
    name = F.regexp_replace(ref, r"@.+$", "")
    tag = F.regexp_extract(name, r":([\w][\w.-]{0,127})$", 1)
    bare = F.when(tag != "", F.regexp_replace(name, r":[\w][\w.-]{0,127}$", "")).otherwise(name)
    head = F.substring_index(bare, "/", 1)
    has = bare.contains("/") & (head.contains(".") | head.contains(":") | (head == "localhost"))
    rest = F.regexp_replace(bare, r"^[^/]*/", "")
    path = F.when(has, rest).otherwise(F.when(bare.contains("/"), bare).otherwise(F.concat(F.lit(OFFICIAL), bare)))
    return {
        "domain": F.when(has, head).otherwise(F.lit(DEFAULT_DOMAIN)),
        "path": path,
        "tag": F.when(tag != "", tag).when(digest == "", F.lit(DEFAULT_TAG)).otherwise(F.lit("")),
        "digest": digest,
    }


def sanitize(path: Column) -> Column:
    return F.regexp_replace(path, "[^a-zA-Z0-9/.-]+", "")


def blob_path(digest: Column) -> Column:
    """Where a blob's data lies: sharded by the first two digits."""
    hexed = F.regexp_replace(digest, "^sha256:", "")
    return F.concat(F.lit("/docker/registry/v2/blobs/sha256/"), F.substring(hexed, 1, 2), F.lit("/"), hexed, F.lit("/data"))


def layer_link_path(repo: Column, digest: Column) -> Column:
    return F.concat(
        F.lit("/docker/registry/v2/repositories/"), repo, F.lit("/_layers/sha256/"), F.regexp_replace(digest, "^sha256:", ""), F.lit("/link")
    )


def digest_of_path(path: Column) -> Column:
    """The 64 hex digits that stand as a component somewhere after ``blobs``; empty if none."""
    return F.regexp_extract(path, r"/blobs/(?:.*/)?([0-9a-f]{64})(?:/|$)", 1)


# Where a registry keeps its files.  {name}, {tag}, {id}, {alg}, {offset} and the digest's {hex} and {two} (its first two digits) are filled in.
ROOT = "/docker/registry/v2"
PATHS = {
    "manifest_revisions": ROOT + "/repositories/{name}/_manifests/revisions",
    "manifest_revision": ROOT + "/repositories/{name}/_manifests/revisions/sha256/{hex}",
    "manifest_revision_link": ROOT + "/repositories/{name}/_manifests/revisions/sha256/{hex}/link",
    "manifest_tags": ROOT + "/repositories/{name}/_manifests/tags",
    "manifest_tag": ROOT + "/repositories/{name}/_manifests/tags/{tag}",
    "manifest_tag_current": ROOT + "/repositories/{name}/_manifests/tags/{tag}/current/link",
    "manifest_tag_index": ROOT + "/repositories/{name}/_manifests/tags/{tag}/index",
    "manifest_tag_index_entry": ROOT + "/repositories/{name}/_manifests/tags/{tag}/index/sha256/{hex}",
    "manifest_tag_index_entry_link": ROOT + "/repositories/{name}/_manifests/tags/{tag}/index/sha256/{hex}/link",
    "layer_link": ROOT + "/repositories/{name}/_layers/sha256/{hex}/link",
    "blobs": ROOT + "/blobs",
    "blob": ROOT + "/blobs/sha256/{two}/{hex}",
    "blob_data": ROOT + "/blobs/sha256/{two}/{hex}/data",
    "upload_data": ROOT + "/repositories/{name}/_uploads/{id}/data",
    "upload_started_at": ROOT + "/repositories/{name}/_uploads/{id}/startedat",
    "upload_hash_state": ROOT + "/repositories/{name}/_uploads/{id}/hashstates/sha256/{offset}",
    "repositories_root": ROOT + "/repositories",
}


def path_for(kind: str, **fields: Column) -> Column:
    """The path of a kind, with its fields as columns; ``digest`` gives hex and two."""
    if "digest" in fields:
        hexed = F.regexp_replace(fields.pop("digest"), "^sha256:", "")
        fields |= {"hex": hexed, "two": F.substring(hexed, 1, 2)}
    parts, rest = [], PATHS[kind]
    while "{" in rest:
        fixed, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(fixed), fields[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def repository_of(path: Column) -> Column:
    """The repository whose layer folder a path lies in; null for other paths and for those below a folder that starts with ``_``."""
    name = F.regexp_extract(path, "^" + ROOT + "/repositories/(.+?)/_layers(?:/|$)", 1)
    return F.when((name != "") & ~name.rlike("(^|/)_"), name)


#: What a reference may look like: components of lower case and digits with single separators, a tag, a sha256 digest.
NAME = r"^(?:[a-zA-Z0-9.-]+(?::[0-9]+)?/)?[a-z0-9]+(?:(?:[._]|__|[-]*)[a-z0-9]+)*(?:/[a-z0-9]+(?:(?:[._]|__|[-]*)[a-z0-9]+)*)*"
REFERENCE = NAME + r"(?::[\w][\w.-]{0,127})?(?:@sha256:[0-9a-f]{64})?$"
LONGEST_NAME = 255


def reference_error(ref: Column) -> Column:
    """Why a reference is not valid: empty, uppercase, format or too long; null if it is."""
    name = F.regexp_replace(F.regexp_replace(ref, r"@.+$", ""), r":[\w][\w.-]{0,127}$", "")
    return (
        F.when(F.coalesce(ref, F.lit("")) == "", "empty")
        .when(F.length(name) > LONGEST_NAME, "too long")
        .when(~ref.rlike(REFERENCE) & F.lower(ref).rlike(REFERENCE), "uppercase")
        .when(~ref.rlike(REFERENCE), "format")
    )
