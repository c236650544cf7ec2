"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its bytes.  The ledger
is a table with one row for each (blob, rule version) pair that has been
scanned and what was found; an update scans only pairs that it lacks, one copy
of each blob, and the findings are joined back to all paths (documents) that
hold the blob.  Copies are reduced map-side before the exchange by address, and
the ledger is met on the same partitioning, so a text travels once at most.

Updates only ever add files.  Two that run at once may both scan a blob; as a
scan depends on the blob and the rules alone their rows are equal, and reading
the ledger keeps one of them.

Edge cases: a null text is the empty blob, with no findings; repeated rows and
null ids each give a row; an empty table gives no rows; very long texts are
scanned whole, one at a time; of matches that start at one place the kind
listed first comes first; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.checkpoints import exists

RULE_VERSION = 1
KINDS = ("assign", "access", "hex", "github", "jwt", "pem")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
#: One of these is part of every match of ASSIGN, in lower case.
ASSIGN_WORDS = ("passw", "secret", "token", "api_key", "apikey")
#: A run that is too short is dropped whole, so the least length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
MORE = {
    "github": ("gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{20,}")),
    "jwt": ("eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*")),
    "pem": ("-----BEGIN", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
}
FINDINGS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place in KINDS, "kind:start:end") of every span, in that order."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m, 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m, 1) for m in ACCESS.finditer(text)]
    out += [(m, 2) for m in HEX.finditer(text)]
    for k, (mark, pattern) in enumerate(MORE.values(), 3):
        if mark in text:
            out += [(m, k) for m in pattern.finditer(text)]
    return sorted((m.start(), k, f"{KINDS[k]}:{m.start()}:{m.end()}") for m, k in out)


def digest(spans: list[tuple[int, int, str]]) -> tuple[int, int, int, str, str]:
    counts = [sum(k == j for _, k, _ in spans) for j in range(3)]
    base = ",".join(s for _, k, s in spans if k < 3)
    return (*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(s for _, _, s in spans))


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [digest(find(x.as_py().decode("utf-8", "replace"))) for x in b.column(1)]
        n = [[r[i] for r in rows] for i in range(5)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(v, pa.int64()) for v in n[:3]), *(pa.array(v, pa.string()) for v in n[3:])],
            ["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every path with the address of its blob."""
    data = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(data, 256)).alias("blob"))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """Ledger rows for the (blob, rule version) pairs that ``ledger`` lacks."""
    data = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blobs = docs.select(F.unhex(F.sha2(data, 256)).alias("blob"), data.alias("t"))
    one = blobs.groupBy("blob").agg(F.first("t").cast("binary").alias("data"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob")
        one = one.join(seen, "blob", "left_anti")
    return one.mapInArrow(_scan, f"blob binary, {FINDINGS}").withColumn("rule_version", F.lit(rule_version))


def attach(docs: DataFrame, ledger: DataFrame, rule_version: int = RULE_VERSION) -> DataFrame:
    """Findings of the ledger for every path."""
    found = ledger.where(F.col("rule_version") == rule_version).drop("rule_version")
    return paths(docs).join(found, "blob").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at ``path`` with one row a key; None if there is none yet."""
    if not exists(spark, path):
        return None
    return spark.read.schema(f"blob binary, {FINDINGS}, rule_version int").parquet(path).dropDuplicates(["blob", "rule_version"])


def update_ledger(docs: DataFrame, path: str, rule_version: int = RULE_VERSION) -> None:
    """Adds to the ledger at ``path`` what it lacks for these documents."""
    scan_unseen(docs, read_ledger(docs.sparkSession, path), rule_version).write.mode("append").parquet(path)


def secret_scan(docs: DataFrame, path: str) -> DataFrame:
    """Findings of every document by the ledger at ``path``, which is brought up to date first."""
    update_ledger(docs, path)
    return attach(docs, read_ledger(docs.sparkSession, path))
