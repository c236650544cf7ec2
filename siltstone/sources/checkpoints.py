"""Written tables in the folder that the cluster shares: they cut lineage and are deleted in the end."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: list[str] = []
_released = 0.0


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset on a local master (tests), a temporary folder of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="siltstone"))
    return f"file://{_own[0]}"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession) -> str:
    """A fresh path in the folder; whatever is there when the application ends is deleted."""
    path = f"{folder(spark).rstrip('/')}/siltstone-{uuid.uuid4().hex}"
    fs, at = _path(spark, path)
    fs.deleteOnExit(at)
    _made.append(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def table(df: DataFrame, free: bool = True) -> tuple[DataFrame, str]:
    """The frame as a written table, and its path: later reads need none of the lineage.

    With ``free``, shuffle files that nothing refers to any more may go, unless some went within the last second.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    if free and time.monotonic() - _released > 1:
        release(spark)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of frames that are no longer referenced."""
    global _released
    gc.collect()
    spark._jvm.System.gc()
    _released = time.monotonic()


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any more."""
    for p in paths:
        fs, at = _path(spark, p)
        fs.delete(at, True)
        if p in _made:
            _made.remove(p)


def mark() -> int:
    """A place in the list of tables, for ``drop_since``."""
    return len(_made)


def drop_since(spark: SparkSession, place: int, *keep: str) -> None:
    """Deletes the tables made since ``place`` but for those in ``keep``."""
    drop(spark, *[p for p in _made[place:] if p not in keep])

