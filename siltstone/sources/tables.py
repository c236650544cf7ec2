"""Files of traces, cluster logs, stores and recipes: written so that they can be read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a trace record; these names are fixed by the trace format.
TRACE = (
    "timestamp string, `http.request.method` string, `http.request.uri` string, `http.request.duration` double, "
    "`http.request.remoteaddr` string, `http.response.written` bigint"
)


def write_trace(records: DataFrame, path: str, per_line: int = 1000, order: str = "timestamp") -> None:
    """Records as JSON arrays of at most ``per_line`` records, one a line.

    Records are range-partitioned by time, so a file is a stretch of the trace.
    """
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns]))
    rows = records.repartitionByRange(order).sortWithinPartitions(order).select(body.alias("json"))
    rows.mapInArrow(_arrays(per_line), "value string").write.text(path)


def _arrays(per_line: int):
    import pyarrow as pa

    def run(batches):
        for b in batches:
            col = b.column(0).to_pylist()
            for at in range(0, len(col), per_line):
                yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(col[at : at + per_line]) + "]"])], ["value"])

    return run


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Every record of arrays that stand in a line each, so files split."""
    return spark.read.schema(TRACE).json(path)


def read_trace_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of files that are one JSON array each, over several lines."""
    return spark.read.schema(TRACE).option("multiLine", True).json(path)


def json_reload(df: DataFrame, path: str) -> DataFrame:
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def csv_reload(df: DataFrame, path: str) -> DataFrame:
    df.write.option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def write_cluster_log(members: DataFrame, path: str) -> None:
    """One line ``n id id …`` a cluster (cluster, block_id), members in order of id.

    A line holds a whole cluster by the format.
    """
    ids = F.sort_array(F.collect_list("block_id"))
    lines = members.groupBy("cluster").agg(F.concat_ws(" ", F.size(ids).cast("string"), F.transform(ids, lambda x: x.cast("string"))).alias("value"))
    lines.select("value").write.text(path)


def read_cluster_log(spark: SparkSession, path: str) -> DataFrame:
    """head (first member), pos and block_id of every member; a line whose count is wrong gives no rows."""
    parts = spark.read.text(path).select(F.split("value", " ").alias("p"))
    good = parts.where(F.size("p") - 1 == F.col("p")[0].cast("int"))
    return good.select(F.col("p")[1].cast("long").alias("head"), F.posexplode(F.slice("p", 2, 1 << 30)).alias("pos", "block_id")).select(
        "head", "pos", F.col("block_id").cast("long").alias("block_id")
    )


def write_by_class(rows: DataFrame, path: str, key: str) -> None:
    """A folder for each class; a class may spread over many files."""
    rows.write.partitionBy(key).parquet(path)


def write_store(pieces: DataFrame, path: str) -> None:
    """Two tables, ``store`` (hash, data) with each content once and ``recipe`` (doc_id, ordinal, hash), from doc_id, ordinal, piece."""
    rows = pieces.withColumn("hash", F.sha2("piece", 256))
    rows.groupBy("hash").agg(F.first("piece").alias("data")).write.parquet(f"{path}/store")
    rows.select("doc_id", "ordinal", "hash").write.parquet(f"{path}/recipe")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ordinal and data of every recipe entry."""
    return spark.read.parquet(f"{path}/recipe").join(spark.read.parquet(f"{path}/store"), "hash").select("doc_id", "ordinal", "data")


def sorted_table(df: DataFrame, path: str, *order: str) -> DataFrame:
    """The rows range-partitioned and sorted within files, written and read back."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_range(data: Column, offset: Column, length: Column) -> Column:
    """``length`` bytes from ``offset``; past the end nothing, a negative offset counts as 0."""
    return F.substring(data, F.greatest(offset, F.lit(0)).cast("int") + 1, F.greatest(length, F.lit(0)).cast("int"))


def walk(paths: DataFrame, skip: str) -> DataFrame:
    """Every folder and file of a tree (column path) but for what lies in folders whose name matches ``skip``.

    Rows: path, kind (dir, file).  Sort by ``operators.registry.path_key`` for the order of a walk.
    """
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), (i < F.size(parts)).alias("dir")))
    every = paths.where(F.col("path") != "").select(F.explode(ends).alias("e")).groupBy("e.path").agg(F.max("e.dir").alias("dir"))
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - F.when(F.col("dir"), 0).otherwise(1))
    return every.where(~F.exists(folders, lambda x: x.rlike(skip))).select("path", F.when(F.col("dir"), "dir").otherwise("file").alias("kind"))
