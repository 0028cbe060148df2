"""Parsed files kept as a table, so that a corpus is parsed once and scanned many times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frontends


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", F.sha2(F.col("content"), 256))


def exists(files: DataFrame, folder: str) -> bool:
    jvm = files.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(files.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(path)


def update(files: DataFrame, folder: str, **options) -> int:
    """Parse the files (file_id, path, language, content) that the store lacks and append their nodes.

    A file is known by path and content; one that changed is parsed again, and its old nodes stay until
    `compact`. Returns the number of files parsed.
    """
    todo = with_hash(files.where("content <> ''"))
    if exists(files, folder):
        have = files.sparkSession.read.parquet(folder).where("node_id = 0").select("path", "content_hash")
        todo = todo.join(have, ["path", "content_hash"], "left_anti")
    todo = todo.persist()
    n = todo.count()
    if n:
        keys = todo.select("file_id", "path", "content_hash")
        frontends.parse(todo, **options).join(keys, "file_id").write.mode("append").parquet(folder)
    todo.unpersist()
    return n


def load(files: DataFrame, folder: str) -> DataFrame:
    """Nodes of the files' present contents."""
    keys = with_hash(files).select("path", "content_hash")
    return files.sparkSession.read.parquet(folder).join(keys, ["path", "content_hash"], "left_semi").drop("path", "content_hash")


def compact(files: DataFrame, folder: str, to: str) -> None:
    """Write the nodes of the files' present contents to a new folder."""
    keys = with_hash(files).select("path", "content_hash")
    files.sparkSession.read.parquet(folder).join(keys, ["path", "content_hash"], "left_semi").write.mode("overwrite").parquet(to)
