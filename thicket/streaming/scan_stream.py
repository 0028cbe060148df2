"""Scanning files as they arrive, and counting findings over time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..operators import rules as rl
from ..sources import frontends
from ..sources.rules import Rule


def read_stream(spark: SparkSession, folder: str, glob: str = "*", max_files: int = 1000) -> DataFrame:
    """file_id, path, language, content, seen_at of the files that appear in a folder."""
    raw = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True)
    raw = raw.schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return raw.select(F.xxhash64("path").alias("file_id"), "path", schema.language_of_path(F.col("path")).alias("language"), F.decode("content", "utf-8").alias("content"), F.col("modificationTime").alias("seen_at"))


def scan_stream(files: DataFrame, rules: Iterable[Rule], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write the findings of each new file to `out` (Parquet). A file's scan needs no other file, so every
    micro-batch is scanned with the plan for tables, including rules with relations."""
    rules = list(rules)

    def batch(df: DataFrame, _number: int) -> None:
        df = df.persist()
        nodes = frontends.parse(df)
        found = rl.scan(nodes, rules, df.select("file_id", "path"))
        found.join(df.select("file_id", "path", "seen_at"), "file_id").write.mode("append").parquet(out)
        df.unpersist()

    w = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def counts_over_time(findings: DataFrame, time: str, window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Findings per rule and window of event time; later rows than the watermark allows are left out."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    counts = findings.withWatermark(time, late).groupBy(w.alias("w"), "rule_id").agg(F.count(F.lit(1)).alias("n_findings"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "rule_id", "n_findings")


def sessions(findings: DataFrame, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Findings per file and session: rows of a file less than `gap` apart belong together."""
    w = F.session_window(time, gap)
    out = findings.withWatermark(time, late).groupBy(w.alias("w"), "file_path").agg(F.count(F.lit(1)).alias("n_findings"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "file_path", "n_findings")


LATEST = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("n_scans", T.LongType()), T.StructField("last_matches", T.LongType())])


def latest_state(scans: DataFrame) -> DataFrame:
    """file_id, n_scans, last_matches: the running state of each file over a stream of scans (file_id, scanned_at, n_matches)."""
    import pandas as pd

    def update(key, batches, state):
        n, at, matches = state.get if state.exists else (0, 0, 0)
        for b in batches:
            for t, m in zip(b["at"], b["n_matches"]):
                n += 1
                if t >= at:
                    at, matches = int(t), int(m)
        state.update((n, at, matches))
        yield pd.DataFrame({"file_id": [key[0]], "n_scans": [n], "last_matches": [matches]})

    rows = scans.select("file_id", F.unix_micros(F.col("scanned_at").cast("timestamp")).alias("at"), F.col("n_matches").cast("bigint").alias("n_matches")).where("at is not null and n_matches is not null")
    return rows.groupBy("file_id").applyInPandasWithState(update, LATEST, "n bigint, at bigint, matches bigint", "update", "NoTimeout")
