"""Session helpers shared by every operator: reading tables, shipping code, cutting lineage."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Bytes of one Arrow batch between the JVM and a Python worker, where the session doesn't say.
BATCH_BYTES = 4 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver imports it, and bound what they hold.

    The bound is in bytes and the same for every operator, so neither long texts nor the order in
    which plans are built matter; a session that sets its own keeps it.
    """
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *have])
    if spark.conf.get(BATCH_KEY).rstrip("Bb") == str(64 << 20):  # Spark's default
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the reliable checkpoint folder of the session and forget its lineage.

    The folder is the one the cluster names in spark.checkpoint.dir. A folder of our own is made only
    where that is unset and the master is local (tests, one machine); on a cluster its absence is an
    error, as executors would each write to a disk that is lost with them. Files go when their table
    is no longer referenced if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master or "").split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="thicket-checkpoints-"))
    return df.checkpoint(eager=True)
