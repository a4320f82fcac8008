"""Session set-up, lineage cuts and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(cores: str | int = "*", app: str = "folioscope", **extra: str) -> SparkSession:
    """Local session for tests and benchmarks; clusters bring their own."""
    n = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    A local session without the setting gets a fresh temporary folder. On a cluster
    a missing setting is an error: a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="folioscope-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read back.

    Plans that read a result several times, or in rounds, stay short and survive lost executors. Unlike a
    checkpoint this computes the rows once and keeps column pruning and size statistics for later joins.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partitions by ``key`` when the scan has fewer splits than the cluster has cores.

    Heavy map-only work on a few unsplit files would otherwise run in a few tasks; a scan with enough
    splits is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


#: Text bytes that one task opens up into term rows, which take some ten times as much memory.
PART_BYTES = 8 << 20


def part_count(df: DataFrame, text: str) -> int:
    """How many parts hold about ``PART_BYTES`` of a text column each; reads the column once."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def dealt(df: DataFrame, key: str, text: str) -> DataFrame:
    """Hash-partitioned by ``key`` into parts of bounded text, for counting terms: more text makes more parts, not larger ones."""
    return df.repartition(part_count(df, text), key)
