"""Reading document files and payloads; size and type checks."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import extension
from folioscope.functions.vocab import MAX_BYTES, TEXT_EXTENSIONS


def write_text_files(rows: DataFrame, root: str) -> None:
    """A file below ``root/group_id=<g>/`` for every row of text and group_id: the text, if any, and a line end.

    Spark's writer starts a process for each file's permissions, and one for its checksum file's, where Hadoop has no native
    library; on a folder of the local file system, tasks therefore write the files themselves.
    """
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(root)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.getUri().getScheme() != "file":
        # tasks move their own files into place; by default the driver would move every one of them, one after the other
        rows.write.partitionBy("group_id").option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(root)
        return
    folder = place.toUri().getPath()
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    names = {r[0]: escape("group_id", r[0]) for r in rows.select(F.col("group_id").cast("string")).distinct().collect()}
    store.mkdirs(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        for batch in batches:
            for group, text in zip(batch.column("group_id").to_pylist(), batch.column("text").to_pylist()):
                at = f"{folder}/{names[group]}"
                if not os.path.isdir(at):
                    os.makedirs(at, exist_ok=True)
                # a repeated task writes the same names with the same texts; other readers see whole files only
                part = f"part-{task.partitionId():05d}-{n:08d}.txt"
                new = f"{at}/.{part}.{task.taskAttemptId()}"
                with open(new, "wb") as f:
                    f.write((text or b"") + b"\n")
                os.replace(new, f"{at}/{part}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    # in the same order however often a task runs
    ordered = rows.select(F.col("group_id").cast("string").alias("group_id"), F.col("text").cast("binary").alias("text")).sortWithinPartitions("group_id", "text")
    ordered.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root/group_id=<g>/``: filename, group_id, n_bytes, content (bytes)."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(root)
        .select(F.element_at(F.split("path", "/"), -1).alias("filename"), "group_id",
                F.col("length").alias("n_bytes"), "content")
    )


def decode_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """``data:<mime>;base64,<x>`` text columns to bytes; a payload that does not decode gives null."""
    return df.withColumn("content", F.try_to_binary(F.split_part(payload, F.lit(","), F.lit(2)), F.lit("base64")))


def read_text_files(files: DataFrame, limit: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(texts, quarantine) from rows with filename and content bytes.

    A file is set aside with its reason when it has no content, is too large, has an unknown type or is
    not valid UTF-8; nothing raises.
    """
    text = F.try_validate_utf8(F.col("content").cast("string"))
    reason = (
        F.when(F.col("content").isNull(), "no content")
        .when(F.length("content") > limit, "too large")
        .when(~extension(F.col("filename")).isin(TEXT_EXTENSIONS), "unsupported type")
        .when(text.isNull(), "not utf-8")
    )
    marked = files.withColumn("reason", reason)
    good = marked.filter("reason is null").withColumn("text", text).drop("content", "reason")
    return good, marked.filter("reason is not null").drop("content")


def size_guard(docs: DataFrame, text: str = "text", limit: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by payload bytes."""
    sized = docs.withColumn("n_bytes", F.octet_length(text)).withColumn("accepted", F.col("n_bytes") <= limit)
    return sized.filter("accepted"), sized.filter("not accepted")
