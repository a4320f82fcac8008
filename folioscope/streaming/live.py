"""Stream-shaped behaviour without timers: reading and last use. Sources are folders of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, folder: str, name: str, per_batch: int | None = None) -> DataFrame:
    """Stream over the files of ``folder`` that match ``name``, with the schema of those there now; oldest files first.

    A match can be a file or a folder of files, as tables of any size are.
    """
    named = f"{folder}/{{{name}}}"  # a pattern, also for a plain name: a stream takes a path without one for a folder
    reader = spark.readStream.schema(spark.read.parquet(named).schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(named)


def last_used(events: DataFrame) -> DataFrame:
    """document, last_used — for update mode. ``events``: ts, document."""
    return events.groupBy("document").agg(F.max("ts").alias("last_used"))


def drain_batches(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Writes every micro-batch to its own folder, replaced when the batch is run again."""
    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/out")
