"""A chunk index that a stream of documents keeps up to date, one whole document at a time.

``data/bucket=b/version=n`` holds the chunks of the documents of a bucket as commit n left them; ``manifest/commit=n`` names the
version of every bucket that commit n reads. A commit writes new versions of the buckets that it changes and then its manifest,
which is what readers look at: a batch that dies on the way leaves nothing behind that is read, its rerun writes the same folders
again, and a batch that is already in the manifest's log is not applied twice.

A document is left alone while the index holds it with the same content; a changed one loses all its old chunks; one that
comes without a text, or marked as deleted, is removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.chunking import chunk_id, window_chunks
from folioscope.session import cut_lineage

BUCKETS = 64
MANIFEST = "bucket int, version bigint, source string, epoch bigint"
#: The manifest row that is there even when the index is empty.
NO_BUCKET = -1


def window_rows(docs: DataFrame) -> DataFrame:
    """The chunks of documents: 500-character windows with their ids."""
    return window_chunks(docs).withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("chunk_text")))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{MANIFEST}, commit bigint").parquet(f"{path}/manifest")


def _write_manifest(rows: DataFrame, path: str, commit: int) -> None:
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/commit={commit}")  # a row a bucket


def read_index(spark: SparkSession, path: str, commit: int | None = None) -> DataFrame | None:
    """The chunk rows, with content_hash, as the last commit (or the given one) left them; None before the first chunk."""
    if not _exists(spark, f"{path}/data"):
        return None
    known = _manifests(spark, path)
    last = known.agg(F.max("commit")).first()[0] if commit is None else commit
    current = known.filter((F.col("commit") == last) & (F.col("bucket") != NO_BUCKET)).select("bucket", "version")
    if current.isEmpty():
        return None
    rows = spark.read.option("mergeSchema", "false").parquet(f"{path}/data")
    return rows.join(F.broadcast(current), ["bucket", "version"]).drop("bucket", "version")  # a row a bucket; prunes folders


def apply_documents(docs: DataFrame, path: str, source: str, epoch: int, build: Callable[[DataFrame], DataFrame] = window_rows,
                    order: str | None = None) -> bool:
    """Brings the index up to date with ``docs`` (doc_id, text, other columns); False if this batch has been applied before.

    ``source`` names the stream and ``epoch`` its batch. Of several rows of one document the one with the greatest ``order``
    counts (ties: the greatest text); without ``order`` a document comes once in a batch. ``deleted``, if there, marks removals.
    """
    spark = docs.sparkSession
    if not _exists(spark, f"{path}/manifest"):
        _write_manifest(spark.createDataFrame([(NO_BUCKET, 0, None, None)], MANIFEST), path, 0)
    known = _manifests(spark, path)
    this = (F.col("source") == source) & (F.col("epoch") == epoch)
    last, done = known.agg(F.max("commit"), F.count(F.when(this, 1))).first()
    if done:
        return False
    commit = last + 1
    gone = F.col("text").isNull() if "deleted" not in docs.columns else F.col("text").isNull() | F.coalesce("deleted", F.lit(False))
    rows = docs.withColumns({"_gone": gone, "content_hash": F.sha2(F.concat_ws("\n", *(c for c in docs.columns if c not in ("doc_id", "deleted", order))), 256),
                             "bucket": F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")})
    if order is not None:
        rest = [c for c in rows.columns if c != "doc_id"]
        newest = rows.groupBy("doc_id").agg(F.max_by(F.struct(*rest), F.struct(order, "text")).alias("r"))
        rows = newest.select("doc_id", *(F.col(f"r.{c}").alias(c) for c in rest))
    rows = cut_lineage(rows)

    def same(a: str, b: str, *columns: str):
        return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]

    old = read_index(spark, path, last)
    if old is not None:
        old = old.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
        held = old.select("doc_id", "content_hash").distinct()
        kept = rows.filter("not _gone").alias("r").join(held.alias("h"), same("r", "h", "doc_id", "content_hash"), "left_semi")
        changed = cut_lineage(rows.alias("r").join(kept.select("doc_id").alias("k"), same("r", "k", "doc_id"), "left_anti"))
    else:
        changed = rows.filter("not _gone")
    touched = cut_lineage(changed.select("bucket").distinct())
    fresh = build(changed.filter("not _gone").drop("_gone", "bucket", "deleted")).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
    if old is not None:
        stay = old.join(F.broadcast(touched), "bucket", "left_semi")  # at most a row a bucket
        stay = stay.alias("o").join(changed.select("doc_id").alias("c"), same("o", "c", "doc_id"), "left_anti")
        fresh = fresh.unionByName(stay.select(*fresh.columns))
    fresh = fresh.withColumn("version", F.lit(commit).cast("bigint"))
    # Dealt by bucket; Spark splits a large bucket over tasks and joins small ones.
    (fresh.hint("rebalance", "bucket").sortWithinPartitions("bucket", "doc_id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(f"{path}/data"))
    before = known.filter(F.col("commit") == last).select("bucket", "version").join(touched, "bucket", "left_anti")
    now = before.unionByName(touched.withColumn("version", F.lit(commit).cast("bigint")))
    _write_manifest(now.withColumns({"source": F.lit(source), "epoch": F.lit(epoch).cast("bigint")}), path, commit)
    return True


def ingest(stream: DataFrame, path: str, source: str = "documents", build: Callable[[DataFrame], DataFrame] = window_rows,
           order: str | None = None) -> None:
    """Applies every micro-batch of a stream of documents that is there now. The checkpoint of ``source`` lies beside the index."""
    def write(batch: DataFrame, epoch: int) -> None:
        apply_documents(batch, path, source, epoch, build, order)

    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state/{source}")
             .trigger(availableNow=True).start())
    query.awaitTermination()
