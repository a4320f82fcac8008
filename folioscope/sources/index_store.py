"""Persisted chunk index, feedback and graph tables."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import cut_lineage


def write_index(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by group, sorted by document inside the files so that a document's rows are read together.

    Ranges of (group, document) are cut by sampling, so that a large group is written by as many tasks as its
    share of the rows asks for; only the groups present in ``chunks`` are replaced.
    """
    (
        chunks.repartitionByRange("group_id", "doc_id").sortWithinPartitions("group_id", "doc_id")
        .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("group_id").parquet(path)
    )


def export_json(chunks: DataFrame, path: str) -> None:
    """Chunk records as JSON lines with ISO timestamps."""
    chunks.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def upsert_chunks(old: DataFrame, new: DataFrame, key: str = "chunk_id", version: str = "version") -> DataFrame:
    """The row with the highest version per key; combined per task before the shuffle."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in (key, version)]
    last = both.groupBy(key).agg(F.max_by(F.struct(version, *rest), version).alias("r"))
    return last.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in both.columns])


def without_documents(table: DataFrame, deletes: DataFrame) -> DataFrame:
    """Rows whose (group_id, filename) is not in the delete list; nulls are values like any other."""
    t, d = table.alias("t"), deletes.select("group_id", "filename").distinct().alias("d")
    return t.join(d, F.col("t.group_id").eqNullSafe(F.col("d.group_id")) & F.col("t.filename").eqNullSafe(F.col("d.filename")), "left_anti")


def delete_from_index(spark: SparkSession, path: str, deletes: DataFrame) -> None:
    """Rewrites only the groups named in the delete list; a group left without rows becomes an empty file.

    The folder of such a group is the one that its files report, so a name that Spark escapes is found as it is written.
    """
    groups = deletes.select("group_id").distinct().alias("g")
    named = F.col("t.group_id").eqNullSafe(F.col("g.group_id"))
    table = spark.read.parquet(path).withColumn("_file", F.col("_metadata.file_path")).alias("t")
    touched = cut_lineage(table.join(groups, named, "left_semi"))  # written out before its source is replaced
    kept = without_documents(touched, deletes).drop("_file")
    write_index(kept, path)
    folder = F.regexp_extract("_file", "^(.*)/[^/]*$", 1)
    left = kept.select("group_id").distinct().alias("k")
    emptied = touched.alias("t").join(left, F.col("t.group_id").eqNullSafe(F.col("k.group_id")), "left_anti").select(folder.alias("folder")).distinct()
    nothing = kept.drop("group_id").limit(0)
    for row in emptied.toLocalIterator():  # one row for each emptied group
        nothing.write.mode("overwrite").parquet(unquote(row["folder"]))


def append_feedback(rows: DataFrame, path: str) -> None:
    rows.select("ts", "query", "response", "vote", "document").write.mode("append").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, hubs: DataFrame, path: str) -> None:
    for name, table in (("nodes", nodes), ("edges", edges), ("hubs", hubs)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "hubs"))
