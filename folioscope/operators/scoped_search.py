"""Vector search within the group of each question, with the group's own limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.windows import top_k

#: The limits that a group can set at most; they bound what a task keeps before the shuffle.
MOST_PER_DOC, MOST_TOTAL = 20, 50
#: Groups that a read names one by one; questions of more groups read all.
MOST_GROUPS = 1000


def write_group_vectors(vectors: DataFrame, chunks: DataFrame, path: str) -> None:
    """The unit vectors (chunk_id, term, w) of chunks (chunk_id, group_id, doc_id) in a folder per group, each file sorted by term.

    A task writes the chunks that it holds into its own file of each group, so the vectors do not move again.
    """
    rows = vectors.join(chunks.select("chunk_id", "group_id", "doc_id"), "chunk_id")
    rows.sortWithinPartitions("group_id", "term").write.partitionBy("group_id").parquet(path)


def read_group_vectors(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The stored vectors, of the groups in ``asked`` (group_id) only while those can be named in a filter on folders."""
    stored = spark.read.parquet(path)
    named = asked.select("group_id").filter("group_id is not null").distinct().limit(MOST_GROUPS + 1).collect()
    return stored.filter(F.col("group_id").isin([r["group_id"] for r in named])) if len(named) <= MOST_GROUPS else stored


def scoped_scores(stored: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, group_id, doc_id, chunk_id, score: the cosines of a question with the chunks of its group.

    ``questions``: query_id, group_id, term, qw. A question meets its group's postings by term, other groups' never.
    """
    met = stored.join(questions, ["group_id", "term"])
    return met.groupBy("query_id", "group_id", "doc_id", "chunk_id").agg(F.round(F.sum(F.col("w") * F.col("qw")), 6).alias("score"))


def capped_by_group(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """query_id, group_id, doc_id, chunk_id, score, doc_rank, rank under the limits of each question's group.

    ``limits`` as ``catalog.resolve_settings`` gives them. First the threshold, then the best of each document, then the best
    of all; ties by chunk id. Spark keeps ``MOST_PER_DOC`` rows of a document and ``MOST_TOTAL`` of a question in a task.
    """
    order = [F.desc("score"), F.col("chunk_id")]
    good = scored.join(limits.select("group_id", "similarity_threshold", "chunks_per_doc", "max_total_chunks"), "group_id").filter(
        F.col("score") >= F.col("similarity_threshold"))
    per_doc = top_k(good, ["query_id", "doc_id"], order, MOST_PER_DOC, "doc_rank").filter("doc_rank <= chunks_per_doc")
    total = top_k(per_doc, ["query_id"], order, MOST_TOTAL, "rank").filter("rank <= max_total_chunks")
    return total.select("query_id", "group_id", "doc_id", "chunk_id", "score", "doc_rank", "rank")
