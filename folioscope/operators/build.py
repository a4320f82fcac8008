"""Documents to enriched chunk records in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import strip
from folioscope.functions.vocab import MAX_BYTES
from folioscope.operators import enrich
from folioscope.operators.chunking import chunk_id, line_elements, section_path, title_chunks
from folioscope.operators.graph import first_occurrence_references
from folioscope.session import cut_lineage


def split_usable(docs: DataFrame, limit: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantine with reason) — a bad document never stops the job."""
    reason = (
        F.when(F.col("text").isNull() | (strip(F.col("text")) == ""), "empty")
        .when(F.octet_length("text") > limit, "too large")
    )
    marked = docs.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null").drop("text")


def base_chunks(docs: DataFrame) -> DataFrame:
    """Title chunks with id and section path (language, section title)."""
    raw = title_chunks(docs if "elements" in docs.columns else line_elements(docs))
    with_id = raw.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("chunk_text")))
    return section_path(with_id.withColumn("path", F.concat_ws("/", "lang", "section_title")))


def chunk_build(docs: DataFrame) -> DataFrame:
    """One record per chunk: identity, text, section, type, keywords, page, reference count, importance, metadata.

    References stay a table (src, dst), since a copied passage can be referred to without bound.
    """
    chunks = cut_lineage(base_chunks(docs))  # elements are never blank, so neither are chunks
    typed = enrich.semantic_type(chunks)
    scored = enrich.importance(typed, first_occurrence_references(chunks))
    words = enrich.keywords(chunks.select("chunk_id", "chunk_text"), "chunk_id", "chunk_text")
    return scored.join(words, "chunk_id").select(
        "chunk_id", F.col("chunk_text").alias("text"), "doc_id", "chunk_index", "section_title", "parent_section",
        F.col("path_parts").alias("hierarchical_path"), "semantic_type", "keywords", "page_number", "ref_count",
        F.col("importance").alias("importance_score"),
        F.create_map(F.lit("filename"), F.col("doc_id").cast("string"), F.lit("language"), F.col("lang")).alias("metadata"))
