"""Derived inputs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.build import base_chunks
from folioscope.operators.chunking import chunk_id, window_chunks
from folioscope.session import read_table, spread


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", "source", "lang", "text")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, spread for heavy work on their texts."""
    return spread(documents(spark, sf), "doc_id")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, source, lang, chunk_index, chunk_text, chunk_id (500-character windows)."""
    return window_chunks(texts(spark, sf)).withColumn(
        "chunk_id", chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("chunk_text")))


def titled(spark: SparkSession, sf: str) -> DataFrame:
    """Title chunks with id, page and section path (language, section title)."""
    return base_chunks(texts(spark, sf))
