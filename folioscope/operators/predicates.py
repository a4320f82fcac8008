"""Filters over documents, questions and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.vocab import NO_INFO_PHRASES


def clean_table(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Null becomes '' and values are trimmed in every column outside ``keep``."""
    return df.select(*[
        F.col(c) if c in keep else F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in df.columns])


def no_info(answer: Column) -> Column:
    low = F.lower(answer)
    return reduce(lambda a, b: a | b, [low.contains(p) for p in NO_INFO_PHRASES])


def in_scope(rows: DataFrame, scopes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the asked (group, file) scopes, each with its question."""
    return rows.join(scopes, keys)


def owned_by(rows: DataFrame, users: DataFrame, key: str) -> DataFrame:
    return rows.join(users, key, "left_semi")


def target_document(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, filename, query_text, error.

    ``asked``: query_id, user_id, text; ``docs``: user_id, ord, filename. '@prefix rest' picks the user's
    first document whose name starts with the prefix, any other text the user's first document.
    A user's documents are first picked per name beginning of a length that the user asks for, so questions meet one row for each
    beginning and never the documents.
    """
    parsed = asked.select(
        "query_id", "user_id", "text", F.col("text").startswith("@").alias("tagged"),
        F.lower(F.regexp_extract("text", r"^@(\S*)", 1)).alias("prefix"))
    first = [F.min_by("filename", "ord").alias("filename"), F.min("ord").alias("ord")]
    lengths = parsed.filter("tagged").select("user_id", F.length("prefix").alias("n")).distinct()
    # an asked length beyond a name's own cannot match it
    named = docs.join(lengths, "user_id").filter(F.col("n") <= F.length(F.lower("filename")))
    beginnings = named.groupBy("user_id", F.expr("substring(lower(filename), 1, n)").alias("prefix")).agg(*first)
    own = docs.groupBy("user_id").agg(*first)
    found = parsed.filter("tagged").select("query_id", "user_id", "prefix").join(beginnings, ["user_id", "prefix"]).select("query_id", "filename", "ord")
    found = found.unionByName(parsed.filter("not tagged").select("query_id", "user_id").join(own, "user_id").select("query_id", "filename", "ord"))
    hit = found.groupBy("query_id").agg(F.min_by("filename", "ord").alias("filename"))
    return parsed.join(hit, "query_id", "left").select(
        "query_id", "filename",
        F.when(F.col("tagged"), F.regexp_extract("text", r"(?s)^@\S* ?(.*)$", 1)).otherwise(F.col("text")).alias("query_text"),
        F.when(F.col("filename").isNull(), "no document").alias("error"))
