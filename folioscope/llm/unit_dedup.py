"""Passages that repeat across a corpus, found by hashing its sentences and lines.

A text is cut at line ends and sentence ends; each unit is normalised (A-Z lower-cased, white space collapsed) and
hashed to 128 bits. Of equal units the earliest stays, ranked by document id, then position. Runs of repeated units
with at least ``least_words`` words together are removed from their documents; a short repeated phrase alone stays.

All units meet once, by digest. A scan task already knows most repeats of a hot line: a unit ranked below another one
that the task has seen cannot be the earliest. Such rows are dealt out over many lanes, so the lane in which a digest's
candidates meet holds a few rows a scan task at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.text import arrow_schema, keyed, parts_of, space_words

UNIT = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
LEAST_WORDS = 20
#: Digests that a scan task remembers; beyond that it starts anew and leaves more to the shuffle.
REMEMBERED = 300_000
UNITS = "doc_id bigint, row bigint, pos int, digest binary, words int, first int, last int, lane int"


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (hash of the text: tells apart different texts under one id), text."""
    return keyed(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).select(
        "doc_id", F.xxhash64("text").alias("row"), "text")


def units(rows: DataFrame) -> DataFrame:
    """Every unit with its position, digest, number of words and original offsets (code points, end exclusive).

    lane 0: may be the earliest of its digest; other lanes: cannot be.
    """
    to = arrow_schema(UNITS)
    last_id = 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}
        for batch in batches:
            for part in parts_of(batch):
                of, pos, digests, words, spans, lanes = [], [], [], [], [], []
                for i, (doc, row, text) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "row", "text")))):
                    rank = last_id if doc is None else doc
                    for p, m in enumerate(UNIT.finditer(text)):
                        unit = space_words(m[0])
                        digest = xxhash.xxh3_128_digest(b" ".join(unit))
                        best = seen.get(digest)
                        if best == (rank, row, p):  # a row that repeats id and text: the unit is there already
                            continue
                        if best is None or (rank, row, p) < best:
                            seen[digest] = (rank, row, p)
                            lanes.append(0)
                        else:
                            lanes.append(1 + (row * 31 + p) % 1_000_000_007)
                        of.append(i)
                        pos.append(p)
                        digests.append(digest)
                        words.append(len(unit))
                        spans.append(m.span())
                if len(seen) > REMEMBERED:
                    seen.clear()
                at = pa.array(of, pa.int32())
                span = np.array(spans, np.int32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), part.column("row").take(at), pa.array(pos, pa.int32()), pa.array(digests, pa.binary()),
                     pa.array(words, pa.int32()), pa.array(span[:, 0]), pa.array(span[:, 1]), pa.array(lanes, pa.int32())], schema=to)

    return rows.mapInArrow(run, UNITS)


def repeated_runs(rows: DataFrame, least_words: int) -> DataFrame:
    """doc_id, row, first, last: offsets of runs of repeated units with ``least_words`` words or more."""
    earliest = Window.partitionBy("digest", "lane").orderBy(F.col("doc_id").asc_nulls_last(), "row", "pos")
    repeats = (units(rows).withColumn("place", F.rank().over(earliest)).where("lane > 0 or place > 1")
               .select("doc_id", "row", "pos", "words", "first", "last").distinct())
    island = F.col("pos") - F.row_number().over(Window.partitionBy("doc_id", "row").orderBy("pos"))
    return (repeats.withColumn("island", island).groupBy("doc_id", "row", "island")
            .agg(F.sum("words").alias("words"), F.min("first").alias("first"), F.max("last").alias("last"))
            .where(F.col("words") >= least_words).select("doc_id", "row", "first", "last"))


def _cleaned(rows: DataFrame) -> DataFrame:
    """doc_id, text (between the spans), spans."""
    schema = "doc_id bigint, text string, spans array<struct<first:int,last:int>>"
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch):
                texts = []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    ends = [0, *(x["last"] for x in spans)]
                    texts.append("".join(text[a:b] for a, b in zip(ends, [*(x["first"] for x in spans), len(text)])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), part.column("spans")], schema=to)

    return rows.select("doc_id", "text", "spans").mapInArrow(run, schema)


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per document: doc_id, text (what stays), spans (removed, original code points, end exclusive).

    Null texts are empty and lose nothing; null ids rank last. Different texts under one id are documents of their own,
    ranked by a hash of the text; rows that repeat id and text are one document and come out alike. A passage that
    repeats inside one document goes too. Very long texts are cut whole. An empty table gives an empty result; other columns are not looked at.
    """
    rows = with_keys(docs, id_col, text_col)
    removed = repeated_runs(rows, least_words).groupBy("doc_id", "row").agg(
        F.array_sort(F.collect_list(F.struct("first", "last"))).alias("found")).withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    joined = rows.join(removed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    none = F.expr("cast(array() as array<struct<first:int,last:int>>)")
    return _cleaned(joined.select("doc_id", "text", F.coalesce("found", none).alias("spans")))


def passage_digests(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_removed (runs), chars_removed, spans as text, text_sha256 of what stays."""
    chars = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["last"] - x["first"])
    return cleaned.select(
        "doc_id", F.size("spans").cast("bigint").alias("n_removed"), chars.alias("chars_removed"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["first"], x["last"])), ",").alias("spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
