"""Benchmark contamination: a broadcast hash set of test windows, scanned over the words of every document.

A window is ``size`` consecutive words of a benchmark item (a shorter item is one window). Windows reach the workers
as sorted 64-bit hashes in blocks of at most ``block`` windows, so that what is broadcast has a fixed bound; a larger
benchmark takes more passes. A hash hit is verified word by word before it counts. Documents are never shuffled but for
the small per-document results of several passes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from folioscope.llm.text import WordHashes, arrow_schema, encoded, freeing, fresh, gram_hashes, keyed, letter_words, map_texts, parts_of
from folioscope.session import cut_lineage

WINDOW = 13
#: Windows per broadcast block: at most about 300 MB with the words that verify hits, 16 MB of hashes.
BLOCK = 1_000_000


def _windows(items: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """hash, n, words (space-joined), item_id: distinct windows of all items. A null item id counts as empty."""
    schema = "hash bigint, n int, words string, item_id string"
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = letter_words(text)
                n = min(size, len(words))
                codes = gram_hashes(hashes.of(words), size).view(np.int64).tolist()
                yield pa.RecordBatch.from_pylist([{"hash": h, "n": n, "words": b" ".join(words[i:i + n]).decode(), "item_id": item}
                                                  for i, h in enumerate(codes)], to)

    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(freeing(run), schema).distinct()


class WindowSet:
    """One block of windows: sorted hashes per window length, and what each hash stands for."""

    def __init__(self, rows: list) -> None:
        self.meaning: dict[int, dict[bytes, list[str]]] = defaultdict(dict)
        lengths: dict[int, set[int]] = defaultdict(set)
        for r in rows:
            self.meaning[r["hash"]].setdefault(r["words"].encode(), []).append(r["item_id"])
            lengths[r["n"]].add(r["hash"])
        self.hashes = {n: np.array(sorted(h), np.int64) for n, h in lengths.items()}

    def hits(self, words: list[bytes], codes: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, number of words, items) of each verified occurrence."""
        for n, known in self.hashes.items():
            if len(words) < n:
                continue
            grams = gram_hashes(codes, n).view(np.int64)
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            for i in np.flatnonzero(known[at] == grams):
                items = self.meaning[int(grams[i])].get(b" ".join(words[i:i + n]))
                if items:
                    yield int(i), n, items


def _blocks(windows: DataFrame, block: int) -> Iterator[list]:
    """The windows in bounded lists. Blocks are cut by hash, so equal hashes stay together."""
    windows = windows.persist()
    parts = max(1, -(-windows.count() // block))
    for k in range(parts):
        yield windows.where(F.pmod(F.xxhash64("hash"), F.lit(parts)) == k).collect()
    windows.unpersist()


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, spans (merged hit word ranges, end exclusive), items (sorted item ids).

    A null or wordless text has no words and no hits; a wordless item has no window. Every row is judged by itself, also
    one that repeats another. Empty tables give no hits.
    """
    rows = keyed(docs, id_col, text_col)
    passes = []
    for found in _blocks(_windows(benchmark, size, item_col, item_text), block):
        shared = docs.sparkSession.sparkContext.broadcast(found)
        passes.append(map_texts(rows, _scan(shared), "n_words bigint, text_key string, "
                                "spans array<struct<first:bigint,last:bigint>>, items array<string>"))
    if len(passes) == 1:
        return passes[0].drop("text_key")
    merged = reduce(DataFrame.unionByName, passes).groupBy("doc_id", "text_key", "n_words").agg(
        (F.count("*") / len(passes)).cast("int").alias("times"),  # rows that repeat id and text
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.withColumn("nth", F.explode(F.sequence(F.lit(1), "times"))).select(
        "doc_id", "n_words", merged_ranges("spans").alias("spans"), "items")


def merged_ranges(spans: str | Column) -> Column:
    """Sorted ranges with overlapping and touching ones joined."""
    start = F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)")
    return F.aggregate(spans, start, lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["last"] >= x["first"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["first"].alias("first"),
            F.greatest(F.element_at(acc, -1)["last"], x["last"]).alias("last"))))).otherwise(F.concat(acc, F.array(x))))


def _scan(shared):
    def make():
        known, hashes = WindowSet(shared.value), WordHashes()

        def scan(texts: list) -> dict:
            out: dict[str, list] = {"n_words": [], "text_key": [], "spans": [], "items": []}
            for text in texts:
                words = letter_words(text)
                hit, items = np.zeros(len(words) + 2, bool), set()
                for first, n, of in known.hits(words, hashes.of(words)):
                    hit[first + 1:first + 1 + n] = True
                    items.update(of)
                edges = np.flatnonzero(hit[1:] != hit[:-1]).tolist()
                out["n_words"].append(len(words))
                out["text_key"].append(xxhash.xxh3_128_hexdigest(encoded(text)))
                out["spans"].append([{"first": a, "last": b} for a, b in zip(edges[::2], edges[1::2])])
                out["items"].append(sorted(items))
            return out

        return scan

    return make


def judged(hits: DataFrame, least: int = 20) -> DataFrame:
    """``benchmark_hits`` with n_hit, n_items, items_sha256 and contaminated (a hit word in ``least`` words or more)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["last"] - x["first"])
    return hits.withColumn("n_hit", n_hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.lit(least) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, least: int = 20, text_col: str = "text", item_col: str = "item_id",
                        item_text: str = "text", size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; map-only if the windows fit one block.

    Null and empty texts have no words and stay; very long texts are scanned whole. Each of repeated rows is judged, and alike; a
    document with exactly one hit word in ``least`` goes. Empty tables keep every row. Columns of any name may be there.
    """
    n, spans = fresh(docs, "_n", "_spans")
    found = docs.withColumn(n, F.lit(0)).withColumn(spans, F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)"))
    for k, windows in enumerate(_blocks(_windows(benchmark, size, item_col, item_text), block)):
        shared = docs.sparkSession.sparkContext.broadcast(windows)
        found = _with_hits(cut_lineage(found) if k else found, shared, text_col, n, spans)
    hits = F.aggregate(merged_ranges(F.array_sort(spans)), F.lit(0).cast("bigint"), lambda acc, x: acc + x["last"] - x["first"])
    return found.where((hits == 0) | (F.lit(least) * hits < F.col(n))).select(*docs.columns)


def _with_hits(rows: DataFrame, shared, text_col: str, n: str, spans: str) -> DataFrame:
    """Rows with the number of words in ``n`` and the hit ranges so far in ``spans``."""
    to = to_arrow_schema(rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scan(shared)()
        for batch in batches:
            for part in parts_of(batch, text_col):
                found = scan(part.column(text_col).to_pylist())
                both = [old + new for old, new in zip(part.column(spans).to_pylist(), found["spans"])]
                columns = dict(zip(part.schema.names, part.columns)) | {
                    n: pa.array(found["n_words"], pa.int32()), spans: pa.array(both, to.field(spans).type)}
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in to], schema=to)

    return rows.mapInArrow(freeing(run), rows.schema)
