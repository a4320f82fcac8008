"""Token ids of a corpus in compressed files, in ascending id order.

Texts are range-partitioned and sorted by id; each task tokenises its stretch and writes it as segments of whole
documents. A segment is a row of the file table: its place, the ids and sizes of its documents, and independently coded
blocks (``id_coder``). Any segment can be read alone. Where a document begins in the whole corpus follows from the
segment's place in its part and the parts' totals, one number per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import id_coder
from folioscope.llm.text import arrow_schema, freeing, keyed, parts_of
from folioscope.llm.tokens import tokenizer

#: Ids after which a segment ends, with the document that passes the number.
SEGMENT = 1 << 18
FILE = "part int, segment int, first bigint, n_ids bigint, docs array<struct<doc_id:bigint,n:bigint>>, blocks array<binary>"
READ = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def token_segments(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of a token file."""
    to = arrow_schema(FILE)
    full = id_coder.BLOCK * id_coder.LANES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk, part = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        done = segment = open_ids = closed_ids = 0
        closed: list[tuple[list, np.ndarray]] = []
        docs_in: list[dict] = []
        held: list[np.ndarray] = []

        def close() -> None:
            nonlocal open_ids, closed_ids
            if docs_in:
                closed_ids, open_ids = closed_ids + open_ids, 0
                closed.append((docs_in.copy(), np.concatenate(held)))
                docs_in.clear()
                held.clear()

        def rows() -> list[dict]:
            nonlocal done, segment, closed_ids
            closed_ids = 0
            pieces = [id_coder.blocks_of(ids) for _, ids in closed]
            coded = iter(id_coder.encode([b for p in pieces for b in p]))
            out = []
            for (members, ids), p in zip(closed, pieces):
                out.append({"part": part, "segment": segment, "first": done, "n_ids": len(ids), "docs": members, "blocks": [next(coded) for _ in p]})
                done, segment = done + len(ids), segment + 1
            closed.clear()
            return out

        for batch in batches:
            for some in parts_of(batch):
                ids, sizes = tk.encode(some.column("text").to_pylist())
                begin = 0
                for doc, n in zip(some.column("doc_id").to_pylist(), sizes.tolist()):
                    held.append(np.append(ids[begin:begin + n], np.uint32(end_id)))
                    docs_in.append({"doc_id": doc, "n": n + 1})
                    begin += n
                    open_ids += n + 1
                    if open_ids >= SEGMENT:
                        close()
                        if closed_ids >= full:
                            yield pa.RecordBatch.from_pylist(rows(), to)
        tk.forget()
        close()
        if closed:
            yield pa.RecordBatch.from_pylist(rows(), to)

    ordered = keyed(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(freeing(run), FILE)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes every document's ids and the end id. A null text is the end id alone; null ids come first.

    Rows that repeat an id are documents of their own, ordered by a hash of their text. Very long texts are written whole, in
    one segment of many blocks. An empty table gives files without rows. Other columns are not written, whatever their names.
    The coder takes ids below 65,536; a tokenizer file with larger ones is an error.
    """
    token_segments(docs, tokenizer_path, end_id, id_col, text_col).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a token file: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit)."""
    files = spark.read.schema(FILE).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row a task
    begins, before = {}, 0
    for part, n in totals:
        begins[part], before = before, before + n
    shared, to = spark.sparkContext.broadcast(begins), arrow_schema(READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decoded(segments: list[dict]) -> pa.RecordBatch:
            blocks = iter(id_coder.decode([b for s in segments for b in s["blocks"]]))
            out: dict[str, list] = {f.name: [] for f in to}
            for s in segments:
                ids = np.concatenate([next(blocks) for _ in s["blocks"]]).astype("<u4").tobytes()
                at = 0
                for doc in s["docs"]:
                    for name, value in zip(out, (doc["doc_id"], shared.value[s["part"]] + s["first"] + at, doc["n"], ids[4 * at:4 * (at + doc["n"])])):
                        out[name].append(value)
                    at += doc["n"]
            return pa.RecordBatch.from_pydict(out, to)

        waiting: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                waiting += batch.slice(i, 1).to_pylist()
                if sum(len(s["blocks"]) for s in waiting) >= id_coder.LANES:
                    yield decoded(waiting)
                    waiting = []
        if waiting:
            yield decoded(waiting)

    return files.mapInArrow(freeing(run), READ)
