"""Packing of tokenised documents into sequences of a fixed length: first-fit decreasing in randomised groups.

Every document goes to a random group of about ``group_docs`` documents (a hash of its id and ids), so a group's size
does not depend on any key. Within a group, whole sequences are cut off long documents and the rests are placed by
first-fit decreasing; a tournament tree over the bins' free room finds the first bin that fits in logarithmic time. Then
the emptiest bins are dissolved to fill the larger gaps of the others. Groups are independent of each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.text import arrow_schema, freeing, keyed, parts_of
from folioscope.llm.tokens import tokenizer

LENGTH = 1024
GROUP_DOCS = 1024
#: The smallest gap that is worth a cut.
LEAST_CUT = 16
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Item numbers per bin. Every size is between 1 and ``room``."""
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    tree = [room] * (2 * leaves)  # each node has the largest free room below it
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < sizes[item]:
                at += 1
        if at - leaves == len(bins):
            bins.append([])
        bins[at - leaves].append(item)
        tree[at] -= sizes[item]
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
    return bins


def topped_up(bins: list[list[tuple[int, int, int]]], room: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (document, start, length), with gaps of ``least`` or more filled by cutting up the emptiest bins."""
    held = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (held[i], -i))  # emptiest first: they give
    takers = [i for i in reversed(order) if held[i] <= room - least]
    given: set[int] = set()
    for giver in order:
        open_takers = [i for i in takers if i != giver and i not in given and held[i] <= room - least]
        if sum(room - held[i] for i in open_takers) < held[giver]:
            break
        given.add(giver)
        pieces = bins[giver][::-1]
        for taker in open_takers:
            while pieces and room - held[taker] >= least:
                doc, start, length = pieces.pop()
                cut = min(length, room - held[taker])
                bins[taker].append((doc, start, cut))
                held[taker] += cut
                if cut < length:
                    pieces.append((doc, start + cut, length - cut))
        bins[giver], held[giver] = pieces[::-1], sum(p[2] for p in pieces)
        if pieces:  # gaps under ``least`` could not take these
            break
    return [b for b in bins if b]


def pack_group(totals: list[int], room: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of documents with so many tokens once."""
    whole = [[(d, s, room)] for d, n in enumerate(totals) for s in range(0, n - room + 1, room)]
    rests = [(d, n - n % room, n % room) for d, n in enumerate(totals) if n % room]
    bins = [[rests[i] for i in b] for b in first_fit_decreasing([r[2] for r in rests], room)]
    return whole + topped_up(bins, room, least)


class RepeatCounts(dict):
    """How often a key has come before, for up to a fixed number of keys; beyond that it starts anew."""

    LIMIT = 500_000

    def before(self, key: tuple) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        n = self.get(key, 0)
        self[key] = n + 1
        return n


def tokenised(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, nth, planes: each document's ids and the end id. Null texts are empty.

    ``nth`` counts the rows before in the same task with this id and text, so that repeated rows can be told apart.

    ``planes`` holds the ids' lowest bytes, then the next ones and so on: the high bytes are nearly all zero and vanish
    when the shuffle compresses them.
    """
    schema = "doc_id bigint, n bigint, nth int, planes binary"
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk, seen = tokenizer(path), RepeatCounts()
        try:
            for batch in batches:
                for part in parts_of(batch):
                    ids, sizes = tk.encode(part.column("text").to_pylist())
                    ends = np.cumsum(sizes)
                    planes = [np.append(ids[e - n:e], np.uint32(end_id)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
                              for n, e in zip(sizes.tolist(), ends.tolist())]
                    nth = [seen.before((doc, zlib.crc32(p))) for doc, p in zip(part.column("doc_id").to_pylist(), planes)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes + 1, pa.int64()), pa.array(nth, pa.int32()),
                                                      pa.array(planes, pa.binary())], schema=to)
        finally:
            tk.forget()

    return keyed(docs, id_col, text_col).mapInArrow(freeing(run), schema)


def pack(docs: DataFrame, path: str, end_id: int = 0, length: int = LENGTH, group_docs: int = GROUP_DOCS,
         least_cut: int = LEAST_CUT, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    A document's pieces hold its ids and the end id, each once; pieces fill their sequence without gaps from offset 0.
    A null or empty text is one end id. Rows that repeat an id are packed as documents of their own, rows with null ids
    too, and dealt over all groups; long texts give many pieces. An empty table gives no pieces. Other columns are not looked at.
    """
    groups = max(1, -(-docs.count() // group_docs))
    rows = tokenised(docs, path, end_id, id_col, text_col).withColumn(
        "part", F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.crc32("planes"), "nth"), F.lit(groups)))
    to = arrow_schema(PIECES)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        docs_in = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "planes", "n"))), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        ids = [np.frombuffer(p, np.uint8).reshape(4, -1).T.tobytes() for _, p, _ in docs_in]
        out: dict[str, list] = {f.name: [] for f in to}
        for nth, pieces in enumerate(pack_group([n for _, _, n in docs_in], length, least_cut)):
            offset = 0
            for d, start, size in pieces:
                values = (docs_in[d][0], start, size, ids[d][4 * start:4 * (start + size)], docs_in[d][2],
                          (key[0].as_py() << 32) + nth, offset)
                for column, value in zip(out.values(), values):
                    column.append(value)
                offset += size
        return pa.Table.from_pydict(out, schema=to)

    return rows.groupBy("part").applyInArrow(run, PIECES)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
