"""Exact Jaccard join of shingle sets with pivots, distance windows and recursion.

The Jaccard distance is a metric, but almost all pairs of texts lie at distance 1, so a pivot tells something only about
sets that share rare shingles with it. Regions are therefore laid around shared shingles first: two sets within the
distance have one of their first shingles in common (rarest first, a quarter of the set), so each such shingle opens a
region of the sets that begin with it. In every region

1. the first member is the pivot, and every other member's exact distance to it is measured; members within the distance
   join the pivot's class at once, and are then as good as one point;
2. the region recurses over what is left: members outside the region's largest class are compared with its next members,
   sixteen times as many in each round, until they join that class or have met all. Two members are compared only if they
   are in different classes, their sizes and parity sketches admit a link, the pair has not been measured before, and their
   distances to the region's first pivot differ by no more than the link distance (triangle inequality): members near the boundary of the
   pivot's neighbourhood are met by those beyond it, all others are not.

A region of near copies collapses in the first step, so its cost is linear; nothing is cut off. How rare a shingle is,
is counted exactly over the corpus: shingles that occur once are first in the order and never travel further, so most
texts without near copies are in no region at all. Before two sets are compared on their texts, a parity bitmap of each
(a bit a shingle) bounds their intersection; folded to a few words, the same bitmap is a sketch that the join of members looks at.
Texts are taken only for sets that are in a region, and move only for pairs to be measured, selected by a bitmap of fixed
size; a pivot with very many members is measured in several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.llm.text import WordHashes, arrow_schema, freeing, fresh, gram_hashes, keyed, parts_of, space_words
from folioscope.session import cut_lineage

SHINGLE = 5
#: Sets link when PARTS * intersection >= SHARE * union.
SHARE, PARTS = 75, 100
#: Bits of a shingle's hash that are counted and joined on. Equal ones cost a needless comparison, no more.
TOKEN_BITS = 50
#: Shingles and documents counted together by a scan task.
CHUNK_SHINGLES, CHUNK_DOCS = 2_000_000, 60_000
BITMAP_BITS = 26
#: Members measured against one copy of their pivot.
MEMBERS = 256
#: Members that one outside its region's largest class is compared with in a round; the number grows from round to round.
FIRST_STEP, GROWTH = 8, 16
#: 64-bit words of a sketch, the least size of a parity bitmap.
SKETCH = 4


def shingle_set(text: str | None, hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    return np.unique(gram_hashes(hashes.of(space_words(text)), size))


def prefix_size(n: np.ndarray) -> np.ndarray:
    """How many of a set's first shingles must hold one of any set that it links with."""
    return n - -(-SHARE * n // PARTS) + (n > 0)


def parity_bits(found: np.ndarray) -> bytes:
    """A bit for each slot that holds an odd number of the set's shingles; as many slots as the next power of two, a sketch's at least."""
    slots = max(64 * SKETCH, 1 << int(len(found) - 1).bit_length()) if len(found) else 64 * SKETCH
    return np.packbits(np.bincount((found & np.uint64(slots - 1)).astype(np.int64), minlength=slots).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The parity bitmap of ``size`` bytes of the same set."""
    while len(bits) > size:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


def most_common(bits_x: bytes, n_x: int, bits_p: bytes, n_p: int) -> int:
    """A bound of the intersection: every odd slot of the symmetric difference holds one of its shingles at least."""
    x, p = np.frombuffer(bits_x, np.uint8), np.frombuffer(bits_p, np.uint8)
    least = min(len(x), len(p))
    x, p = folded(x, least), folded(p, least)
    return min(n_x, n_p, (n_x + n_p - int(np.bitwise_count(x ^ p).sum())) // 2)


def with_text_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keyed(docs, id_col, text_col).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))


SCAN = ("bucket int, chunk bigint, tokens binary, docs binary, counts binary, "
        "ordinal int, doc_id bigint, text_key bigint, n int, set_key binary, bits binary")
SETS = "doc_id bigint, text_key bigint, n int, set_key binary, bits binary, tokens array<bigint>"


def _planes(values: np.ndarray) -> bytes:
    """All lowest bytes, then all next ones and so on: the shuffle's compression removes the empty ones."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.tobytes(), kind)


def _asked(rows: DataFrame, size: int, buckets: int) -> DataFrame:
    """Per document its set's key, size and parity bits; per chunk of documents and bucket of tokens, the tokens and their documents."""
    to = arrow_schema(SCAN)

    def batch_of(n: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in to], schema=to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, chunk = WordHashes(), TaskContext.get().partitionId() << 24
        held: list[np.ndarray] = []

        def questions() -> pa.RecordBatch:
            tokens = np.concatenate(held) >> np.uint64(64 - TOKEN_BITS)
            docs = np.repeat(np.arange(len(held), dtype=np.uint16), [len(h) for h in held])
            order = np.argsort(tokens, kind="stable")
            tokens, docs = tokens[order], docs[order]
            edges = np.searchsorted(tokens, [(b << TOKEN_BITS) // buckets for b in range(buckets + 1)])
            full = [b for b in range(buckets) if edges[b] < edges[b + 1]]
            parts = [slice(edges[b], edges[b + 1]) for b in full]
            return batch_of(len(full), {"bucket": full, "chunk": [chunk] * len(full),
                                        "tokens": [_planes(np.diff(tokens[p], prepend=np.uint64(0))) for p in parts],
                                        "docs": [_planes(docs[p]) for p in parts]})

        for batch in batches:
            for part in parts_of(batch):
                found = [shingle_set(t, hashes, size) for t in part.column("text").to_pylist()]
                at = 0
                while at < len(found):
                    room, total = CHUNK_SHINGLES - sum(map(len, held)), 0
                    first = at
                    while at < len(found) and at - first + len(held) < CHUNK_DOCS and (at == first or total + len(found[at]) <= room):
                        total += len(found[at])
                        at += 1
                    some, n = found[first:at], at - first
                    yield batch_of(n, {
                        "bucket": [chunk % buckets] * n, "chunk": [chunk] * n, "ordinal": list(range(len(held), len(held) + n)),
                        "doc_id": part.column("doc_id").slice(first, n), "text_key": part.column("text_key").slice(first, n),
                        "n": [len(f) for f in some], "bits": [parity_bits(f) for f in some],
                        "set_key": [xxhash.xxh3_128_digest(f.tobytes()) if len(f) else None for f in some]})
                    held += some
                    if at < len(found) or sum(map(len, held)) >= CHUNK_SHINGLES:
                        yield questions()
                        held, chunk = [], chunk + 1
        if held:
            yield questions()

    return rows.select("doc_id", "text_key", "text").mapInArrow(freeing(run), SCAN)


def _answered(asked: DataFrame) -> DataFrame:
    """The questions with only the tokens that two documents or more have, and how many (255: that or more)."""
    to = arrow_schema(SCAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, tokens, docs = [], [], []
        for batch in batches:
            question = pc.is_valid(batch.column("tokens"))
            yield batch.filter(pc.invert(question))
            asked_here = batch.filter(question)
            chunks += asked_here.column("chunk").to_pylist()
            tokens += [np.cumsum(_from_planes(t, np.uint64), dtype=np.uint64) for t in asked_here.column("tokens").to_pylist()]
            docs += [_from_planes(d, np.uint16) for d in asked_here.column("docs").to_pylist()]
        if not chunks:
            return
        every = np.concatenate(tokens)
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(every[order]) > 0]))
        sizes = np.diff(np.append(first, len(every)))
        counts = np.empty(len(every), np.uint8)
        counts[order] = np.repeat(np.minimum(sizes, 255).astype(np.uint8), sizes)
        out, at = [], 0
        for chunk, t, d in zip(chunks, tokens, docs):
            c = counts[at:at + len(t)]
            at += len(t)
            shared = c > 1
            if shared.any():
                out.append({"chunk": chunk, "tokens": _planes(t[shared]), "docs": _planes(d[shared]), "counts": c[shared].tobytes()})
            if len(out) >= 500:
                yield pa.RecordBatch.from_pylist(out, to)
                out = []
        yield pa.RecordBatch.from_pylist(out, to)

    return asked.mapInArrow(freeing(run), SCAN)


def _with_first_tokens(answered: DataFrame) -> DataFrame:
    """One row per document: its set and those of its first tokens, rarest first, that another document has.

    Tokens of one document only come first in the order. They can be in no other set, so they are counted, not listed.
    """
    to = arrow_schema(SETS)

    def chosen(members: list[dict], shared: list[dict]) -> pa.RecordBatch:
        members.sort(key=lambda r: r["ordinal"])
        n = np.array([r["n"] for r in members], np.int64)
        listed: list = [[]] * len(members)
        if shared:
            docs = np.concatenate([_from_planes(r["docs"], np.uint16) for r in shared]).astype(np.int64)
            tokens = np.concatenate([_from_planes(r["tokens"], np.uint64) for r in shared])
            order = np.lexsort((tokens, np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in shared]), docs))
            docs, tokens = docs[order], tokens[order]
            held = np.bincount(docs, minlength=len(n))
            begin = np.cumsum(held) - held
            wanted = np.minimum(held, np.maximum(prefix_size(n) - (n - held), 0))
            listed = [tokens[a:a + k].astype(np.int64) for a, k in zip(begin.tolist(), wanted.tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[f.name] for r in members] if f.name != "tokens" else listed, f.type) for f in to], schema=to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, members, shared = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] != own:
                    if members:
                        yield chosen(members, shared)
                    own, members, shared = row["chunk"], [], []
                (members if row["tokens"] is None else shared).append(row)
        if members:
            yield chosen(members, shared)

    return answered.sortWithinPartitions("chunk").mapInArrow(freeing(run), SETS)


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, n, set_key (null if empty), bits, tokens of every row.

    Chunks of documents ask, in packed form, how many documents have each token; the answer comes back to the chunk.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = _asked(rows, size, 4 * parts)
    return _with_first_tokens(_answered(asked.repartition(parts, "bucket")).repartition(parts, "chunk"))


def _sizes_fit(a: str, b: str):
    return F.lit(PARTS).cast("bigint") * F.least(a, b) >= F.lit(SHARE) * F.greatest(a, b)


def _regions(tokens: DataFrame) -> DataFrame:
    """token, node, n, place (0: the pivot) of tokens with two members or more; equal sets count once, equal regions too."""
    by_token = Window.partitionBy("token").orderBy("node")
    placed = (tokens.withColumn("before", F.lag("node").over(by_token)).withColumn("behind", F.lead("node").over(by_token))
              .where("(before is null or before != node) and (before is not null or behind is not null)"))
    # copies of a set next to each other leave one row; a token of copies only is left with one row
    rows = cut_lineage(placed.withColumn("place", F.row_number().over(by_token) - 1)
                       .withColumn("more", F.lead("node").over(by_token)).where("place > 0 or more is not null")
                       .select("token", "node", "n", "place"))
    mark = F.xxhash64("node")
    members = rows.groupBy("token").agg(F.count("*").alias("size"), F.bit_xor(mark).alias("a"), F.sum(mark.bitwiseAND(0xFFFFFFFF)).alias("b"))
    return rows.join(members.groupBy("size", "a", "b").agg(F.min("token").alias("token")), "token", "left_semi")


def _place(column: str):
    return F.pmod(F.xxhash64(column, F.lit(3)), F.lit(1 << BITMAP_BITS))


def _bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """Bits of a hash of a column, a fixed number."""
    at = _place(column) + 1
    rows = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bits = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    found = rows.toArrow()
    for bucket, data in zip(found.column("bucket").to_pylist(), found.column("bits")):
        piece = np.frombuffer(data.as_buffer(), np.uint8)
        begin = (bucket - 1) * len(piece)
        bits[begin:begin + len(piece)] = piece[:len(bits) - begin]
    return bits


def _perhaps_in(rows: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, Broadcast]:
    """The rows whose ``column`` is one of ``keys``, and a few others; a bitmap tells, so no row moves. The broadcast is the caller's to destroy."""
    shared = rows.sparkSession.sparkContext.broadcast(_bitmap(keys, column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column("at").to_numpy()
            yield batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))

    marked = rows.withColumn("at", _place(column))
    return marked.mapInArrow(freeing(run), marked.schema).drop("at"), shared


def _texts_of(rows: DataFrame, members: DataFrame) -> DataFrame:
    """node, text of the sets in ``members`` (node, doc_id, text_key)."""
    some, shared = _perhaps_in(rows.select("doc_id", "text", "text_key"), members, "text_key")
    key = F.concat_ws("/", "doc_id", "text_key").alias("row_key")  # of one column, so that rows that repeat already lie together after the join
    found = cut_lineage(some.select(key, "text").join(members.select(key, "node"), "row_key")
                        .dropDuplicates(["row_key", "node"]).select("node", "text"))
    shared.destroy()
    return found


def _screened(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """pairs (x, p) with low, the least distance that their parity bits admit, and possible: a link is not excluded."""
    schema = "x binary, p binary, low double, possible boolean"
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, possible = [], []
            for bits_x, n_x, bits_p, n_p in zip(*(batch.column(c).to_pylist() for c in ("bits_x", "n_x", "bits_p", "n_p"))):
                common = most_common(bits_x, n_x, bits_p, n_p)
                low.append(1 - common / (n_x + n_p - common))
                possible.append(PARTS * common >= SHARE * (n_x + n_p - common))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("p"), pa.array(low, pa.float64()), pa.array(possible, pa.bool_())], schema=to)

    of = lambda name: points.select(F.col("node").alias(name), F.col("bits").alias(f"bits_{name}"), F.col("n").alias(f"n_{name}"))
    return pairs.join(of("x"), "x").join(of("p"), "p").select("x", "p", "bits_x", "n_x", "bits_p", "n_p").mapInArrow(freeing(run), schema)


def _measured(pairs: DataFrame, points: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """x, p, low, high (bounds of the distance; equal where it was measured), linked.

    Pairs whose parity bits admit a link are measured on their texts, MEMBERS members of a pivot at a time; only their texts move.
    The result is written.
    """
    schema = "x binary, p binary, low double, high double, linked boolean"
    to = arrow_schema(schema)
    screened = cut_lineage(_screened(pairs, points))
    open_pairs = screened.where("possible").select("x", "p")
    texts, shared = _perhaps_in(texts, open_pairs.select(F.explode(F.array("x", "p")).alias("node")), "node")
    share = open_pairs.groupBy("p").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("lanes"))
    pivots = share.join(texts.withColumnRenamed("node", "p"), "p").select(
        "p", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.lit(None).cast("binary").alias("x"), "text")
    members = open_pairs.join(share, "p").join(texts.withColumnRenamed("node", "x"), "x").select(
        "p", F.pmod(F.xxhash64("x"), F.col("lanes")).cast("int").alias("lane"), "x", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, own, pivot = WordHashes(), None, np.empty(0, np.uint64)
        for batch in batches:
            out = []
            for p, lane, x, text in zip(*(batch.column(c).to_pylist() for c in ("p", "lane", "x", "text"))):
                found = shingle_set(text, hashes, size)
                if x is None:
                    own, pivot = (p, lane), found
                elif own == (p, lane):
                    common = len(np.intersect1d(pivot, found, assume_unique=True))
                    union = len(found) + len(pivot) - common
                    out.append({"x": x, "p": p, "low": 1 - common / union, "high": 1 - common / union, "linked": PARTS * common >= SHARE * union})
                else:
                    raise ValueError("a member came without its pivot")
            yield pa.RecordBatch.from_pylist(out, to)

    both = pivots.unionByName(members).repartition("p", "lane").sortWithinPartitions("p", "lane", F.col("x").asc_nulls_first())
    excluded = screened.where("not possible").select("x", "p", "low", F.lit(1.0).alias("high"), F.lit(False).alias("linked"))
    measured = cut_lineage(both.mapInArrow(freeing(run), schema).unionByName(excluded))
    shared.destroy()
    return measured


def _sketched(points: DataFrame) -> DataFrame:
    """node and the words w0, w1, ... of its parity bits, folded to a fixed size."""
    schema = "node binary, " + ", ".join(f"w{i} bigint" for i in range(SKETCH))
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [folded(np.frombuffer(b, np.uint8), 8 * SKETCH).view(np.int64) for b in batch.column("bits").to_pylist()]
            table = np.array(words, np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(table[:, i].copy()) for i in range(SKETCH))], schema=to)

    return points.select("node", "bits").mapInArrow(freeing(run), schema)


def _sketches_fit():
    """No link is excluded: every word bit in which two sketches differ is a shingle at least that one set has and the other has not."""
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a.w{i}").bitwiseXOR(F.col(f"b.w{i}"))) for i in range(SKETCH)])
    both = F.col("a.n").cast("bigint") + F.col("b.n")
    return F.lit(PARTS + SHARE) * (both - apart) >= F.lit(2 * SHARE) * both


def _open_regions(regions: DataFrame, classes: DataFrame) -> DataFrame:
    """Regions with members yet to be compared: root (the member's class) and waits (outside the largest class, not through)."""
    named = regions.drop("root", "waits").join(classes.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    main = named.groupBy("token", "root").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "root")).alias("main"))
    marked = named.join(main, "token").withColumn("waits", (F.col("root") != F.col("main.root")) & (F.col("done") < F.col("size"))).drop("main")
    return marked.join(marked.where("waits").select("token").distinct(), "token", "left_semi")


def _next_pairs(regions: DataFrame, marks: DataFrame, measured: DataFrame, step: int) -> DataFrame:
    """Pairs (x, p) of every waiting member with the next ``step`` members of its region, as far as a link is possible.

    A pair that has several regions in common is met in the first of them only. ``marks``: a node's regions and its sketch.
    """
    placed = regions.join(marks, "node")
    a, b = placed.where("waits").alias("a"), placed.alias("b")
    reach = F.lit(1 - SHARE / PARTS + 1e-9)
    near = (F.col("a.low") - F.col("b.high") <= reach) & (F.col("b.low") - F.col("a.high") <= reach)
    here = (F.col("b.place") >= F.col("a.done")) & (F.col("b.place") < F.col("a.done") + step)
    first = F.array_min(F.array_intersect("a.tokens", "b.tokens")) == F.col("a.token")
    found = a.join(b, (F.col("a.token") == F.col("b.token")) & here & (F.col("a.root") != F.col("b.root")) & _sizes_fit("a.n", "b.n") & near
                   & _sketches_fit() & first)
    return (found.select(F.greatest("a.node", "b.node").alias("x"), F.least("a.node", "b.node").alias("p")).distinct()
            .join(measured.select("x", "p"), ["x", "p"], "left_anti"))


def _classes(rows: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, n, least: per row of ``with_text_key``, its component's first row (no_id, doc_id, text_key); null for an empty set."""
    sets = cut_lineage(shingle_sets(rows, size))
    regions = _regions(sets.select(F.explode("tokens").alias("token"), F.col("set_key").alias("node"), "n"))
    sizes = regions.groupBy("token").agg(F.count("*").alias("size"), F.min("node").alias("head"))
    regions = cut_lineage(regions.join(sizes, "token").withColumn("done", F.lit(1)))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    points = cut_lineage(sets.where("set_key is not null").groupBy(F.col("set_key").alias("node")).agg(
        F.min(row).alias("one"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    involved = cut_lineage(regions.select("node").distinct().join(points, "node"))

    pairs = regions.where((F.col("place") > 0)).join(
        involved.select(F.col("node").alias("head"), F.col("n").alias("n_head")), "head").where(_sizes_fit("n", "n_head")).select(
        F.col("node").alias("x"), F.col("head").alias("p")).distinct()
    texts = _texts_of(rows, involved.select("node", "one.doc_id", "one.text_key"))
    measured = fresh_pairs = _measured(pairs, involved, texts, size)
    # pairs with a head are all measured by now, as far as sizes admit a link
    to_head = measured.select(F.col("x").alias("node"), F.col("p").alias("head"), "low", "high")
    marks = cut_lineage(regions.groupBy("node").agg(F.collect_set("token").alias("tokens")).join(_sketched(involved), "node"))  # a quarter of a set at most
    regions = (regions.join(to_head, ["node", "head"], "left").drop("head")
               .withColumn("low", F.coalesce("low", F.lit(0.0))).withColumn("high", F.coalesce("high", F.lit(1.0))))
    links, step = [], FIRST_STEP
    while True:
        links.append(fresh_pairs.where("linked").select(F.col("x").alias("a"), F.col("p").alias("b")))
        classes = components(reduce(DataFrame.unionByName, links))
        links = [classes.select(F.col("node").alias("a"), F.col("root").alias("b"))]
        regions = cut_lineage(_open_regions(regions, classes))
        if regions.isEmpty():
            break
        fresh_pairs = _measured(_next_pairs(regions, marks, measured, step), involved, texts, size)
        measured = measured.unionByName(fresh_pairs)
        regions = regions.withColumn("done", F.when(F.col("waits"), F.col("done") + step).otherwise(F.col("done")))
        step *= GROWTH
    named = points.join(classes, "node", "left").select("node", "one", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("one").alias("least"))
    of_set = named.join(least, "root").select(F.col("node").alias("set_key"), "least")
    return sets.join(of_set, "set_key", "left").select("doc_id", "text_key", "n", "least")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links, its own included).

    A document's set holds its distinct ``size``-word shingles; a shorter text is one shingle; a text without words (or
    null) has an empty set, links with nothing and keeps its own id. Equal sets are one point of the join. Null ids take
    part and get their component's smallest id, if it has one. Rows that repeat are points like any other; an empty
    table gives an empty result; very long texts are taken whole; other columns are not looked at. Hashes have 64 bits a shingle and 128 a set.
    """
    return _classes(with_text_key(docs, id_col, text_col), size).select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"))


def keep_least(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Of each component, the row with the smallest id (then text hash) stays, with all its columns; null ids rank last.

    Texts without words all stay; of rows that repeat id and text, one does.
    """
    classes = _classes(with_text_key(docs, id_col, text_col), size)
    first = F.col("least").isNull() | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key")))
    own, key, kept_id, kept_key = fresh(docs, "_id", "_key", "_kept_id", "_kept_key")
    kept = classes.where(first).select(F.col("doc_id").alias(kept_id), F.col("text_key").alias(kept_key)).distinct()
    rows = docs.withColumn(own, F.col(id_col).cast("bigint")).withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return (rows.join(kept, F.col(own).eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key)), "left_semi")
            .dropDuplicates([own, key]).select(*docs.columns))
