"""Language-model scores from a log-frequency Bloom filter of the counts of all words and word pairs of the training texts.

A count is stored as its level, the number of powers of ``BASE`` up to it: a key with level L is in the filter once for each of
the levels 1 to L. To read a count, levels are probed in turn until one is missing; what is read is the least whole number of the
last level's bracket. Every count is stored, those of 1 too, at every corpus size. The filter lies in segments by ranges of the
keys' hashes, each sized by what it holds, so its size follows the corpus. As many neighbouring segments as ``PASS_BYTES`` allow are
broadcast for one pass over the texts, in which each part of the texts notes the levels of its words and pairs; a larger filter
takes more passes, never a larger broadcast. A pair's probability is interpolated from the counts read for the pair, the word
before and the word.

Exact counts of words, for the base score beside it, go from the parts of the texts to segments by hash and come back as sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.text import WordHashes, arrow_schema, keyed, parts_of, scrambled, space_words
from folioscope.session import cut_lineage

BASE, PROBES = 1.4, 3
#: Bits for each level of each entry. With 3 probes an absent level is found by mistake 3 times in 100.
ITEM_BITS = 8
#: Bytes of the filter that are broadcast for one pass.
PASS_BYTES = 96_000_000
#: Tokens for each segment of the filter, and bytes of text for each segment of the exact counts.
SEGMENT_TOKENS, SEGMENT_TEXT = 2_000_000, 32_000_000
#: Bytes of text of a part.
PART_TEXT = 6_000_000
#: Bytes of text for each token, at least about.
TOKEN_TEXT = 6
#: Share of pairs' mass that is taken from their counts; the rest goes to the lower order.
SHARE = 0.8
WORD, PAIR, LEVELS = 1, 2, 3
TEXT_END = xxhash.xxh3_64_intdigest(b"\n")  # no word has white space
#: What goes to the filter: a range of hashes, and of one kind the sorted keys in it and their counts in a part.
COUNTED = "segment bigint, kind int, n int, data binary, more binary"
BUILT = "segment bigint, bits bigint, data binary, tokens bigint, distinct bigint"
#: What moves between the steps. kind 0 is a part's texts: their lengths and ids and each token's place among the part's sorted
#: words. Kinds 0 and 3 hold levels: of the part's words, and of each token's pair.
MOVED = "segment bigint, part bigint, kind int, lengths array<int>, ids array<bigint>, n int, data binary, more binary, pairs binary"
SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def token_hashes(text: str | None, hashes: WordHashes) -> np.ndarray:
    """One hash per word, and one for the end of the text."""
    return np.append(hashes.of(space_words(text)), np.uint64(TEXT_END))


def pair_keys(tokens: np.ndarray) -> np.ndarray:
    """Per token, a hash of the previous word's hash and its own; a text begins after an end."""
    before = np.append(np.uint64(TEXT_END), tokens[:-1])
    return scrambled(scrambled(before + np.uint64(1)) + tokens)


def packed(values: np.ndarray) -> bytes:
    """The values' lowest bytes, then the next ones and so on, compressed: high bytes are nearly all alike."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(-1)


def segment_ends(keys: np.ndarray, segments: int) -> np.ndarray:
    """Where each segment's keys end among sorted ones; a segment holds a range of hashes."""
    bounds = np.array([(i << 64) // segments for i in range(1, segments)], np.uint64)
    return np.append(np.searchsorted(keys, bounds), len(keys))


def levels_of(n: np.ndarray) -> np.ndarray:
    """The level of each count: 1 for 1, one more at each power of ``BASE``."""
    return (np.floor(np.log(np.maximum(n, 1)) / math.log(BASE) + 1e-9) + 1).astype(np.int64)


def counts_at(levels: np.ndarray) -> np.ndarray:
    """The least whole number of each level; 0 for level 0."""
    return np.where(levels > 0, np.ceil(BASE ** (levels - 1.0) - 1e-9), 0.0)


def _places(keys: np.ndarray, kind: int, level: int, bits: np.ndarray) -> Iterator[np.ndarray]:
    """The positions of a level of each key, in segments of so many bits."""
    first = scrambled(scrambled(keys + np.uint64(kind)) ^ np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    step = (first >> np.uint64(33)) | np.uint64(1)
    for i in range(PROBES):
        yield (first + np.uint64(i) * step) % bits


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """The range of hashes that a key is in; ``segments`` is a power of two."""
    return (keys >> np.uint64(65 - segments.bit_length())).astype(np.int64) if segments > 1 else np.zeros(len(keys), np.int64)


def filled(entries: list[tuple[int, np.ndarray, np.ndarray]], item_bits: int) -> tuple[int, bytes]:
    """A segment's bits, and how many they are, from (kind, keys, counts)."""
    levels = [levels_of(n) for _, _, n in entries]
    bits = -(-max(1, sum(int(x.sum()) for x in levels) * item_bits) // 64) * 64
    held = np.zeros(bits, np.uint8)
    for (kind, keys, _), top in zip(entries, levels):
        level = 1
        while len(keys):
            for place in _places(keys, kind, level, np.uint64(bits)):
                held[place] = 1
            level += 1
            keys, top = keys[top >= level], top[top >= level]
    return bits, np.packbits(held).tobytes()


@dataclass(frozen=True)
class CountFilter:
    """Neighbouring segments of the filter, ``first`` and those after it, one after the other."""

    segments: int
    first: int
    bits: np.ndarray
    data: np.ndarray

    def levels(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """The level read for each key; 0 for keys of other segments and for those that are not there."""
        out = np.zeros(len(keys), np.uint8)
        segment = segment_of(keys, self.segments) - self.first
        at = np.flatnonzero((segment >= 0) & (segment < len(self.bits)))
        at = at[self.bits[segment[at]] > 0]
        begin = (np.cumsum(self.bits) - self.bits)[segment[at]]
        bits, level = self.bits[segment[at]].astype(np.uint64), 1
        while len(at):
            found = np.ones(len(at), bool)
            for place in _places(keys[at], kind, level, bits):
                place = begin + place.astype(np.int64)
                found &= (self.data[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
            at, begin, bits = at[found], begin[found], bits[found]
            out[at] = level
            level += 1
            if level > 250:
                break
        return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(number, rows, tokens per text, all tokens, whether they are learnt from) of each part of a task's texts."""
    hashes, number = WordHashes(), TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in parts_of(batch, most=PART_TEXT):
            tokens = [token_hashes(t, hashes) for t in part.column("text").to_pylist()]
            lengths = np.array([len(t) for t in tokens], np.int32)
            learnt = np.repeat(part.column("trained").to_numpy(zero_copy_only=False), lengths)
            yield number, part, lengths, np.concatenate(tokens), learnt.astype(bool)
            number += 1


def _counted(segments: int):
    """Rows of COUNTED: for each range of hashes the words, and the pairs, of a part that are learnt from."""
    to = arrow_schema(COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, every, learnt in _parts(batches):
            rows = []
            for kind, of in ((WORD, every), (PAIR, pair_keys(every))):
                keys, times = np.unique(of[learnt], return_counts=True)
                cuts = np.searchsorted(segment_of(keys, segments), np.arange(segments + 1))
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    a, b = cuts[s], cuts[s + 1]
                    rows.append((s, kind, int(b - a), packed(keys[a:b]), packed(times[a:b].astype(np.uint32))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), to)], schema=to)

    return run


def _built(item_bits: int):
    to = arrow_schema(BUILT)

    def run(table: pa.Table) -> pa.Table:
        entries, totals = [], (0, 0)
        kinds, sizes = table.column("kind").to_numpy(), table.column("n").to_numpy()
        for kind in (WORD, PAIR):
            at = np.flatnonzero(kinds == kind).tolist()
            if not at:
                continue
            keys = np.concatenate([unpacked(table.column("data")[i].as_py(), int(sizes[i]), np.uint64) for i in at])
            times = np.concatenate([unpacked(table.column("more")[i].as_py(), int(sizes[i]), np.uint32) for i in at])
            found, which = np.unique(keys, return_inverse=True)
            sums = np.bincount(which, times, len(found)).astype(np.int64)
            entries.append((kind, found, sums))
            if kind == WORD:
                totals = int(sums.sum()), len(found)
        bits, data = filled(entries, item_bits)
        return pa.Table.from_pylist([dict(zip(to.names, (table.column("segment")[0].as_py(), bits, data, *totals)))], schema=to)

    return run


def built_filter(rows: DataFrame, segments: int, item_bits: int) -> DataFrame:
    """The filter of the rows that are ``trained``: one row per segment that holds anything, written out."""
    return cut_lineage(rows.mapInArrow(_counted(segments), COUNTED).groupBy("segment").applyInArrow(_built(item_bits), BUILT))


def stretches(built: DataFrame, pass_bytes: int) -> list[list[tuple[int, int]]]:
    """(segment, bits) of the filter's segments, in stretches of neighbours that one pass can hold; one stretch at least."""
    out: list[list[tuple[int, int]]] = [[]]
    for segment, bits in sorted((r["segment"], r["bits"]) for r in built.select("segment", "bits").collect()):  # two numbers a segment
        if out[-1] and sum(b for _, b in out[-1]) + bits > 8 * pass_bytes:
            out.append([])
        out[-1].append((segment, bits))
    return out


def loaded(built: DataFrame, some: list[tuple[int, int]], segments: int) -> CountFilter:
    """A stretch of the filter, at most the bytes of one pass."""
    if not some:
        return CountFilter(segments, 0, np.empty(0, np.int64), np.empty(0, np.uint8))
    first, last = some[0][0], some[-1][0]
    found = built.filter(F.col("segment").between(first, last)).select("segment", "data").toArrow()
    data = dict(zip(found.column("segment").to_pylist(), found.column("data")))
    bits = np.zeros(last - first + 1, np.int64)
    for segment, n in some:
        bits[segment - first] = n
    return CountFilter(segments, first, bits, np.concatenate([np.frombuffer(data[s].as_buffer(), np.uint8) for s, _ in some]))


def _scan(segments: int, shared, whole: bool):
    """Rows of MOVED. A first pass gives the texts of each part and, for each segment of the exact counts, the part's words; all
    passes give the levels that their stretch of the filter has."""
    to = arrow_schema(MOVED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: CountFilter = shared.value
        for number, part, lengths, every, learnt in _parts(batches):
            words, place = np.unique(every, return_inverse=True)
            pairs, pair_place = np.unique(pair_keys(every), return_inverse=True)
            levels = packed(counts.levels(words, WORD)), packed(counts.levels(pairs, PAIR)[pair_place])
            if whole:
                rows = [(-1 - number, number, 0, lengths, part.column("doc_id").to_pylist(), len(words), packed(place.astype(np.uint32)), *levels)]
                times = np.bincount(place, learnt, len(words)).astype(np.uint32)
                begin = 0
                for segment, end in enumerate(segment_ends(words, segments).tolist()):
                    if end > begin:
                        rows.append((segment, number, WORD, None, None, end - begin, packed(words[begin:end]), packed(times[begin:end]), None))
                    begin = end
            else:
                rows = [(-1 - number, number, LEVELS, None, None, len(words), None, *levels)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), to)], schema=to)

    return run


def _summed():
    """A segment's answers to the parts: for each of a part's words the count in all training texts."""
    to = arrow_schema(MOVED)

    def run(table: pa.Table) -> pa.Table:
        segment = table.column("segment")[0].as_py()
        if segment < 0:
            return table
        parts, sizes = table.column("part").to_numpy(), table.column("n").to_numpy()
        keys = np.concatenate([unpacked(d.as_py(), int(n), np.uint64) for d, n in zip(table.column("data"), sizes)])
        times = np.concatenate([unpacked(d.as_py(), int(n), np.uint32) for d, n in zip(table.column("more"), sizes)])
        found, which = np.unique(keys, return_inverse=True)
        sums = np.bincount(which, times, len(found)).astype(np.int64)
        out = [(segment, int(p), WORD, None, None, len(answer), packed(answer), None, None)
               for p, answer in zip(parts, np.split(sums[which], np.cumsum(sizes)[:-1]))]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), to)], schema=to)

    return run


def log_probabilities(tokens: np.ndarray, pairs: np.ndarray, before: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """log10 P of tokens after the one before, from the counts read for each token, for the pair and for the one before."""
    single = (tokens + 0.5) / (total + 0.5 * (distinct + 1))
    return np.log10(SHARE * np.minimum(pairs, before) / np.maximum(before, 1) + np.where(before > 0, 1 - SHARE, 1.0) * single)


def _scored(total: int, distinct: int):
    """A part's texts with the sums from all segments and the levels from all passes."""
    to = arrow_schema(SCORES)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["segment"]))  # the order of the part's sorted words
        texts, answers = rows[0], [r for r in rows if r["kind"] == WORD]
        exact = np.concatenate([unpacked(r["data"], r["n"], np.int64) for r in answers])
        lengths = np.array(texts["lengths"])
        n = int(lengths.sum())
        place = unpacked(texts["data"], n, np.uint32)
        words, pairs = (np.max([unpacked(r[c], m, np.uint8) for r in rows if r["kind"] != WORD], axis=0) for c, m in (("more", len(exact)), ("pairs", n)))
        read = counts_at(words.astype(np.int64))[place]
        begins = np.append(0, np.cumsum(lengths)[:-1])
        before = np.append(read[lengths[0] - 1], read[:-1])  # a text begins after an end
        own = log_probabilities(read, counts_at(pairs.astype(np.int64)), before, total, distinct)
        known = exact[place]
        base = np.log10(known + 0.5) - math.log10(total + 0.5 * (distinct + 1))
        return pa.Table.from_arrays(
            [pa.array(texts["ids"], pa.int64()), pa.array(lengths, pa.int64()), pa.array(np.add.reduceat((known > 0).astype(np.int64), begins)),
             pa.array(np.full(len(lengths), total, np.int64)), pa.array(np.add.reduceat(base, begins)), pa.array(np.add.reduceat(own, begins))], schema=to)

    return run


def score(docs: DataFrame, fold: Column, item_bits: int = ITEM_BITS, pass_bytes: int = PASS_BYTES, segment_tokens: int = SEGMENT_TOKENS,
          segment_text: int = SEGMENT_TEXT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score (exact counts), score (counts read from the
    filter); log10 probabilities.

    The model learns from the rows that ``fold`` (over doc_id) admits. A null or empty text is one end token; very long texts are
    parts of their own. Rows that repeat an id are scored one by one, and null ids pass through. With no training rows every count
    is 0. An empty table gives an empty one. Other columns are not looked at, whatever their names. The filter gets ``item_bits``
    for each stored level; the other limits say how the work is cut up and change no result.
    """
    rows = keyed(docs, id_col, text_col).withColumn("trained", F.coalesce(fold, F.lit(False)))
    held = rows.agg(F.sum(F.octet_length("text") + 1).alias("n")).first()["n"] or 0
    segments = 1 << max(0, math.ceil(held / TOKEN_TEXT / segment_tokens) - 1).bit_length()
    built = built_filter(rows, segments, item_bits)
    sums = built.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
    total, distinct = (sums[c] or 0 for c in ("tokens", "distinct"))
    cut, context, found = stretches(built, pass_bytes), docs.sparkSession.sparkContext, []
    if len(cut) > 1:
        rows = cut_lineage(rows)  # all passes must cut the texts into the same parts
    for i, some in enumerate(cut):
        shared = context.broadcast(loaded(built, some, segments))
        found.append(rows.mapInArrow(_scan(max(1, -(-held // segment_text)), shared, i == 0), MOVED))
        if len(cut) > 1:
            found[-1] = cut_lineage(found[-1])
            shared.destroy()  # one stretch at a time
    moved = reduce(DataFrame.unionByName, found)
    return moved.groupBy("segment").applyInArrow(_summed(), MOVED).groupBy("part").applyInArrow(_scored(total, distinct), SCORES)
