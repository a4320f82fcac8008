"""Counts of a long list of phrases in whole texts.

The list is split into shards of bounded size. A shard is a trie over characters in three sorted arrays, broadcast for one pass
over the texts; in a task all places of many texts walk down the trie together, a place dropping out at the first character that
no phrase goes on with. Nothing is shuffled but the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folioscope.session import cut_lineage

#: Characters of all phrases of a shard, and of the texts that walk together.
SHARD_CHARS, TEXT_CHARS = 2_000_000, 1_000_000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass(frozen=True)
class PhraseTrie:
    phrases: list[str]
    alphabet: np.ndarray
    edges: np.ndarray  # node * letters + letter, ascending
    children: np.ndarray
    ends: np.ndarray  # the phrase that ends at a node, or -1

    @staticmethod
    def of(phrases: list[str]) -> "PhraseTrie":
        """The trie of distinct phrases that are not empty, built a character at a time for all of them."""
        codes = [_codes(p) for p in phrases]
        size = np.array([len(c) for c in codes], np.int64)
        flat = np.concatenate([*codes, np.empty(0, np.uint32)])
        begin = np.cumsum(size) - size
        alphabet, letter = np.unique(flat, return_inverse=True)
        node, of = np.zeros(len(phrases), np.int64), np.arange(len(phrases))
        edges, children, at, n = [], [], 0, 1
        end = {}
        while len(of):
            done = size[of] == at
            end.update(zip(node[of[done]].tolist(), of[done].tolist()))
            of = of[~done]
            keys, which = np.unique(node[of] * len(alphabet) + letter[begin[of] + at], return_inverse=True)
            edges.append(keys)
            children.append(n + np.arange(len(keys)))
            node[of] = n + which
            n, at = n + len(keys), at + 1
        ends = np.full(n, -1, np.int64)
        ends[list(end)] = list(end.values())
        keys, kids = np.concatenate([*edges, np.empty(0, np.int64)]), np.concatenate([*children, np.empty(0, np.int64)])
        order = np.argsort(keys)
        return PhraseTrie(phrases, alphabet, keys[order].astype(np.int64), kids[order].astype(np.int64), ends)

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, phrase) of every occurrence, overlapping ones too; places count in the texts in a row."""
        codes = [_codes(t) for t in texts]
        size = np.array([len(c) + 1 for c in codes], np.int64)
        wall = np.array([0xFFFFFFFF], np.uint32)  # no character; stands after each text
        flat = np.concatenate([x for c in codes for x in (c, wall)] or [wall])
        known = np.minimum(np.searchsorted(self.alphabet, flat), max(0, len(self.alphabet) - 1))
        letter = np.where(self.alphabet[known] == flat, known, -1) if len(self.alphabet) else np.full(len(flat), -1)
        at, node, places, found, depth = np.arange(len(flat)), np.zeros(len(flat), np.int64), [], [], 0
        while len(at) and len(self.edges):
            step = letter[at + depth]  # a walk ends at the wall, so never beyond the last one
            key = node * len(self.alphabet) + step
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            on = (step >= 0) & (self.edges[edge] == key)
            at, node, depth = at[on], self.children[edge[on]], depth + 1
            end = self.ends[node]
            places.append(at[end >= 0])
            found.append(end[end >= 0])
        place, phrase = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (places, found))
        return np.searchsorted(np.cumsum(size), place, "right"), place, phrase

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, phrase, n): how often each phrase occurs in each text, from the left and without overlaps of one phrase."""
        text, place, phrase = self.hits(texts)
        order = np.lexsort((place, phrase, text))
        text, place, phrase = text[order], place[order], phrase[order]
        size = np.array([len(p) for p in self.phrases] + [0], np.int64)[phrase]
        same = np.append(False, (text[1:] == text[:-1]) & (phrase[1:] == phrase[:-1]))
        close = same & (np.append(0, place[1:] - place[:-1]) < size)
        keep = np.ones(len(place), bool)
        last = -1
        for i in np.flatnonzero(close).tolist():  # only phrases that overlap themselves
            if not close[i - 1]:
                last = place[i - 1]
            keep[i] = place[i] >= last + size[i]
            if keep[i]:
                last = place[i]
        pairs, n = np.unique(np.stack([text[keep], phrase[keep]], 1), axis=0, return_counts=True)
        return pairs[:, 0], pairs[:, 1], n


def _shards(phrases: DataFrame, shard_chars: int) -> Iterator[list[str]]:
    """The list in parts that the driver can hold and send."""
    held = cut_lineage(phrases.select(F.lower("phrase").alias("phrase")).filter("phrase <> ''").distinct())
    size = held.agg(F.sum(F.length("phrase")).alias("n")).first()["n"] or 0
    shards = max(1, math.ceil(size / shard_chars))
    for i in range(shards):
        rows = held.filter(F.pmod(F.xxhash64("phrase"), F.lit(shards)) == i).collect()  # bounded by the shard's size
        if rows:
            yield [r["phrase"] for r in rows]


def phrase_list_scan(docs: DataFrame, key: str, phrases: DataFrame, text: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """key, phrase, n: case-blind occurrences of each phrase of a list of any length, from the left, not overlapping themselves.

    ``phrases``: phrase. Each phrase is counted by itself, whatever other phrases it overlaps. Both sides are lower-cased by
    Spark; phrases that are then alike count once, empty and null ones not at all; texts may be null, empty or very long.
    """
    spark = docs.sparkSession
    schema = StructType([docs.schema[key], *StructType.fromDDL("phrase string, n bigint").fields])
    to = to_arrow_schema(schema)
    rows = docs.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    out = spark.createDataFrame([], schema)
    for shard in _shards(phrases, shard_chars):
        shared = spark.sparkContext.broadcast(PhraseTrie.of(shard))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie = shared.value
            names = pa.array(trie.phrases, to.field("phrase").type)
            for batch in batches:
                begin, texts = 0, batch.column("_text")
                while begin < batch.num_rows:
                    end, held = begin, 0
                    while end < batch.num_rows and (end == begin or held < TEXT_CHARS):
                        held += len(texts[end].as_py())
                        end += 1
                    doc, phrase, n = trie.counts(texts.slice(begin, end - begin).to_pylist())
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(doc + begin)), names.take(pa.array(phrase)), pa.array(n, pa.int64())], schema=to)
                    begin = end

        out = out.unionByName(rows.mapInArrow(scan, schema))
    return out.groupBy(key, "phrase").agg(F.sum("n").alias("n"))
