"""Exact duplicates by a cuckoo-filter index over live text digests.

Every text is reduced to its SHA-256 inside the scan, so texts are never shuffled. Each scan task folds its rows into
an index of live digests (map-side combine: a group that holds a third of all rows leaves a task as one row), the
folded rows meet by digest, and a second index merges them. The group table joins back to the rows by digest; Spark's
skew join splits a hot digest there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.text import arrow_schema, freeing, fresh

SLOTS = 4
KICKS = 200


class CuckooIndex:
    """Live digests: a cuckoo filter of 16-bit fingerprints before exact buckets of full digests.

    ``get`` asks the filter first; only a hit looks into the digest's home bucket, where the whole digest must be equal.
    ``delete`` takes a live digest's fingerprint out again. If an insertion finds no slot after ``KICKS`` moves, the
    table is doubled and filled anew from the stored digests, so nothing is ever lost.
    """

    def __init__(self, buckets: int = 1024):
        self._clear(buckets)
        self.content: dict[int, dict[bytes, object]] = {}
        self.size = 0
        self.resizes = 0

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.slots = [0] * (buckets * SLOTS)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        """Fingerprint (never 0), home bucket, other bucket."""
        mark = int.from_bytes(digest[:2], "big") or 1
        home = int.from_bytes(digest[2:10], "big") & (self.buckets - 1)
        return mark, home, self._other(home, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & (self.buckets - 1))

    def _put(self, bucket: int, mark: int) -> bool:
        at = bucket * SLOTS
        for i in range(at, at + SLOTS):
            if not self.slots[i]:
                self.slots[i] = mark
                return True
        return False

    def _add_mark(self, digest: bytes) -> bool:
        mark, home, other = self._places(digest)
        if self._put(home, mark) or self._put(other, mark):
            return True
        bucket = other
        for kick in range(KICKS):
            at = bucket * SLOTS + (mark + kick) % SLOTS
            mark, self.slots[at] = self.slots[at], mark
            bucket = self._other(bucket, mark)
            if self._put(bucket, mark):
                return True
        return False

    def _grow(self) -> None:
        digests = [d for bucket in self.content.values() for d in bucket]
        buckets = self.buckets
        while True:
            buckets *= 2
            self.resizes += 1
            self._clear(buckets)
            if all(map(self._add_mark, digests)):
                break
        old, self.content = self.content, {}
        for bucket in old.values():
            for d, value in bucket.items():
                self.content.setdefault(self._places(d)[1], {})[d] = value

    def _maybe(self, digest: bytes) -> int | None:
        """The home bucket if the filter may hold the digest."""
        mark, home, other = self._places(digest)
        s, a, b = self.slots, home * SLOTS, other * SLOTS
        return home if mark in s[a:a + SLOTS] or mark in s[b:b + SLOTS] else None

    def get(self, digest: bytes):
        home = self._maybe(digest)
        return None if home is None else self.content.get(home, {}).get(digest)

    def insert(self, digest: bytes, value) -> None:
        """Makes a digest live. It must not be live already."""
        self.content.setdefault(self._places(digest)[1], {})[digest] = value
        self.size += 1
        if self.size > self.buckets * SLOTS * 0.95 or not self._add_mark(digest):
            self._grow()

    def delete(self, digest: bytes) -> bool:
        home = self._maybe(digest)
        if home is None or digest not in self.content.get(home, {}):
            return False
        mark, home, other = self._places(digest)
        for i in (*range(home * SLOTS, home * SLOTS + SLOTS), *range(other * SLOTS, other * SLOTS + SLOTS)):
            if self.slots[i] == mark:
                self.slots[i] = 0
                break
        del self.content[home][digest]
        if not self.content[home]:
            del self.content[home]
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for bucket in self.content.values():
            yield from bucket.items()


FOLDED = "digest binary, best bigint, n bigint"


def _folded(rows: DataFrame) -> DataFrame:
    """Rows (digest, best, n) with one row for each digest of a partition.

    A row that joins a live digest has the old entry deleted; the higher ranked of the two ids goes in with both counts.
    """
    to = arrow_schema(FOLDED)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for digest, best, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "best", "n"))):
                live = index.get(digest)
                if live is not None:
                    index.delete(digest)
                    best = max((x for x in (best, live[0]) if x is not None), default=None)
                    n += live[1]
                index.insert(digest, (best, n))
        items = index.items()
        while rows := list(islice(items, 50_000)):
            yield pa.RecordBatch.from_pylist([{"digest": d, "best": b, "n": n} for d, (b, n) in rows], to)

    return rows.mapInArrow(freeing(fold), FOLDED)


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: digest (binary SHA-256), keep_id (largest id), group_size."""
    rows = docs.select(_digest(text_col).alias("digest"), F.col(id_col).cast("bigint").alias("best"),
                       F.lit(1).cast("bigint").alias("n"))
    return (_folded(_folded(rows).repartition("digest"))
            .select("digest", F.col("best").alias("keep_id"), F.col("n").alias("group_size")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical; null counts as empty. The row with the largest id stays. A null id ranks
    below all others. Rows that repeat an id with the same text are copies like any other: exactly one of them is kept.
    Very long texts are hashed whole. An empty table gives an empty result; other columns are not looked at.
    """
    rows = (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _digest(text_col).alias("digest"))
            .groupBy("digest", "doc_id").agg(F.count("*").cast("int").alias("times")))
    joined = rows.join(exact_groups(docs, id_col, text_col), "digest")
    return (joined.withColumn("nth", F.explode(F.sequence(F.lit(1), "times")))
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def keep_largest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Of rows that also share the id, one stays.

    The join key holds the id besides the digest, so a digest with very many copies is spread over all tasks.
    """
    of, own, digest, keep = fresh(docs, "_of", "_id", "_digest", "_keep")
    groups = exact_groups(docs, id_col, text_col).select(F.col("digest").alias(digest), F.col("keep_id").alias(keep))
    rows = docs.withColumn(of, _digest(text_col)).withColumn(own, F.col(id_col).cast("bigint"))
    kept = rows.join(groups, (F.col(of) == F.col(digest)) & F.col(own).eqNullSafe(F.col(keep)))
    return kept.dropDuplicates([of, own]).select(*docs.columns)
