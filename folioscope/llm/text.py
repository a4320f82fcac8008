"""Words, hashes and sub-batches shared by the training-text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: Lower-cases A-Z only; every other byte stays.
ASCII_LOWER = bytes.maketrans(UPPER, LOWER)
#: Lower-cases A-Z and blanks every ASCII byte that is neither a letter nor a digit.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(ASCII_LOWER)


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


def space_words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return encoded(text).translate(ASCII_LOWER).split()


def letter_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return encoded(text).translate(WORD_BYTES).split()


class WordHashes(dict):
    """Word to 64-bit hash, remembered up to a fixed number of words."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def scrambled(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers without visible structure."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words; of the whole sequence if it is shorter, nothing if it is empty."""
    if not len(words):
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = (out + words[j:j + n]) * np.uint64(0xA24BAED4963EE407)
        out ^= out >> np.uint64(33)
    return scrambled(out)


def parts_of(batch: pa.RecordBatch, text_col: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text, so that a batch of long texts is worked off in parts."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    begin = 0
    while begin < batch.num_rows:
        held = np.cumsum(sizes[begin:])
        n = max(1, int(np.searchsorted(held, most, "right")))
        yield batch.slice(begin, n)
        begin += n


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text, under fixed names; other columns cannot clash with anything."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where a column of ``docs`` has one already."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def arrow_schema(ddl: str) -> pa.Schema:
    """For the driver: workers cannot parse DDL."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def release(freed: bool = True) -> None:
    """Gives the memory that Arrow's pool, and with ``freed`` also the C library, holds without use back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if freed else None  # glibc only
    if trim is not None:
        trim(0)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with unused memory given back as it goes and at its end.

    A worker process lives on between tasks and stages, next to the executor's heap; what it keeps is missing there.
    """
    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            release(freed=False)
        release()

    return freed


def map_texts(rows: DataFrame, make: Callable[[], Callable[[list], dict]], columns: str) -> DataFrame:
    """doc_id and, per row of ``keyed``, the ``columns`` that the function from ``make`` returns for a list of texts.

    ``make`` runs once per task. Ids pass through untouched, so null and very large ones stay exact.
    """
    schema = f"doc_id bigint, {columns}"
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in parts_of(batch):
                found = fn(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(found[f.name], f.type) for f in list(to)[1:])], schema=to)

    return rows.select("doc_id", "text").mapInArrow(freeing(run), schema)
