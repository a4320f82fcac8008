"""Stored hyperplane codes of vectors: which vectors share a code, for approximate search without a scan.

A folder of Parquet tables, written once:

* ``vectors``: key, embedding (unit length) — one row per distinct vector, in folders by ``part`` of the key;
* ``ids``: key, nth, vec_id — the vectors' ids in order, up to ``MOST_K`` of one and the same vector;
* ``codes``: key in folders by ``slot``, one per table and code, for each of ``tables`` sets of random planes;
* ``shape``: one row with dim, tables, bits and seed.

Equal vectors have one row in each table, so a vector with very many copies is one candidate. Zero vectors are near to nothing
and are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folioscope.operators.windows import top_k
from folioscope.session import cut_lineage

#: Ids of equal vectors that a search can return.
MOST_K = 1000
#: Folders of the vectors, and of codes in one table at most.
PARTS, MOST_BITS = 32, 8


@dataclass(frozen=True)
class VectorCodes:
    vectors: DataFrame
    ids: DataFrame
    codes: DataFrame
    dim: int
    tables: int
    bits: int
    seed: int


def planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, tables * bits))


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, which rows they are); null, zero and not finite vectors have none."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if ((size != dim) & (size != 0)).any():
        raise ValueError(f"a vector has not {dim} dimensions")
    rows = np.flatnonzero(size == dim) if dim else np.empty(0, np.int64)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(rows), dim)
    with np.errstate(invalid="ignore"):
        norm = np.linalg.norm(m, axis=1)
    some = np.isfinite(norm) & (norm > 0)
    return m[some] / norm[some, None], rows[some]


def _keyed(vectors: DataFrame) -> DataFrame:
    """Rows with a key of 128 bits of the vector's numbers, as they are."""
    numbers = F.col("embedding").cast("array<double>")
    return vectors.filter("vec_id is not null").select("vec_id", numbers.alias("embedding")).withColumn(
        "key", F.struct(F.xxhash64("embedding").alias("x"), F.xxhash64(F.lit(1), F.reverse("embedding")).alias("y")))


def write_codes(vectors: DataFrame, path: str, tables: int = 12, bits: int | None = None, seed: int = 7) -> None:
    """Writes the codes of ``vectors`` (vec_id of any type, embedding). Without ``bits`` a code holds some hundreds of vectors,
    or 2^-8 of all beyond 50,000. Rows without an id are left out."""
    spark = vectors.sparkSession
    keyed = cut_lineage(_keyed(vectors))
    # Equal vectors are folded before they are shuffled; only their first ids are kept apart.
    distinct = keyed.groupBy("key").agg(F.first("embedding").alias("embedding"))
    ids = top_k(keyed.select("key", "vec_id"), ["key"], [F.col("vec_id")], MOST_K, "nth")
    part = F.pmod(F.col("key.x"), F.lit(PARTS)).cast("int")
    first = keyed.filter(F.size("embedding") > 0).select(F.size("embedding")).first()
    dim = first[0] if first else 0
    to = to_arrow_schema(StructType.fromDDL("key struct<x: bigint, y: bigint>, embedding array<double>"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, rows = unit_rows(batch.column("embedding"), dim)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * dim, pa.int32()), pa.array(m.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows)), lists.cast(to.field("embedding").type)], schema=to)

    distinct.mapInArrow(unit, "key struct<x: bigint, y: bigint>, embedding array<double>").withColumn("part", part).write.partitionBy("part").parquet(f"{path}/vectors")
    ids.withColumn("part", part).write.partitionBy("part").parquet(f"{path}/ids")
    held = spark.read.parquet(f"{path}/vectors") if dim else keyed.limit(0).withColumn("part", F.lit(0))
    n = held.count()
    bits = bits if bits is not None else min(MOST_BITS, max(1, round(math.log2(max(n, 2) / 200)) if n > 400 else 1))
    code_schema = "key struct<x: bigint, y: bigint>, slot int"
    code_to = to_arrow_schema(StructType.fromDDL(code_schema))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals, powers = planes(dim, tables, bits, seed), 1 << np.arange(bits)
        for batch in batches:
            m, rows = unit_rows(batch.column("embedding"), dim)
            code = ((m @ normals > 0).reshape(-1, tables, bits) * powers).sum(axis=2) + np.arange(tables) * (1 << bits)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(np.repeat(rows, tables))),
                                              pa.array(code.reshape(-1).astype(np.int32))], schema=code_to)

    codes = held.select("key", "embedding").mapInArrow(coded, code_schema)
    codes.repartitionByRange("slot", "key").sortWithinPartitions("slot").write.partitionBy("slot").parquet(f"{path}/codes")
    spark.createDataFrame([(dim, tables, bits, seed)], "dim int, tables int, bits int, seed int").coalesce(1).write.parquet(f"{path}/shape")


def read_codes(spark: SparkSession, path: str) -> VectorCodes | None:
    """None if there are no vectors that a search could find."""
    shape = spark.read.parquet(f"{path}/shape").first()  # one row
    if not shape["dim"]:
        return None
    return VectorCodes(*(spark.read.parquet(f"{path}/{t}") for t in ("vectors", "ids", "codes")), *shape)
