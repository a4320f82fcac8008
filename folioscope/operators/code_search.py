"""Approximate nearest vectors from stored codes: probes join the codes, candidates are scored exactly."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folioscope.operators.windows import top_k
from folioscope.session import cut_lineage, scratch_path
from folioscope.sources.vector_codes import MOST_K, PARTS, VectorCodes, planes, read_codes, unit_rows, write_codes


def probes(store: VectorCodes, queries: DataFrame, per_table: int = 8) -> DataFrame:
    """query_id, q (unit vector), slots: each table's code of the question and the codes next to it.

    Codes differ from the question's in one or two planes, those it lies closest to first.
    """
    kind = dict(queries.dtypes)["query_id"]
    schema = StructType.fromDDL(f"query_id {kind}, q array<double>, slots array<int>")
    to = to_arrow_schema(schema)
    dim, tables, bits, seed = store.dim, store.tables, store.bits, store.seed
    flips = [()] + [f for n in (1, 2) for f in combinations(range(bits), n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals, powers = planes(dim, tables, bits, seed), 1 << np.arange(bits)
        mask = np.array([[i in f for i in range(bits)] for f in flips])
        bit = mask @ powers
        for batch in batches:
            m, rows = unit_rows(batch.column("embedding"), dim)
            side = (m @ normals).reshape(-1, tables, bits)
            code = ((side > 0) * powers).sum(axis=2)
            away = np.argsort((side * side) @ mask.T, axis=2, kind="stable")[:, :, :per_table]
            slots = (code[:, :, None] ^ bit[away]) + (np.arange(tables) * (1 << bits))[None, :, None]
            n = slots.shape[1] * slots.shape[2]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * n, pa.int32()), pa.array(slots.reshape(-1).astype(np.int32)))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * dim, pa.int32()), pa.array(m.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(rows)), vectors.cast(to.field("q").type),
                                              lists.cast(to.field("slots").type)], schema=to)

    return queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, schema)


def in_slots(store: VectorCodes, wanted: DataFrame) -> DataFrame:
    """The codes in the folders that ``wanted`` (slot) names; the driver gets a number for each folder at most."""
    return store.codes.filter(F.col("slot").isin([r["slot"] for r in wanted.select("slot").distinct().collect()]))


def _scored(pairs: DataFrame) -> DataFrame:
    """query_id, key, score from pairs with both unit vectors."""
    schema = StructType([f for f in pairs.schema.fields if f.name in ("query_id", "key")] + StructType.fromDDL("score double").fields)
    to = to_arrow_schema(schema)
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("q", "embedding"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.round((a * b).sum(axis=1), 6))], schema=to)

    return pairs.select(*names, "q", "embedding").mapInArrow(run, schema)


def nearest_by_codes(store: VectorCodes, queries: DataFrame, k: int = 10, per_table: int = 8) -> DataFrame:
    """query_id, vec_id, score (cosine), rank: the best among the vectors that share a probed code with the question.

    The scan of codes and vectors reads the probed folders and the candidates' ones. A question whose probes meet fewer than
    ``k`` vectors probes every code, so it gets k results where there are as many vectors. Questions without a direction have none.
    """
    if not 0 < k <= MOST_K:
        raise ValueError(f"k is not between 1 and {MOST_K}")
    asked = cut_lineage(probes(store, queries, per_table))

    def found(some: DataFrame, slots) -> DataFrame:
        wanted = some.select("query_id", F.explode(slots).alias("slot"))
        candidates = cut_lineage(wanted.join(in_slots(store, wanted), "slot").select("query_id", "key").distinct())
        part = F.pmod(F.col("key.x"), F.lit(PARTS)).cast("int")
        pairs = candidates.withColumn("part", part).join(store.vectors, ["part", "key"]).join(some.select("query_id", "q"), "query_id")
        # k distinct vectors are enough: each has one id at least, and ties of equal vectors are settled by id below.
        scored = _scored(pairs)
        worst = top_k(scored, ["query_id"], [F.desc("score"), F.col("key")], k).groupBy("query_id").agg(F.min("score").alias("least"))
        best = scored.join(worst, "query_id").filter("score >= least").withColumn("part", part)
        ids = store.ids.filter(F.col("nth") <= k)
        return top_k(best.join(ids, ["part", "key"]).select("query_id", "vec_id", "score"), ["query_id"], [F.desc("score"), F.col("vec_id")], k)

    near = cut_lineage(found(asked, F.col("slots")))
    full = near.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    short = cut_lineage(asked.join(full, "query_id", "left_anti"))
    if short.isEmpty():
        return near
    every = F.sequence(F.lit(0), F.lit((1 << store.bits) - 1))  # the codes of one table hold all vectors
    return near.join(short.select("query_id"), "query_id", "left_anti").unionByName(found(short, every))


def knn_ann(vectors: DataFrame, queries: DataFrame, k: int = 10, **shape) -> DataFrame:
    """``nearest_by_codes`` from codes written for this search; ``shape`` goes to ``write_codes``."""
    spark, path = vectors.sparkSession, scratch_path(vectors.sparkSession, "codes")
    write_codes(vectors, path, **shape)
    store = read_codes(spark, path)
    if store is None:
        kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["vec_id"]
        return spark.createDataFrame([], f"query_id {kinds[0]}, vec_id {kinds[1]}, score double, rank int")
    return nearest_by_codes(store, queries, k)
