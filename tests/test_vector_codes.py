"""Stored vector codes: recall, folders read, copies, ids of either type, and questions that meet too few vectors."""

import numpy as np
import pytest

from folioscope.operators import code_search, search
from folioscope.session import scratch_path
from folioscope.sources import vector_codes


def table(spark, m, ids, kind):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, m)], f"vec_id {kind}, embedding array<float>")


def asked(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "query_id long, embedding array<double>")


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 24))
    return centres[rng.integers(0, 40, 4000)] + 0.5 * rng.standard_normal((4000, 24)), centres[:25] + 0.5 * rng.standard_normal((25, 24))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_recall_and_exact_scores(spark, clouds, kind):
    base, queries = clouds
    ids = list(range(len(base))) if kind == "long" else [f"v{i}" for i in range(len(base))]
    vectors, q = table(spark, base, ids, kind), asked(spark, queries)
    path = scratch_path(spark, "codes")
    vector_codes.write_codes(vectors, path)
    got = {(r.query_id, r.vec_id): r.score for r in code_search.nearest_by_codes(vector_codes.read_codes(spark, path), q).collect()}
    want = {(r.query_id, r.vec_id): r.score for r in search.knn_exact(vectors, q).collect()}
    assert len(got) == len(want) == 250 and len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(abs(got[p] - want[p]) < 2e-6 for p in got.keys() & want.keys())


def test_probes_read_their_folders_only(spark, clouds):
    base, queries = clouds
    path = scratch_path(spark, "codes")
    vector_codes.write_codes(table(spark, base, range(len(base)), "long"), path, tables=4, bits=6)
    store = vector_codes.read_codes(spark, path)
    probed = code_search.probes(store, asked(spark, queries[:1]), per_table=3).collect()[0].slots
    assert len(set(probed)) == 12 and sorted({s // 64 for s in probed}) == [0, 1, 2, 3]
    wanted = spark.createDataFrame([(s,) for s in probed], "slot int")
    near = code_search.in_slots(store, wanted)
    text = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [slot#" in text
    assert set(r.slot for r in near.select("slot").distinct().collect()) <= set(probed)
    n = store.codes.join(wanted, "slot").count()
    assert n < 0.3 * store.codes.count() and store.codes.count() == 4 * len(base)


def test_copies_ties_zero_null_and_too_few(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 6))
    rows = [(i, base[i].tolist()) for i in range(30)] + [(1000 - i, [1.0] + [0.0] * 5) for i in range(500)]
    rows += [(2000, [2.0] + [0.0] * 5), (3000, [0.0] * 6), (3001, None), (None, [1.0] * 6), (3002, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [3.0] + [0.0] * 5), (2, [0.0] * 6), (3, base[7].tolist()), (4, None)], "query_id long, embedding array<double>")
    path = scratch_path(spark, "codes")
    vector_codes.write_codes(vectors, path, tables=2, bits=5)
    store = vector_codes.read_codes(spark, path)
    assert store.vectors.count() == 32
    got = code_search.nearest_by_codes(store, q, 10).collect()
    first = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == 1)
    assert first == [(i + 1, 501 + i, 1.0) for i in range(10)]
    assert {r.query_id for r in got} == {1, 3} and [r.vec_id for r in got if r.query_id == 3 and r.rank == 1] == [7]
    assert sum(r.query_id == 3 for r in got) == 10
    some = code_search.nearest_by_codes(store, q.filter("query_id = 3"), 1000).collect()
    exact = search.knn_exact(vectors.filter("vec_id is not null and size(embedding) = 6"), q.filter("query_id = 3"), 1000).collect()
    assert sorted((r.rank, r.vec_id) for r in some) == sorted((r.rank, r.vec_id) for r in exact)
    with pytest.raises(ValueError):
        code_search.nearest_by_codes(store, q, 5000)


def test_empty_table(spark):
    none = spark.createDataFrame([], "vec_id string, embedding array<float>")
    assert code_search.knn_ann(none, spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")).count() == 0
