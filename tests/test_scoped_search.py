"""Search within groups under the groups' limits."""

import random

from folioscope.operators import catalog, scoped_search
from folioscope.session import scratch_path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_groups_are_pruned_and_limits_are_those_of_the_group(spark):
    rng = random.Random(1)
    chunks = [(f"c{i:03}", f"g{i % 4}", i // 9) for i in range(180)] + [("no_group", None, 99)]
    vectors = [(c, t, round(rng.random(), 3)) for c, _, _ in chunks for t in rng.sample("abcdefgh", 4)]
    asked = [(q, f"g{q % 5}", t, round(rng.random(), 3)) for q in range(9) for t in rng.sample("abcdefgh", 3)] + [(100, None, "a", 1.0)]
    path = scratch_path(spark, "vectors")
    scoped_search.write_group_vectors(spark.createDataFrame(vectors, "chunk_id string, term string, w double"),
                                      spark.createDataFrame(chunks, "chunk_id string, group_id string, doc_id long"), path)
    settings = spark.createDataFrame([("g0", None, 1, 4, 0.3, None), ("g1", None, 50, 90, 0.0, None), ("default", "x", 2, None, 0.5, None)],
                                     "group_id string, provider string, chunks_per_doc int, max_total_chunks int, similarity_threshold double, default_language string")
    limits = catalog.resolve_settings(spark.createDataFrame([(f"g{i}",) for i in range(5)], "group_id string"), settings)
    q = spark.createDataFrame(asked, "query_id long, group_id string, term string, qw double")
    got = scoped_search.capped_by_group(scoped_search.scoped_scores(scoped_search.read_group_vectors(spark, path, q), q), limits)

    given = {"g0": (1, 4, 0.3), "g1": (20, 50, 0.0)}
    want = []
    for query in {a[0] for a in asked}:
        mine = {t: (g, w) for i, g, t, w in asked if i == query}
        group = next(iter(mine.values()))[0]
        per_doc, total, least = given.get(group, (2, 10, 0.5))
        weight = {(c, t): w for c, t, w in vectors}
        score = {}
        for c, g, d in chunks:
            if g is not None and g == group and any((c, t) in weight for t in mine):
                score[c] = (round(sum(weight.get((c, t), 0) * w for t, (_, w) in mine.items()), 6), d)
        rows, seen = [], {}
        for c, (s, d) in sorted(score.items(), key=lambda x: (-x[1][0], x[0])):
            if s >= least and seen.get(d, 0) < per_doc:
                seen[d] = seen.get(d, 0) + 1
                rows.append((query, group, d, c, s, seen[d], len(rows) + 1))
        want += rows[:total]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 60
    one = q.filter("query_id = 1")
    text = plan(scoped_search.read_group_vectors(spark, path, one))
    assert "PartitionFilters: [group_id" in text.replace("PartitionFilters: [isnotnull(group_id", "PartitionFilters: [group_id")
    assert plan(got).count("WindowGroupLimit") >= 2


def test_many_groups_read_all(spark, monkeypatch):
    monkeypatch.setattr(scoped_search, "MOST_GROUPS", 2)
    path = scratch_path(spark, "vectors")
    rows = [(f"c{i}", "t", 1.0) for i in range(6)]
    scoped_search.write_group_vectors(spark.createDataFrame(rows, "chunk_id string, term string, w double"),
                                      spark.createDataFrame([(f"c{i}", f"g{i}", i) for i in range(6)], "chunk_id string, group_id string, doc_id long"), path)
    asked = spark.createDataFrame([(i, f"g{i}", "t", 0.5) for i in range(4)], "query_id long, group_id string, term string, qw double")
    found = scoped_search.scoped_scores(scoped_search.read_group_vectors(spark, path, asked), asked).collect()
    assert sorted((r.query_id, r.chunk_id, r.score) for r in found) == [(i, f"c{i}", 0.5) for i in range(4)]
