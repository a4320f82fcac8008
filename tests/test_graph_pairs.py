"""The whole graph as rows: every pair of chunks that share a keyword is an edge, once, and wins over other kinds."""

import itertools

import pytest
from pyspark.sql import functions as F

from folioscope.operators import graph
from folioscope.plans import graph_plans


@pytest.mark.parametrize("lane", [2048, 2])
def test_keyword_pairs_are_edges(spark, monkeypatch, lane):
    monkeypatch.setattr(graph, "LANE", lane)
    words = {"1_0": ["a", "b"], "1_1": ["a", "b"], "1_2": ["b"], "1_3": ["c"], "1_4": [], "2_0": ["a"], "2_1": ["a", "z"], "2_2": ["z"]}
    rows = [(int(k[0]), int(k[2]), k, "text", ["S"], "S") for k in words]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, chunk_id string, chunk_text string, path_parts array<string>, section_title string")
    hubs = graph.keyword_hubs(chunks, spark.createDataFrame(list(words.items()), "chunk_id string, keywords array<string>"))
    refs = spark.createDataFrame([("1_0", "2_0"), ("1_2", "1_1")], "src string, dst string")
    adjacent, reference = graph.edges_adjacent(chunks), graph.edges_reference(refs, graph.graph_nodes(chunks))
    edges = graph.edges_final(graph.edges_hierarchical(chunks), graph.edges_contains(chunks), reference, adjacent, hubs, pairs=True)
    got = sorted((r.src, r.dst, r.type, r.weight) for r in edges.filter(~F.col("type").isin("hierarchical", "contains")).collect())
    want = {("1_0", "2_0"): ("reference", 0.8), ("1_2", "1_1"): ("reference", 0.8)}
    for a, b in itertools.permutations(words, 2):
        if a[0] == b[0] and abs(int(a[2]) - int(b[2])) == 1:
            want[a, b] = ("adjacent", 0.4)
        if a[0] == b[0] and set(words[a]) & set(words[b]):
            want[a, b] = ("keyword", 0.3)
    assert got == sorted((a, b, *kind) for (a, b), kind in want.items())


def test_the_query_gives_pairs_of_chunks(spark, tmp_path):
    body = "Red Fox Jumped over the Lazy Dog and the Grey Wolf sat near it. " * 40
    rows = [(1, f"Title One\n\n{body}", "src1", "en"), (2, "Short text about nothing at all", "src1", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    g = graph_plans.build(spark, str(tmp_path), keep=True)
    chunks = {r.chunk_id for r in g.chunks.collect()}
    shared = graph.keyword_edges(g.hubs).count()
    found = graph_plans._final(spark, str(tmp_path)).filter("type = 'keyword'").collect()
    assert found and len(found) == shared and all({r.src, r.dst} <= chunks for r in found)
