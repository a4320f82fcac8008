"""Graph operators on a small random graph against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import graph, graph_walks
from folioscope.operators.windows import with_neighbours


@pytest.fixture(scope="module")
def small(spark):
    rnd = random.Random(11)
    rows, kws = [], []
    for d in range(4):
        for i in range(6):
            title = rnd.choice(["S1", "S2"])
            rows.append((d, i, f"{d}_{i}", f"text {d} {i}", ["en", title], title))
            kws.append((f"{d}_{i}", sorted(rnd.sample(["k1", "k2", "k3", "k4", "k5"], rnd.choice([0, 0, 1, 2])))))
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, chunk_id string, chunk_text string, path_parts array<string>, section_title string")
    keywords = spark.createDataFrame(kws, "chunk_id string, keywords array<string>")
    refs = spark.createDataFrame([("0_0", "1_1"), ("1_1", "0_0"), ("2_3", "1_1"), ("2_3", "gone"), ("3_0", "2_3"), ("0_0", "0_1")], "src string, dst string")
    nodes = graph.graph_nodes(chunks)
    reference, adjacent = graph.edges_reference(refs, nodes), graph.edges_adjacent(chunks)
    hubs = graph.keyword_hubs(chunks, keywords).cache()
    edges = graph.edges_final(graph.edges_hierarchical(chunks), graph.edges_contains(chunks), reference, adjacent, hubs).cache()
    # the same graph with every keyword pair written out
    full = {(r.src, r.dst): r.weight for r in edges.collect()}
    written = set(full)
    by_hub = {}
    for r in hubs.collect():
        by_hub.setdefault(r.hub, set()).add(r.chunk_id)
    for members in by_hub.values():
        for a, b in itertools.permutations(members, 2):
            assert (a, b) not in written  # keyword wins over adjacent and reference
            full[(a, b)] = 0.3
    return dict(chunks=chunks, nodes=nodes.cache(), edges=edges, hubs=hubs, adjacent=adjacent, full=full,
                ids=[r.id for r in nodes.collect()])


def distances(full, ids, start):
    best = {start: 0.0}
    for _ in ids:
        for (a, b), w in full.items():
            if a in best and best[a] + w < best.get(b, 1e9) - 1e-9:
                best[b] = best[a] + w
    return best


def test_keyword_degree(small):
    want = {}
    for (a, b), w in small["full"].items():
        if w == 0.3:
            want[a] = want.get(a, 0) + 1
    assert {r.chunk_id: r.degree for r in graph.keyword_degree(small["hubs"]).collect()} == want


def test_shortest_paths(spark, small):
    seeds = spark.createDataFrame([("0_0",), ("3_2",)], "chunk_id string")
    got = {(r.seed, r.id): round(r.distance, 6) for r in graph_walks.shortest_paths(seeds, small["edges"], small["hubs"]).collect()}
    want = {(s, n): round(d, 6) for s in ("0_0", "3_2") for n, d in distances(small["full"], small["ids"], s).items()}
    assert got == want


def test_k_hop(spark, small):
    got = {r.id for r in graph_walks.k_hop(spark.createDataFrame([("1_1",)], "id string"), small["edges"], small["hubs"]).collect()}
    want = set()
    for flip in (False, True):
        seen = {"1_1"}
        for _ in range(2):
            seen |= {(a if flip else b) for a, b in small["full"] if (b if flip else a) in seen}
        want |= seen
    assert got == want


def test_components(small):
    reach = {n: set(distances(small["full"], small["ids"], n)) for n in small["ids"]}
    want = len({frozenset(m for m in reach[n] if n in reach[m]) for n in small["ids"]})
    got = graph_walks.count_components(small["nodes"], small["edges"], small["hubs"], small["adjacent"], small["chunks"])
    assert got.collect()[0].n == want


def test_top_paths(spark, small):
    pairs = [("0_0", "1_1"), ("2_3", "0_0"), ("3_0", "1_1"), ("0_0", "3_0")]
    got = {}
    for r in graph_walks.top_paths(spark.createDataFrame(pairs, "src string, dst string"), small["edges"], small["hubs"], max_edges=4).collect():
        got.setdefault((r.src, r.dst), []).append((r.rank, r.path))
    out = {}
    for (a, b) in small["full"]:
        out.setdefault(a, []).append(b)
    for s, t in pairs:
        found, stack = [], [[s]]
        while stack:
            p = stack.pop()
            if p[-1] == t:
                found.append((-round(sum(small["full"][e] for e in zip(p, p[1:])), 6), len(p), p))
            elif len(p) <= 4:
                stack += [p + [n] for n in out.get(p[-1], []) if n not in p]
        want = [p for _, _, p in sorted(found)[:3]]
        assert [p for _, p in sorted(got.get((s, t), []))] == want


def test_section_walk_and_repeated_titles(spark):
    rows = [(1, 0, "1_0", "x", ["A", "B", "A"], "A"), (1, 1, "1_1", "x", ["C"], "C"), (1, 2, "1_2", "x", [], "Uncategorized")]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, chunk_id string, chunk_text string, path_parts array<string>, section_title string")
    got = {r.chunk_id: r.titles for r in graph_walks.section_path_walk(chunks, graph.graph_nodes(chunks), graph.edges_hierarchical(chunks)).collect()}
    assert got["1_1"] == ["C"] and got["1_2"] == [] and got["1_0"][-1] == "A"


def test_neighbours_cross_slices(spark):
    df = spark.createDataFrame([(1, i, f"v{i}") for i in (0, 1, 4, 9, 10, 25)], "g int, o int, v string")
    for width in (2, 5, 4096):
        got = [(r.prev_v, r.v, r.next_v) for r in with_neighbours(df, ["g"], "o", ["v"], width).orderBy("o").collect()]
        vs = ["v0", "v1", "v4", "v9", "v10", "v25"]
        assert got == list(zip([None, *vs[:-1]], vs, [*vs[1:], None]))


def test_structural_similarity(spark):
    df = spark.createDataFrame([("a", ["x", "a"], "b", ["x", "b"]), ("a", ["x", "a"], "a", ["y", "a"]), ("a", ["x", "a"], "c", ["x", "y", "c"])],
                               "ta string, pa array<string>, tb string, pb array<string>")
    got = [round(r[0], 6) for r in df.select(graph.structural_similarity(F.col("ta"), F.col("pa"), F.col("tb"), F.col("pb"))).collect()]
    assert got == [0.5, 1.0, 0.333333]
