"""Knowledge graph (G)."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from folioscope.functions.vocab import EDGE_WEIGHTS
from folioscope.operators import enrich, graph, graph_walks
from folioscope.plans.inputs import titled
from folioscope.plans.registry import query
from folioscope.plans.sql_parts import TITLE_CHUNKS, words_sql
from folioscope.plans.text_plans import _REFS, KEYWORDS_SQL
from folioscope.session import cut_lineage

GRAPH_SQL = f"""{TITLE_CHUNKS}, {_REFS}, {KEYWORDS_SQL},
gc AS (SELECT *, coalesce(path_parts[-1], 'Uncategorized') AS section_title FROM tchunks),
gn AS (SELECT DISTINCT doc_id::VARCHAR AS id, 'document' AS type, doc_id, NULL::VARCHAR AS title FROM gc
  UNION ALL SELECT DISTINCT doc_id || '_' || t, 'section', doc_id, t FROM (SELECT doc_id, unnest(path_parts) AS t FROM gc)
  UNION ALL SELECT chunk_id, 'chunk', doc_id, section_title FROM gc),
hi AS (SELECT chunk_index, list_concat([doc_id::VARCHAR], list_concat(list_transform(path_parts, lambda t: doc_id || '_' || t), [chunk_id])) AS ids FROM gc WHERE len(path_parts) > 0),
he AS (SELECT src, dst, min(chunk_index) AS ord FROM (SELECT chunk_index, ids[i] AS src, ids[i + 1] AS dst FROM (SELECT *, unnest(range(1, len(ids))) AS i FROM hi)) GROUP BY 1, 2),
ce AS (SELECT DISTINCT doc_id::VARCHAR AS src, chunk_id AS dst FROM gc),
re AS (SELECT DISTINCT src, dst FROM refs WHERE dst IN (SELECT id FROM gn)),
ae0 AS (SELECT chunk_id AS src, lead(chunk_id) OVER (PARTITION BY doc_id, section_title ORDER BY chunk_index) AS dst FROM gc),
ae AS (SELECT src, dst FROM ae0 WHERE dst IS NOT NULL UNION ALL SELECT dst, src FROM ae0 WHERE dst IS NOT NULL),
km AS (SELECT doc_id, chunk_id, keyword, count(*) OVER (PARTITION BY doc_id, keyword) AS n FROM kws JOIN gc USING (chunk_id)),
ke AS (SELECT DISTINCT a.chunk_id AS src, b.chunk_id AS dst FROM km a JOIN km b USING (doc_id, keyword) WHERE a.chunk_id <> b.chunk_id),
fe AS (SELECT src, dst, 'hierarchical' AS type, 1e0 AS weight FROM he UNION ALL SELECT src, dst, 'contains', 1e0 FROM ce UNION ALL
  (SELECT src, dst, type, weight FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY p DESC) AS rn FROM (
     SELECT src, dst, 'reference' AS type, 0.8e0 AS weight, 1 AS p FROM re UNION ALL SELECT src, dst, 'adjacent', 0.4e0, 2 FROM ae
     UNION ALL SELECT src, dst, 'keyword', 0.3e0, 3 FROM ke)) WHERE rn = 1)),
sd AS (SELECT source, arg_min(src, (doc_id, chunk_index)) AS seed FROM refs JOIN gc ON chunk_id = src GROUP BY 1)"""


def build(spark, sf, keep: bool = False, pairs: bool = False) -> SimpleNamespace:
    """The graph tables of the corpus; ``keep`` writes them out for plans that read them in rounds.

    The chunk table is always written: every node and edge kind reads it. With ``pairs`` the edges hold every keyword pair and
    are not written.
    """
    hold = cut_lineage if keep else (lambda df: df)
    chunks = cut_lineage(titled(spark, sf).select(
        "doc_id", "source", "chunk_index", "chunk_id", "chunk_text", "path_parts", "section_title"))
    keywords = enrich.keywords(chunks.select("chunk_id", "chunk_text"), "chunk_id", "chunk_text")
    references = graph.first_occurrence_references(chunks)
    nodes = hold(graph.graph_nodes(chunks))
    hierarchical, contains = graph.edges_hierarchical(chunks), graph.edges_contains(chunks)
    reference = graph.edges_reference(references, nodes)
    adjacent = graph.edges_adjacent(chunks)
    hubs = hold(graph.keyword_hubs(chunks, keywords))
    final = graph.edges_final(hierarchical, contains, reference, adjacent, hubs, pairs)
    edges = final if pairs else hold(final)
    return SimpleNamespace(chunks=chunks, keywords=keywords, references=references, nodes=nodes, hubs=hubs, edges=edges,
                           hierarchical=hierarchical, contains=contains, reference=reference, adjacent=adjacent)


def seeds(g):
    """source, chunk_id: each group's first chunk that refers to another document."""
    own = g.chunks.join(g.references.select(F.col("src").alias("chunk_id")), "chunk_id", "left_semi")
    return own.groupBy("source").agg(F.min_by("chunk_id", F.struct("doc_id", "chunk_index")).alias("chunk_id"))


def _q(sql: str) -> str:
    return f"WITH RECURSIVE {GRAPH_SQL}{sql}" if sql.startswith(",") else f"WITH RECURSIVE {GRAPH_SQL} {sql}"


@query("graph_nodes", _q("SELECT * FROM gn"))
def _nodes(spark, sf):
    return graph.graph_nodes(titled(spark, sf))


@query("edges_hierarchical", _q("SELECT src, dst, ord, 'hierarchical' AS type, 1e0 AS weight FROM he"))
def _hierarchical(spark, sf):
    return graph.edges_hierarchical(titled(spark, sf))


@query("edges_contains", _q("SELECT src, dst, 'contains' AS type, 1e0 AS weight FROM ce"))
def _contains(spark, sf):
    return graph.edges_contains(titled(spark, sf))


@query("edges_reference", _q("SELECT src, dst, 'reference' AS type, 0.8e0 AS weight FROM re"))
def _reference(spark, sf):
    chunks = titled(spark, sf)
    return graph.edges_reference(graph.first_occurrence_references(chunks), graph.graph_nodes(chunks))


@query("edges_adjacent", _q("SELECT src, dst, 'adjacent' AS type, 0.4e0 AS weight FROM ae"))
def _adjacent(spark, sf):
    return graph.edges_adjacent(titled(spark, sf))


@query("edges_keyword", _q("""SELECT doc_id || '#' || keyword AS hub, doc_id, keyword, chunk_id, n, degree FROM km
JOIN (SELECT src AS chunk_id, count(*) AS degree FROM ke GROUP BY 1) USING (chunk_id) WHERE n > 1"""))
def _keyword(spark, sf):
    hubs = cut_lineage(build(spark, sf).hubs)
    return hubs.join(graph.keyword_degree(hubs), "chunk_id").select("hub", "doc_id", "keyword", "chunk_id", "n", "degree")


@query("edges_final", _q("SELECT src, dst, type, weight FROM fe"))
def _final(spark, sf):
    return build(spark, sf, keep=True, pairs=True).edges


# The same tables as fe without its keyword pairs: a node shares a keyword if one of its keywords has two members.
_CLEANUP_SQL = """,
lk AS (SELECT src, dst, max(p) AS p FROM (SELECT src, dst, 1 AS p FROM re UNION ALL SELECT src, dst, 2 FROM ae) GROUP BY src, dst),
sk AS (SELECT DISTINCT src, dst FROM lk JOIN km a ON a.chunk_id = src JOIN km b ON b.chunk_id = dst AND b.doc_id = a.doc_id AND b.keyword = a.keyword WHERE src <> dst),
ne AS (SELECT src, dst, 'hierarchical' AS type FROM he UNION ALL SELECT src, dst, 'contains' FROM ce
  UNION ALL SELECT src, dst, CASE p WHEN 2 THEN 'adjacent' ELSE 'reference' END FROM lk ANTI JOIN sk USING (src, dst))
SELECT 'node' AS kind, id AS src, NULL AS dst, type FROM gn
WHERE id IN (SELECT src FROM ne UNION SELECT dst FROM ne UNION SELECT chunk_id FROM km WHERE n > 1)
UNION ALL SELECT DISTINCT 'edge', src, dst, type FROM ne"""


@query("graph_cleanup", _q(_CLEANUP_SQL))
def _cleanup(spark, sf):
    g = build(spark, sf, keep=True)
    nodes, edges = graph.graph_cleanup(g.nodes, g.edges, g.hubs)
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), "type").unionByName(
        edges.select(F.lit("edge").alias("kind"), "src", "dst", "type"))


# strongly connected components by mutual reach
_SCC_SQL = """
ue AS (SELECT DISTINCT src, dst FROM fe),
reach AS (SELECT src, dst FROM ue UNION SELECT r.src, e.dst FROM reach r JOIN ue e ON e.src = r.dst),
mut AS (SELECT a.src AS id, min(a.dst) AS m FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
scc AS (SELECT count(DISTINCT least(id, coalesce(m, id))) AS n FROM gn LEFT JOIN mut USING (id))"""


@query("components", _q(f", {_SCC_SQL} SELECT n FROM scc"))
def _components(spark, sf):
    g = build(spark, sf, keep=True)
    return graph_walks.count_components(g.nodes, g.edges, g.hubs, g.adjacent, g.chunks)


@query("graph_stats", _q(f""", {_SCC_SQL},
v AS (SELECT count(*) AS num_nodes, count(*) FILTER (WHERE type = 'document') AS documents, count(*) FILTER (WHERE type = 'section') AS sections,
  count(*) FILTER (WHERE type = 'chunk') AS chunks FROM gn),
e AS (SELECT count(*) AS num_edges, count(*) FILTER (WHERE type = 'hierarchical') AS hierarchical_edges, count(*) FILTER (WHERE type = 'contains') AS contains_edges,
  count(*) FILTER (WHERE type = 'reference') AS reference_edges, count(*) FILTER (WHERE type = 'adjacent') AS adjacent_edges,
  count(*) FILTER (WHERE type = 'keyword') AS keyword_edges FROM fe)
SELECT num_nodes, documents, sections, chunks, num_edges, hierarchical_edges, contains_edges, reference_edges, adjacent_edges, keyword_edges,
  round(num_edges / greatest(num_nodes, 1)::DOUBLE, 6) AS avg_degree, round(num_edges / (num_nodes * (num_nodes - 1))::DOUBLE, 9) AS density,
  n AS strongly_connected_components, NULL::DOUBLE AS avg_path_length FROM v, e, scc"""))
def _stats(spark, sf):
    g = build(spark, sf, keep=True)
    n = graph_walks.count_components(g.nodes, g.edges, g.hubs, g.adjacent, g.chunks)
    return graph.graph_stats(g.nodes, g.edges, g.hubs, n)


@query("k_hop", _q(""",
f AS (SELECT DISTINCT seed AS id, 0 AS hops FROM sd UNION SELECT e.dst, f.hops + 1 FROM f JOIN fe e ON e.src = f.id WHERE f.hops < 2),
b AS (SELECT DISTINCT seed AS id, 0 AS hops FROM sd UNION SELECT e.src, b.hops + 1 FROM b JOIN fe e ON e.dst = b.id WHERE b.hops < 2)
SELECT id, min(hops)::INT AS hops FROM (SELECT * FROM f UNION ALL SELECT * FROM b) GROUP BY 1"""))
def _k_hop(spark, sf):
    g = build(spark, sf, keep=True)
    return graph_walks.k_hop(seeds(g).select(F.col("chunk_id").alias("id")), g.edges, g.hubs)


@query("induced_edges", _q(""",
f AS (SELECT DISTINCT seed AS id, 0 AS hops FROM sd UNION SELECT e.dst, f.hops + 1 FROM f JOIN fe e ON e.src = f.id WHERE f.hops < 2),
b AS (SELECT DISTINCT seed AS id, 0 AS hops FROM sd UNION SELECT e.src, b.hops + 1 FROM b JOIN fe e ON e.dst = b.id WHERE b.hops < 2),
k AS (SELECT id FROM f UNION SELECT id FROM b)
SELECT src, dst, type, weight FROM fe WHERE type <> 'keyword' AND src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)
UNION ALL SELECT chunk_id, doc_id || '#' || keyword, 'keyword', 0.3e0 FROM km WHERE n > 1 AND chunk_id IN (SELECT id FROM k)"""))
def _induced(spark, sf):
    g = build(spark, sf, keep=True)
    near = graph_walks.k_hop(seeds(g).select(F.col("chunk_id").alias("id")), g.edges, g.hubs)
    edges, hubs = graph_walks.induced_edges(near, g.edges, g.hubs)
    return edges.unionByName(hubs.select(F.col("chunk_id").alias("src"), F.col("hub").alias("dst"), F.lit("keyword").alias("type"),
                                         F.lit(EDGE_WEIGHTS["keyword"]).alias("weight")))


_WALK_SQL = """
up AS (SELECT dst AS at_id, arg_min(src, (ord, src)) AS up FROM he GROUP BY 1),
walk AS (SELECT chunk_id, chunk_id AS at_id, []::VARCHAR[] AS titles, 0 AS d FROM gc
  UNION ALL SELECT w.chunk_id, u.up, CASE WHEN n.type = 'section' THEN list_prepend(n.title, w.titles) ELSE w.titles END, w.d + 1
  FROM walk w JOIN up u ON u.at_id = w.at_id JOIN (SELECT id, type, title FROM gn) n ON n.id = u.up),
walked AS (SELECT chunk_id, arg_max(titles, d) AS titles FROM walk GROUP BY 1)"""


@query("section_path_walk", _q(f", {_WALK_SQL} SELECT chunk_id, array_to_string(titles, ' > ') AS section_path FROM walked"))
def _walk(spark, sf):
    g = build(spark, sf)
    return graph_walks.section_path_walk(g.chunks, g.nodes, g.hierarchical).select(
        "chunk_id", F.array_join("titles", " > ").alias("section_path"))


@query("chunk_context", _q(f""", {_WALK_SQL},
cx AS (SELECT seed AS chunk_id, 'reference' AS relation, dst AS other_id, weight FROM sd JOIN fe ON src = seed AND type = 'reference'
  UNION ALL SELECT seed, 'referenced_by', src, weight FROM sd JOIN fe ON dst = seed AND type = 'reference'
  UNION ALL SELECT seed, 'related', dst, weight FROM sd JOIN fe ON src = seed AND type = 'keyword'
  UNION ALL SELECT seed, 'next', dst, NULL FROM sd JOIN ae0 ON src = seed WHERE dst IS NOT NULL
  UNION ALL SELECT seed, 'previous', src, NULL FROM sd JOIN ae0 ON dst = seed)
SELECT cx.*, substr(gc.chunk_text, 1, 100) AS preview FROM cx JOIN gc ON gc.chunk_id = cx.other_id
UNION ALL SELECT seed, 'document', doc_id::VARCHAR, NULL, NULL FROM sd JOIN gc ON chunk_id = seed
UNION ALL SELECT seed, 'section_path', array_to_string(titles, ' > '), NULL, NULL FROM sd JOIN walked ON chunk_id = seed"""))
def _context(spark, sf):
    g = build(spark, sf, keep=True)
    walks = graph_walks.section_path_walk(g.chunks.join(seeds(g), "chunk_id", "left_semi"), g.nodes, g.hierarchical)
    return graph_walks.chunk_context(seeds(g), g.chunks, g.edges, g.hubs, walks)


_DIST_SQL = """
te AS (SELECT src, dst, round(weight * 10)::INT AS t FROM fe),
sp AS (SELECT DISTINCT seed, seed AS id, 0 AS t FROM sd UNION SELECT sp.seed, e.dst, sp.t + e.t FROM sp JOIN te e ON e.src = sp.id WHERE sp.t + e.t <= 80),
dist AS (SELECT seed, id, min(t) / 10e0 AS distance FROM sp GROUP BY 1, 2)"""


@query("shortest_path", _q(f", {_DIST_SQL} SELECT seed, id, round(distance, 6) AS distance, round(1e0 / (1e0 + distance), 6) AS score FROM dist"))
def _shortest(spark, sf):
    g = build(spark, sf, keep=True)
    found = graph_walks.shortest_paths(seeds(g), g.edges, g.hubs)
    return graph_walks.path_scores(found).select(
        "seed", "id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query("top_paths", _q(""",
prs AS (SELECT seed AS src, min(dst) AS dst FROM sd JOIN re ON src = seed GROUP BY 1),
wk AS (SELECT p.src, p.dst, p.src AS id, [p.src] AS path, 0e0 AS weight FROM prs p
  UNION ALL SELECT w.src, w.dst, e.dst, list_append(w.path, e.dst), round(w.weight + e.weight, 6) FROM wk w JOIN fe e ON e.src = w.id
  WHERE w.id <> w.dst AND len(w.path) <= 5 AND NOT list_contains(w.path, e.dst))
SELECT src, dst, array_to_string(path, ' ') AS path, weight, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY weight DESC, len(path), path)::INT AS rank FROM wk WHERE id = dst) WHERE rank <= 3"""))
def _top_paths(spark, sf):
    g = build(spark, sf, keep=True)
    start = seeds(g).select(F.col("chunk_id").alias("src"))
    pairs = start.join(g.reference, "src").groupBy("src").agg(F.min("dst").alias("dst"))
    found = graph_walks.top_paths(pairs, g.edges, g.hubs)
    return found.select("src", "dst", F.array_join("path", " ").alias("path"), "weight", "rank")


_STRUCT = """CASE WHEN {a}.section_title = {b}.section_title THEN 1e0 WHEN greatest(len({a}.path_parts), len({b}.path_parts)) > 0 THEN
  (CASE WHEN {a}.path_parts[1] IS DISTINCT FROM {b}.path_parts[1] THEN 0 WHEN len({a}.path_parts) = 1 OR len({b}.path_parts) = 1 THEN 1
        WHEN {a}.path_parts[2] IS DISTINCT FROM {b}.path_parts[2] THEN 1 ELSE 2 END) / greatest(len({a}.path_parts), len({b}.path_parts))::DOUBLE ELSE 0e0 END"""


@query("structural_similarity", _q(f"SELECT a.chunk_id AS src, b.chunk_id AS dst, round({_STRUCT.format(a='a', b='b')}, 6) AS similarity FROM re JOIN gc a ON a.chunk_id = src JOIN gc b ON b.chunk_id = dst"))
def _structural(spark, sf):
    chunks = titled(spark, sf)
    side = lambda p, key: chunks.select(F.col("chunk_id").alias(key), F.col("section_title").alias(f"{p}t"), F.col("path_parts").alias(f"{p}p"))
    pairs = graph.first_occurrence_references(chunks).distinct()
    return pairs.join(side("a", "src"), "src").join(side("b", "dst"), "dst").select("src", "dst", F.round(
        graph.structural_similarity(F.col("at"), F.col("ap"), F.col("bt"), F.col("bp")), 6).alias("similarity"))


@query("related_chunks", _q(f""", {_DIST_SQL},
wl AS (SELECT chunk_id, list_distinct({words_sql('lower(chunk_text)')}) AS ws FROM gc),
ov AS (SELECT sd.seed, g.chunk_id, len(list_intersect(a.ws, b.ws)) AS c, len(a.ws) AS na, len(b.ws) AS nb, {_STRUCT.format(a='s', b='g')} AS st
  FROM sd JOIN gc s ON s.chunk_id = sd.seed JOIN wl a ON a.chunk_id = sd.seed CROSS JOIN gc g JOIN wl b ON b.chunk_id = g.chunk_id),
rs AS (SELECT ov.seed, chunk_id, round(0.5e0 * CASE WHEN c > 0 THEN c / (na + nb - c)::DOUBLE ELSE 0e0 END + 0.3e0 * st
   + 0.2e0 * coalesce(1e0 / (1e0 + distance), 0e0), 6) AS score FROM ov LEFT JOIN dist ON dist.seed = ov.seed AND dist.id = ov.chunk_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, chunk_id)::INT AS rank FROM rs WHERE score > 0) WHERE rank <= 5"""))
def _related(spark, sf):
    g = build(spark, sf, keep=True)
    distances = graph_walks.shortest_paths(seeds(g), g.edges, g.hubs)
    return graph_walks.related_chunks(seeds(g), g.chunks, distances)


@query("keyword_index", _q("""SELECT 'keyword' AS kind, doc_id, keyword AS entry, count(*) AS n_chunks, min(chunk_id) AS first_chunk FROM km GROUP BY ALL
UNION ALL SELECT 'section', doc_id, section_title, count(*), min(chunk_id) FROM gc GROUP BY ALL"""))
def _keyword_index(spark, sf):
    g = build(spark, sf)
    words = g.chunks.select("doc_id", "chunk_id").join(g.keywords, "chunk_id").select(
        "doc_id", F.explode("keywords").alias("entry"), "chunk_id", F.lit("keyword").alias("kind"))
    sections = g.chunks.select("doc_id", F.col("section_title").alias("entry"), "chunk_id", F.lit("section").alias("kind"))
    return words.unionByName(sections).groupBy("kind", "doc_id", "entry").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_id").alias("first_chunk"))


@query("semantic_edges", f"""WITH RECURSIVE {TITLE_CHUNKS},
tx AS (SELECT md5(chunk_text) AS s, min(chunk_id) AS f, count(*) AS n, first(chunk_text) AS t FROM tchunks GROUP BY 1),
tt AS (SELECT s, term, count(*) AS tf FROM (SELECT s, unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM tx) GROUP BY ALL),
td AS (SELECT term, count(*) AS df FROM tt GROUP BY 1),
tv AS (SELECT s, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY s)) AS w FROM (
  SELECT s, term, tf * (ln((1e0 + (SELECT count(*) FROM tx)) / (1e0 + df)) + 1e0) AS raw FROM tt JOIN td USING (term))),
tp AS (SELECT a.s AS sa, b.s AS sb FROM tv a JOIN tv b USING (term) WHERE a.s <> b.s GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 6) >= 0.8e0)
SELECT x.f AS src, y.f AS dst, 'semantic' AS type FROM tp JOIN tx x ON x.s = sa JOIN tx y ON y.s = sb
UNION ALL SELECT chunk_id, f, 'copy' FROM tchunks JOIN tx ON s = md5(chunk_text) WHERE n > 1""")
def _semantic(spark, sf):
    from folioscope.operators.similarity import semantic_edges
    edges, copies = semantic_edges(titled(spark, sf).select("chunk_id", "chunk_text"))
    return edges.select("src", "dst", "type").unionByName(
        copies.select(F.col("chunk_id").alias("src"), F.col("hub").alias("dst"), F.lit("copy").alias("type")))
