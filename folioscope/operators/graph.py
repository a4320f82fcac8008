"""Chunk knowledge graph: nodes, edges and counts.

Chunks that share a keyword in a document are all linked to each other. That clique is kept as a hub —
(hub, chunk_id) rows — from which every neighbour, distance and count follows exactly, while its size
stays linear in the number of chunks. Every other edge is a row src, dst, type, weight.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.rows import explode_rows
from folioscope.functions.vocab import EDGE_WEIGHTS
from folioscope.operators.windows import with_neighbours


def doc_node(doc: Column) -> Column:
    return doc.cast("string")


def section_node(doc: Column, title: Column) -> Column:
    return F.concat_ws("_", doc.cast("string"), title)


def _typed(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumn("type", F.lit(kind)).withColumn("weight", F.lit(EDGE_WEIGHTS[kind]))


def first_occurrence_references(chunks: DataFrame) -> DataFrame:
    """src, dst: a chunk refers to the first chunk, in another document, that holds the same text."""
    keyed = chunks.select("chunk_id", "doc_id", "chunk_index", F.md5("chunk_text").alias("h"))
    first = keyed.groupBy("h").agg(F.min(F.struct("doc_id", "chunk_index", "chunk_id")).alias("f"))
    return keyed.join(first, "h").filter(F.col("doc_id") != F.col("f.doc_id")).select(
        F.col("chunk_id").alias("src"), F.col("f.chunk_id").alias("dst"))


def graph_nodes(chunks: DataFrame) -> DataFrame:
    """id, type, doc_id, title for documents, sections (one per title and document) and chunks."""
    docs = chunks.select(doc_node(F.col("doc_id")).alias("id"), F.lit("document").alias("type"), "doc_id",
                         F.lit(None).cast("string").alias("title")).distinct()
    titles = explode_rows(chunks, ["doc_id"], "path_parts", "title").distinct()
    sections = titles.select(section_node(F.col("doc_id"), F.col("title")).alias("id"), F.lit("section").alias("type"),
                             "doc_id", "title")
    leaves = chunks.select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("type"), "doc_id",
                           F.col("section_title").alias("title"))
    return docs.unionByName(sections).unionByName(leaves)


def edges_hierarchical(chunks: DataFrame) -> DataFrame:
    """Document → section → … → chunk, with ord = the first chunk that wrote the edge."""
    ids = F.concat(
        F.array(doc_node(F.col("doc_id"))),
        F.transform("path_parts", lambda t: section_node(F.col("doc_id"), t)), F.array("chunk_id"))
    steps = chunks.filter(F.size("path_parts") > 0).withColumn("_ids", ids).select("chunk_index", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("_ids") - 1),
        lambda i: F.struct(F.element_at("_ids", i).alias("src"), F.element_at("_ids", i + 1).alias("dst")))).alias("e"))
    once = steps.groupBy(F.col("e.src").alias("src"), F.col("e.dst").alias("dst")).agg(F.min("chunk_index").alias("ord"))
    return _typed(once, "hierarchical")


def edges_contains(chunks: DataFrame) -> DataFrame:
    return _typed(chunks.select(doc_node(F.col("doc_id")).alias("src"), F.col("chunk_id").alias("dst")), "contains")


def edges_reference(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each named (src, dst) once, if the target exists."""
    known = nodes.select(F.col("id").alias("dst"))
    return _typed(references.select("src", "dst").distinct().join(known, "dst", "left_semi").select("src", "dst"), "reference")


def edges_adjacent(chunks: DataFrame) -> DataFrame:
    """Next and previous chunk of the same section, in both directions."""
    rows = with_neighbours(chunks.select("doc_id", "section_title", "chunk_index", "chunk_id"),
                           ["doc_id", "section_title"], "chunk_index", ["chunk_id"])
    ahead = rows.filter("next_chunk_id is not null").select(F.col("chunk_id").alias("src"), F.col("next_chunk_id").alias("dst"))
    back = ahead.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return _typed(ahead.unionByName(back), "adjacent")


def keyword_hubs(chunks: DataFrame, keywords: DataFrame) -> DataFrame:
    """hub, doc_id, keyword, chunk_id, chunk_index, n for keywords that n, at least two, chunks of a document share."""
    member = chunks.select("doc_id", "chunk_id", "chunk_index").join(
        explode_rows(keywords, ["chunk_id"], "keywords", "keyword"), "chunk_id").distinct()
    size = member.groupBy("doc_id", "keyword").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return member.join(size, ["doc_id", "keyword"]).select(
        F.concat_ws("#", "doc_id", "keyword").alias("hub"), "doc_id", "keyword", "chunk_id", "chunk_index", "n")


def keyword_degree(hubs: DataFrame) -> DataFrame:
    """chunk_id, degree: how many other chunks share a keyword with it — counted without forming pairs.

    The members of a keyword are a bitmap over the document's chunk numbers, in pieces of 32,768. Chunks with equal keyword sets
    are one class; its bitmaps are OR-ed piece by piece and the bits counted. A class of one keyword has that keyword's count.
    """
    sets = hubs.groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_set("keyword")).alias("ks"), F.max("n").alias("most"))
    alone = sets.filter(F.size("ks") == 1).select("chunk_id", (F.col("most") - 1).alias("degree"))
    several = sets.filter(F.size("ks") > 1).select("doc_id", "chunk_id", "ks")
    number = F.col("chunk_index") + 1
    pieces = hubs.groupBy("doc_id", "keyword", F.bitmap_bucket_number(number).alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("members"))
    classes = several.select("doc_id", "ks").distinct().withColumn("keyword", F.explode("ks"))
    joined = classes.join(pieces, ["doc_id", "keyword"]).groupBy("doc_id", "ks", "piece").agg(
        F.bitmap_count(F.bitmap_or_agg("members")).alias("c"))
    degree = joined.groupBy("doc_id", "ks").agg((F.sum("c") - 1).alias("degree"))
    return alone.unionByName(several.join(degree, ["doc_id", "ks"]).select("chunk_id", "degree"))


def keyword_neighbours(seeds: DataFrame, hubs: DataFrame) -> DataFrame:
    """src, dst, type, weight: the keyword edges that leave the given chunks (column chunk_id)."""
    own = seeds.select("chunk_id").distinct().join(hubs.select("chunk_id", "hub"), "chunk_id").withColumnRenamed("chunk_id", "src")
    reach = own.join(hubs.select("hub", F.col("chunk_id").alias("dst")), "hub").filter("src <> dst")
    return _typed(reach.select("src", "dst").distinct(), "keyword")


#: Members of one hub that are in one lane when pairs are written out.
LANE = 2048


def keyword_edges(hubs: DataFrame) -> DataFrame:
    """src, dst, type, weight: every ordered pair of chunks that share a keyword of their document, once.

    Pairs are made hub by hub and only at the first hub that both chunks have, so none is made twice and no pair moves. A large
    hub's members are dealt over lanes, and all members go to each of them.
    """
    member = hubs.select("hub", "chunk_id", F.ceil(F.col("n") / LANE).cast("int").alias("lanes")).distinct()
    sets = member.groupBy("chunk_id").agg(F.collect_set("hub").alias("ks"))  # at most ten per chunk
    full = member.join(sets, "chunk_id")
    a = full.select("hub", F.pmod(F.xxhash64("chunk_id"), F.col("lanes")).cast("int").alias("lane"), F.col("chunk_id").alias("src"), F.col("ks").alias("sk"))
    b = full.select("hub", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.col("chunk_id").alias("dst"), F.col("ks").alias("dk"))
    first = F.array_min(F.array_intersect("sk", "dk"))
    return _typed(a.join(b, ["hub", "lane"]).filter((F.col("src") != F.col("dst")) & (F.col("hub") == first)).select("src", "dst"), "keyword")


def edges_final(hierarchical: DataFrame, contains: DataFrame, reference: DataFrame, adjacent: DataFrame,
                hubs: DataFrame, pairs: bool = False) -> DataFrame:
    """One edge per pair, later kinds winning: keyword over adjacent over reference.

    ``pairs`` gives the whole graph, every keyword pair a row. Without it pairs that share a keyword are left to the hubs, for
    steps that read both.
    """
    sets = hubs.groupBy("chunk_id").agg(F.collect_set("hub").alias("ks"))  # at most ten per chunk
    links = adjacent.withColumn("p", F.lit(2)).unionByName(reference.withColumn("p", F.lit(1)))
    kept = links.groupBy("src", "dst").agg(F.max(F.struct("p", "type", "weight")).alias("e")).select(
        "src", "dst", F.col("e.type").alias("type"), F.col("e.weight").alias("weight"))
    a = sets.select(F.col("chunk_id").alias("src"), F.col("ks").alias("sk"))
    b = sets.select(F.col("chunk_id").alias("dst"), F.col("ks").alias("dk"))
    free = kept.join(a, "src", "left").join(b, "dst", "left").filter(
        ~F.coalesce(F.arrays_overlap("sk", "dk"), F.lit(False)) | (F.col("src") == F.col("dst")))
    cols = ["src", "dst", "type", "weight"]
    parts = [hierarchical, contains, free, *([keyword_edges(hubs)] if pairs else [])]
    return reduce(lambda x, y: x.unionByName(y), [d.select(cols) for d in parts])


def graph_cleanup(nodes: DataFrame, edges: DataFrame, hubs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without isolated nodes and repeated (src, dst, type)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    if hubs is not None:
        ends = ends.unionByName(hubs.select(F.col("chunk_id").alias("id")))
    return nodes.join(ends.distinct(), "id", "left_semi"), edges.dropDuplicates(["src", "dst", "type"])


def graph_stats(nodes: DataFrame, edges: DataFrame, hubs: DataFrame, n_components: DataFrame) -> DataFrame:
    """One row of counts. ``n_components``: one row, column n."""
    one = lambda c, v: F.count(F.when(F.col(c) == v, 1))
    n = nodes.agg(F.count(F.lit(1)).alias("num_nodes"), one("type", "document").alias("documents"),
                  one("type", "section").alias("sections"), one("type", "chunk").alias("chunks"))
    kinds = ["hierarchical", "contains", "reference", "adjacent"]
    e = edges.agg(F.count(F.lit(1)).alias("pair_edges"), *[one("type", k).alias(f"{k}_edges") for k in kinds])
    k = keyword_degree(hubs).agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("keyword_edges"))
    c = n_components.select(F.col("n").alias("strongly_connected_components"))
    total = F.col("pair_edges") + F.col("keyword_edges")
    v = F.col("num_nodes")
    return n.join(F.broadcast(e)).join(F.broadcast(k)).join(F.broadcast(c)).select(  # one row each
        "num_nodes", "documents", "sections", "chunks", total.alias("num_edges"),
        *[f"{x}_edges" for x in kinds], "keyword_edges",
        F.round(total / F.greatest(v, F.lit(1)).cast("double"), 6).alias("avg_degree"),
        F.when(v > 1, F.round(total / (v * (v - 1)).cast("double"), 9)).otherwise(F.lit(0.0)).alias("density"),
        "strongly_connected_components",
        # a graph with documents is never strongly connected beyond one node, so no mean path exists
        F.lit(None).cast("double").alias("avg_path_length"),
    )


def structural_similarity(title_a: Column, path_a: Column, title_b: Column, path_b: Column) -> Column:
    """1 for the same section title, else the shared path prefix over the longer path."""
    same = F.zip_with(path_a, path_b, lambda x, y: x.eqNullSafe(y))
    shared = F.aggregate(same, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda acc, x: F.struct(
        (acc["on"] & x).alias("on"), (acc["n"] + (acc["on"] & x).cast("int")).alias("n")), lambda acc: acc["n"])
    longest = F.greatest(F.size(path_a), F.size(path_b))
    return F.when(title_a.eqNullSafe(title_b), F.lit(1.0)).when(longest > 0, shared / longest.cast("double")).otherwise(F.lit(0.0))
