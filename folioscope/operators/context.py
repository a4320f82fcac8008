"""Retrieval context, model scores, citations and the documents an answer rests on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioscope.functions.text import squeeze, strip
from folioscope.functions.vocab import (
    DOCUMENT_PATTERNS, NEGATIVE_CUES, SCORE_PATTERNS, USED_ENTRY, USED_SECTION, java_pattern,
)


def _doc_order() -> Column:
    """Documents in the order of their best rank."""
    return F.min("rank").over(W.partitionBy("query_id", "doc_id"))


def number_chunks(hits: DataFrame) -> DataFrame:
    """Adds n (position over all documents, from 1) and the numbered prompt line.

    ``hits``: query_id, doc_id, filename, rank, chunk_id, chunk_text — already capped per question.
    """
    order = W.partitionBy("query_id").orderBy("_doc", "rank")
    return (
        hits.withColumn("_doc", _doc_order()).withColumn("n", F.row_number().over(order)).drop("_doc")
        .withColumn("line", F.concat(
            F.lit("["), F.col("n"), F.lit("] Chunk_"), F.col("chunk_id"), F.lit(' from "'), F.col("filename"),
            F.lit('":\n'), strip(F.col("chunk_text")), F.lit("\n")))
    )


def assemble_context(hits: DataFrame) -> DataFrame:
    """query_id, context: a header line per document, then its tagged chunk lines.

    A question holds at most max_total_chunks hits, which bounds the list collected per question.
    """
    tagged = F.concat(
        F.lit("[chunk_"), F.col("chunk_id"), F.lit(' from "'), F.col("filename"), F.lit('" (lang: '), F.col("lang"),
        F.lit(")] "), squeeze(F.col("chunk_text")))
    first = F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy("rank")) == 1
    line = F.when(first, F.concat(F.lit("=== From Document: "), F.col("filename"), F.lit("\n"), tagged)).otherwise(tagged)
    placed = hits.withColumn("_doc", _doc_order()).withColumn("_line", line)
    return placed.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_doc", "rank", "_line"))),
                                 lambda s: s["_line"]), "\n").alias("context"))


def fill_prompt(contexts: DataFrame, templates: DataFrame) -> DataFrame:
    """Adds prompt from ``templates`` (name, body) by the rows' ``template``; an unknown template gives ''.

    The body is cut at its placeholders and every cut is filled once, so a question that itself holds a
    placeholder is left as it is.
    """
    bodies = templates.select(F.col("name").alias("template"), F.split("body", r"(?=\{query\}|\{context\})|(?<=\{query\}|\{context\})", -1).alias("_parts"))
    filled = F.transform("_parts", lambda p: F.when(p == "{query}", F.col("query")).when(p == "{context}", F.col("context")).otherwise(p))
    return contexts.join(bodies, "template", "left").withColumn(
        "prompt", F.coalesce(F.array_join(filled, "", ""), F.lit(""))).drop("_parts")


def parse_context(contexts: DataFrame) -> DataFrame:
    """query_id, filename (as tagged), document, chunk_id, lang, chunk_text, n — the inverse of assembly.

    Lines belong to the header above them. A document whose last filled block comes later replaces its
    earlier block, but keeps its place. Lines without tag, or before any header, vanish.
    """
    lines = contexts.select("query_id", F.posexplode(F.split("context", "\n", -1)).alias("at", "line"))
    by_line = W.partitionBy("query_id").orderBy("at")
    head = F.col("line").startswith("=== From Document:")
    title = F.when(head, strip(F.replace("line", F.lit("=== From Document:"), F.lit(""))))
    marked = lines.withColumn("document", F.last(title, ignorenulls=True).over(by_line)).withColumn(
        "block", F.max(F.when(head, F.col("at"))).over(by_line))
    tagged = marked.filter(F.col("line").startswith("[chunk_") & (F.col("document") != ""))
    same = W.partitionBy("query_id", "document")
    placed = tagged.withColumn("_first", F.min("block").over(same)).withColumn("_last", F.max("block").over(same))
    line = F.col("line")
    quoted = strip(F.regexp_extract(line, r'from\s+"([^"]+)"', 1))
    bare = strip(F.regexp_extract(line, r"from\s+([^\s(]+)", 1))
    name = F.when(line.rlike(r'from\s+"([^"]+)"'), quoted).when(line.rlike(r"from\s+([^\s(]+)"), bare).otherwise(F.col("document"))
    close = F.instr(line, "]")
    cut = (
        placed.withColumn("chunk_id", F.regexp_extract("line", r"\[chunk_([^\s\]]+)", 1))
        .withColumn("lang", strip(F.regexp_extract("line", r"\(lang:([^)]*)\)", 1)))
        .withColumn("filename", F.regexp_replace(name, r"[,.\])\s]+$", ""))
        .withColumn("chunk_text", F.when(close > 1, strip(F.substring(line, close + 1, F.length(line)))).otherwise(line))
    )
    kept = cut.filter((F.col("block") == F.col("_last")) & (F.col("chunk_id") != ""))
    order = W.partitionBy("query_id").orderBy("_first", "at")
    return kept.withColumn("n", F.row_number().over(order)).select(
        "query_id", "n", "document", "filename", "chunk_id", "lang", "chunk_text")


def context_language(tagged: DataFrame, default: str = "en") -> DataFrame:
    """query_id, context_lang: each document counts a language once; first seen wins ties.

    ``tagged``: query_id, document, lang, n (order of appearance); rows without tag have '' or null.
    """
    seen = tagged.groupBy("query_id", "document", F.when(F.col("lang") != "", F.col("lang")).alias("lang")).agg(
        F.min("n").alias("n"))
    counts = seen.groupBy("query_id", "lang").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("first"))
    rank = W.partitionBy("query_id").orderBy(F.col("lang").isNull(), F.desc("c"), "first")
    return counts.withColumn("rn", F.row_number().over(rank)).filter("rn = 1").select(
        "query_id", F.coalesce("lang", F.lit(default)).alias("context_lang"))


def extract_llm_scores(rows: DataFrame) -> DataFrame:
    """Adds llm: the score that an analysis text gives to a chunk, else its initial score.

    ``rows``: analysis, chunk_text, initial. The score is looked for around the place where the analysis
    quotes the chunk's first 50 characters.
    """
    at = F.instr(F.col("analysis"), F.substring("chunk_text", 1, 50))
    begin = F.greatest(at - 1 - 100, F.lit(0))
    span = F.when(at > 0, F.substring("analysis", begin + 1, F.least(at - 1 + 300, F.length("analysis")) - begin))
    found = F.coalesce(*[
        F.when(F.col("_span").rlike(java_pattern(p, "i")),
               F.regexp_extract("_span", java_pattern(p, "i"), 1).cast("double") / 10.0) for p in SCORE_PATTERNS])
    return rows.withColumn("_span", span).withColumn(
        "llm", F.coalesce(found, "initial", F.lit(0.5))).drop("_span")


def _numbers(matches: Column) -> Column:
    return F.filter(F.transform(matches, lambda m: m.try_cast("int")), lambda n: n.isNotNull())


def extract_citations(answers: DataFrame, mapping: DataFrame) -> DataFrame:
    """answer_id, pos, n, chunk_id, filename — the chunks an answer names.

    ``answers``: answer_id, text; ``mapping``: answer_id, n, chunk_id, filename.
    With a 'Used chunks: [...]' section its 'n from file' entries count, or all its numbers when it has
    no such entry. Without the section every number of the text counts once, and if none is in the
    mapping, the first chunk does.
    """
    section = F.regexp_extract("text", f"(?is){USED_SECTION}", 1)
    has = F.col("text").rlike(f"(?is){USED_SECTION}")
    entries = F.regexp_extract_all(section, F.lit(USED_ENTRY), F.lit(1))
    plain = F.regexp_extract_all(section, F.lit(r"(\d+)"), F.lit(1))
    free = F.regexp_extract_all(F.col("text"), F.lit(r"(\d+)"), F.lit(1))
    picked = F.when(has, F.when(F.size(entries) > 0, entries).otherwise(plain)).otherwise(free)
    cited = answers.select("answer_id", (~has).alias("free"), _numbers(picked).alias("ns"))
    first = mapping.groupBy("answer_id").agg(F.min("n").alias("first_n"))
    placed = cited.select("answer_id", "free", F.posexplode_outer("ns").alias("pos", "n"))
    known = placed.join(mapping, ["answer_id", "n"]).select("answer_id", "free", "pos", "n", "chunk_id", "filename")
    named = known.filter("not free").drop("free")
    loose = known.filter("free").groupBy("answer_id", "chunk_id", "filename").agg(F.min("pos").alias("pos"), F.min("n").alias("n"))
    empty = cited.filter("free").join(known.select("answer_id"), "answer_id", "left_anti")
    fallback = empty.join(first, "answer_id").select("answer_id", F.lit(0).alias("pos"), F.col("first_n").alias("n")).join(
        mapping, ["answer_id", "n"])
    cols = ["answer_id", "pos", "n", "chunk_id", "filename"]
    return named.select(cols).unionByName(loose.select(cols)).unionByName(fallback.select(cols))


def answer_body(text: Column) -> Column:
    """The answer without its citation section."""
    return strip(F.regexp_replace(text, r"(?is)used chunks:.*$", ""))


def citation_stats(citations: DataFrame, group: list[str]) -> DataFrame:
    return citations.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_citations"), F.count_distinct("answer_id").alias("n_answers"),
        F.count_distinct("chunk_id").alias("n_chunks"))


def _any(text: Column, parts: list[str]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(p) for p in parts])


def _clean_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(name), r"\s+", " "), '^[" ]+|[" ]+$', "")


def relevant_documents(analyses: DataFrame) -> DataFrame:
    """analysis_id, document named in an analysis and not spoken of negatively, or given a high chunk score.

    Matches are fenced by control characters, so that splitting there yields each match with the text
    around it.
    """
    found = []
    for p in DOCUMENT_PATTERNS:
        pattern = java_pattern(p, "im")
        parts = F.split(F.regexp_replace("text", pattern, "\u0001$0\u0002"), "[\u0001\u0002]", -1)
        at = F.posexplode("_parts").alias("i", "match")
        before = F.array_join(F.slice("_parts", 1, F.col("i")), "")
        behind = F.array_join(F.slice("_parts", F.col("i") + 2, F.size("_parts")), "")
        around = F.concat(F.substring(before, F.greatest(F.length(before) - 49, F.lit(1)), F.lit(50)),
                          F.col("match"), F.substring(behind, 1, 50))
        found.append(
            analyses.withColumn("_parts", parts).select("analysis_id", "_parts", at).filter("i % 2 = 1")
            .select("analysis_id", _clean_name(F.regexp_extract("match", pattern, 1)).alias("document"),
                    around.alias("around")))
    named = reduce(lambda a, b: a.unionByName(b), found)
    named = named.filter((F.col("document") != "") & ~_any(F.col("around"), NEGATIVE_CUES))
    # without a negative cue a name counts both with and without a positive one
    blocks = F.regexp_extract_all("text", F.lit(r"(?s)Document:\s*[^:\n]+?(?:\n|\z).*?(?=Document:|\z)"), F.lit(0))
    scores = F.transform(F.regexp_extract_all("block", F.lit(r"Chunk\s+\d+:\s*(?:Score\s*)?(\d+)/10"), F.lit(1)),
                         lambda s: s.try_cast("int"))
    scored = (
        analyses.select("analysis_id", F.explode(blocks).alias("block"))
        .filter(F.exists(scores, lambda s: s >= 7))
        .select("analysis_id", _clean_name(F.regexp_extract("block", r"Document:\s*([^:\n]+?)(?:\n|\z)", 1)).alias("document"))
    )
    return named.select("analysis_id", "document").unionByName(scored).distinct()

