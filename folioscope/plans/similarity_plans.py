"""Similarity, overlap and highlight decisions (J1-J4, J7, J8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import similarity
from folioscope.plans.inputs import documents, texts
from folioscope.plans.registry import query
from folioscope.plans.retrieval_plans import BM25_SQL, bm25_hits, qa_pairs
from folioscope.plans.sql_parts import (
    char_grams_sql, jaccard_sql, key_phrases_sql, normalize_list_sql, tokens_sql, word_grams_sql, words_sql,
)
from folioscope.session import cut_lineage, read_table, spread

_PAIRS = """
pairs AS (SELECT conv_id, turn, question AS a, text AS b FROM (
  SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM conversations)
  WHERE role = 'assistant' AND question IS NOT NULL)"""


def _word(a, b):
    return jaccard_sql(words_sql(f"lower({a})"), words_sql(f"lower({b})"))


def _ngram(a, b):
    return (f"(0.3e0 * {jaccard_sql(char_grams_sql(a), char_grams_sql(b))}"
            f" + 0.7e0 * {jaccard_sql(word_grams_sql(a), word_grams_sql(b))})")


def _weighted(cos, a, b):
    return (f"(0.4e0 * {cos} + 0.2e0 * {_ngram(a, b)} + 0.25e0 * {jaccard_sql(key_phrases_sql(a), key_phrases_sql(b))}"
            f" + 0.15e0 * {_word(a, b)})")


def _cosine_sql(name: str, src: str, keys: str, a: str, b: str) -> str:
    """CTEs ending in ``name``: keys, cosine."""
    return f"""
{name}_t AS (SELECT {keys}, 1 AS side, unnest({tokens_sql(a)}) AS term FROM {src} UNION ALL SELECT {keys}, 2, unnest({tokens_sql(b)}) FROM {src}),
{name}_f AS (SELECT {keys}, term, count(*) FILTER (WHERE side = 1) AS ta, count(*) FILTER (WHERE side = 2) AS tb FROM {name}_t GROUP BY ALL),
{name}_w AS (SELECT {keys}, ta * i AS wa, tb * i AS wb FROM (SELECT *, ln(3e0 / (1e0 + (ta > 0)::INT + (tb > 0)::INT)) + 1e0 AS i FROM {name}_f)),
{name} AS (SELECT {keys}, CASE WHEN sum(wa * wa) > 0 AND sum(wb * wb) > 0 THEN sum(wa * wb) / (sqrt(sum(wa * wa)) * sqrt(sum(wb * wb))) ELSE 0e0 END AS cosine
  FROM {name}_w GROUP BY {keys})"""


def _pairs(spark, sf):
    return qa_pairs(spread(read_table(spark, sf, "conversations"), "conv_id"))


@query("word_jaccard", f"WITH {_PAIRS} SELECT conv_id, turn, round({_word('a', 'b')}, 6) AS similarity FROM pairs")
def _word_jaccard(spark, sf):
    return _pairs(spark, sf).select(
        "conv_id", "turn", F.round(similarity.word_jaccard(F.col("question"), F.col("answer")), 6).alias("similarity"))


@query("ngram_similarity", f"WITH {_PAIRS} SELECT conv_id, turn, round({_ngram('a', 'b')}, 6) AS similarity FROM pairs")
def _ngram_similarity(spark, sf):
    return _pairs(spark, sf).select(
        "conv_id", "turn", F.round(similarity.ngram_similarity(F.col("question"), F.col("answer")), 6).alias("similarity"))


@query("combined_similarity", f"""WITH {_PAIRS}, {_cosine_sql('pc', 'pairs', 'conv_id, turn', 'a', 'b')}
SELECT conv_id, turn, round({_weighted('coalesce(cosine, 0e0)', 'a', 'b')}, 6) AS similarity FROM pairs LEFT JOIN pc USING (conv_id, turn)""")
def _combined(spark, sf):
    scored = similarity.combined_similarity(_pairs(spark, sf), ["conv_id", "turn"], "question", "answer")
    return scored.select("conv_id", "turn", F.round("similarity", 6).alias("similarity"))


def _overlap_sql(name: str, left: str, right: str, lid: str, rid: str, on: str = "", limit: float = 0.75) -> str:
    """CTEs ending in ``name``: every sentence pair that shares a term is compared (no candidate rule)."""
    keys = f"{on}, " if on else ""
    join_on = "".join(f" AND l.{k.strip()} = r.{k.strip()}" for k in on.split(",") if k.strip())
    out = ", ".join([x for x in (lid, rid, on and ", ".join("l." + k.strip() for k in on.split(","))) if x])
    lsel, rsel = (f"{lid}, " if lid else ""), (f"{rid}, " if rid else "")
    return f"""
{name}_l AS (SELECT * FROM (SELECT {lsel}{keys}unnest({normalize_list_sql('text')}) AS s FROM {left}) WHERE len({words_sql('s')}) >= 4),
{name}_r AS (SELECT * FROM (SELECT {rsel}{keys}unnest({normalize_list_sql('text')}) AS s FROM {right}) WHERE len({words_sql('s')}) >= 4),
{name}_s AS (SELECT DISTINCT s FROM (SELECT s FROM {name}_l UNION ALL SELECT s FROM {name}_r)),
{name}_t AS (SELECT s, term, count(*) AS tf FROM (SELECT s, unnest({tokens_sql('s')}) AS term FROM {name}_s) GROUP BY ALL),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_t GROUP BY 1),
{name}_v AS (SELECT s, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY s)) AS w FROM (
   SELECT s, term, tf * (ln((1e0 + (SELECT count(*) FROM {name}_s)) / (1e0 + df)) + 1e0) AS raw FROM {name}_t JOIN {name}_d USING (term))),
{name}_c AS (SELECT a.s AS sa, b.s AS sb, sum(a.w * b.w) AS cosine
   FROM (SELECT * FROM {name}_v WHERE s IN (SELECT s FROM {name}_l)) a JOIN (SELECT * FROM {name}_v WHERE s IN (SELECT s FROM {name}_r)) b USING (term) GROUP BY 1, 2
   HAVING sum(a.w * b.w) > {round((limit - 0.6) / 0.4, 6)}e0),
{name}_m AS (SELECT * FROM (SELECT sa, sb, round({_weighted('cosine', 'sa', 'sb')}, 6) AS sim FROM {name}_c) WHERE sim > {limit}e0),
{name} AS (SELECT {out}, max(sim) AS best FROM {name}_l l JOIN {name}_m m ON l.s = m.sa JOIN {name}_r r ON r.s = m.sb{join_on} GROUP BY ALL)"""


@query("sentence_overlap", f"""WITH {_overlap_sql('ov', 'documents', 'benchmark', 'doc_id', 'item_id', limit=0.74)}
SELECT doc_id, item_id, best FROM ov""")
def _overlap(spark, sf):
    return similarity.sentence_overlap(
        texts(spark, sf).select("doc_id", "text"), read_table(spark, sf, "benchmark"), ["doc_id"], ["item_id"],
        threshold=0.74)


# each question's best document, line by line, against the question's passage
_SECTIONS = f"""{BM25_SQL},
sect AS (SELECT query_id, ln::INT AS section_no, line AS section, b.text AS answer FROM (
   SELECT query_id, unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)), 1) - 1 AS ln
   FROM bm JOIN chunks c USING (chunk_id) JOIN documents d ON d.doc_id = c.doc_id WHERE rank = 1) JOIN benchmark b ON b.item_id = query_id
  WHERE trim(line) <> ''),
sectn AS (SELECT *, array_to_string({normalize_list_sql('section')}, ' ') AS na, array_to_string({normalize_list_sql('answer')}, ' ') AS nb FROM sect),
sl AS (SELECT query_id, section_no, section AS text FROM sect), sr AS (SELECT query_id, section_no, answer AS text FROM sect),
{_cosine_sql('hc', 'sectn', 'query_id, section_no', 'na', 'nb')},
{_overlap_sql('ho', 'sl', 'sr', '', '', 'query_id, section_no')},
hl0 AS (SELECT query_id, section_no, section, answer, best IS NOT NULL AS overlap, len({words_sql('na')}) AS nw,
  {_weighted('coalesce(cosine, 0e0)', 'na', 'nb')} * CASE WHEN best IS NOT NULL THEN 1.25e0 ELSE 1e0 END AS sim
  FROM sectn LEFT JOIN hc USING (query_id, section_no) LEFT JOIN ho USING (query_id, section_no)),
hl AS (SELECT *, sim > 0.3e0 * CASE WHEN nw < 30 THEN 1.2e0 WHEN nw > 200 THEN 0.8e0 ELSE 1e0 END OR overlap AS highlight FROM hl0)"""


def _section_pairs(spark, sf):
    from folioscope.plans.inputs import chunks
    best = bm25_hits(spark, sf, 1).join(chunks(spark, sf).select("chunk_id", "doc_id"), "chunk_id")
    lines = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("section_no", "section"))
    passages = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("answer"))
    return cut_lineage(
        lines.filter(F.trim("section") != "").join(best.select("query_id", "doc_id"), "doc_id")
        .join(passages, "query_id").select("query_id", "section_no", "section", "answer")
    )


@query("should_highlight", f"WITH {_SECTIONS} SELECT query_id, section_no, overlap, round(sim, 6) AS sim, highlight FROM hl")
def _should(spark, sf):
    marked = similarity.should_highlight(_section_pairs(spark, sf), ["query_id", "section_no"])
    return marked.select("query_id", "section_no", "overlap", F.round("sim", 6).alias("sim"), "highlight")


@query("best_section", f"""WITH {_SECTIONS}, hs AS (SELECT query_id, section_no, section, answer FROM hl WHERE highlight),
{_cosine_sql('bc', 'hs', 'query_id, section_no', 'section', 'answer')},
bs AS (SELECT query_id, section_no, round({_weighted('coalesce(cosine, 0e0)', 'section', 'answer')}, 6) AS similarity FROM hs LEFT JOIN bc USING (query_id, section_no))
SELECT query_id, section_no, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, section_no) AS rn FROM bs) WHERE rn = 1""")
def _best(spark, sf):
    return similarity.best_section(_section_pairs(spark, sf), ["query_id", "section_no"], "query_id", "section_no")
