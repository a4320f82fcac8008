"""Retrieval, context, citations and spans (R, J12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.vocab import SCORE_PATTERNS, USED_ENTRY, USED_SECTION
from folioscope.operators import block_search, catalog, code_search, context, enrich, phrases, scoped_search, search, spans
from folioscope.operators.windows import with_neighbours
from folioscope.plans.inputs import chunks, documents, texts
from folioscope.plans.registry import query
from folioscope.plans.sql_parts import CHUNKS, lit, tokens_sql, trim_sql, words_sql
from folioscope.plans.text_plans import VECTORS_SQL
from folioscope.session import cut_lineage, read_table, scratch_path
from folioscope.sources import postings_store

BM25_SQL = f"""{CHUNKS},
ptok AS (SELECT chunk_id, unnest({tokens_sql('chunk_text')}) AS term FROM chunks),
post AS (SELECT chunk_id, term, count(*) AS tf FROM ptok GROUP BY ALL),
dls AS (SELECT chunk_id, count(*) AS dl FROM ptok GROUP BY 1),
pst AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls),
pdf AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark),
bms AS (SELECT query_id, chunk_id, round(sum(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * (tf * 2.2e0)
         / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score
  FROM qt JOIN pdf USING (term) JOIN post USING (term) JOIN dls USING (chunk_id), pst GROUP BY 1, 2),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM bms) WHERE rank <= 10)"""

COS_SQL = f"""{VECTORS_SQL},
qtf AS (SELECT query_id, term, count(*) AS tf FROM (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
qraw AS (SELECT query_id, term, tf * (ln((1e0 + (SELECT count(*) FROM chunks)) / (1e0 + coalesce(df, 0))) + 1e0) AS raw FROM qtf LEFT JOIN vdf USING (term)),
qvec AS (SELECT query_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS qw FROM qraw),
cos0 AS (SELECT query_id, chunk_id, round(sum(w * qw), 6) AS score FROM vec JOIN qvec USING (term) GROUP BY 1, 2),
cos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM cos0) WHERE rank <= 10)"""

HITS_SQL = f"""{BM25_SQL},
hits AS (SELECT bm.*, c.doc_id, c.lang, c.source, c.doc_id || '_' || c.source || '.txt' AS filename, c.chunk_text FROM bm JOIN chunks c USING (chunk_id)),
placed AS (SELECT *, min(rank) OVER (PARTITION BY query_id, doc_id) AS drank FROM hits),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY drank, rank)::INT AS n FROM placed)"""


def questions(spark, sf):
    return read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def stored_index(spark, sf, rows=None):
    """(postings, stats): the keyword index, written once, and its one-row statistics."""
    postings = cut_lineage(search.bm25_index(cut_lineage(chunks(spark, sf).select("chunk_id", "chunk_text")) if rows is None else rows))
    return postings, cut_lineage(search.index_stats(postings))


def bm25_hits(spark, sf, k: int = 10, rows=None):
    return search.bm25_search(*stored_index(spark, sf, rows), questions(spark, sf), k)


def hits_with_text(spark, sf):
    """The hits, with the chunk rows joined back only after the top-k. Texts are cut into chunks once, for both."""
    rows = cut_lineage(chunks(spark, sf))
    info = rows.withColumn("filename", F.concat("doc_id", F.lit("_"), "source", F.lit(".txt")))
    return bm25_hits(spark, sf, rows=rows).join(info.drop("chunk_index"), "chunk_id")


@query("bm25_index", f"""WITH {BM25_SQL}
SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, sum(dl)::BIGINT AS dl FROM post JOIN dls USING (chunk_id) GROUP BY 1""")
def _bm25_index(spark, sf):
    postings = search.bm25_index(chunks(spark, sf))
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"), F.sum("dl").alias("dl"))


@query("bm25_search", f"WITH {BM25_SQL} SELECT query_id, chunk_id, score, rank FROM bm")
def _bm25_search(spark, sf):
    return bm25_hits(spark, sf)


@query("stored_bm25_search", f"WITH {BM25_SQL} SELECT query_id, chunk_id, score, rank FROM bm")
def _stored_bm25(spark, sf):
    path = scratch_path(spark, "postings")
    postings_store.write_postings(chunks(spark, sf), path)
    return block_search.bm25_from_blocks(postings_store.read_postings(spark, path), questions(spark, sf))


def _cosine(spark, sf, rows=None, postings=None):
    """(vectors of the chunks, vectors of the questions). The chunks' terms are counted where their texts go; postings do not move again."""
    rows = cut_lineage(chunks(spark, sf).select("chunk_id", "doc_id", "chunk_text")) if rows is None else rows
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    asked = search.query_vectors(questions(spark, sf), search.bm25_index(rows) if postings is None else postings, total)
    return enrich.vectorize(rows, "chunk_id", "chunk_text"), asked


@query("cosine_search", f"WITH {CHUNKS}, {COS_SQL} SELECT query_id, chunk_id, score, rank FROM cos")
def _cosine_search(spark, sf):
    return search.cosine_search(*_cosine(spark, sf))


@query("hybrid_search", f"""WITH {BM25_SQL}, {COS_SQL},
fused AS (SELECT query_id, chunk_id, c.rank AS dense_rank, b.rank AS keyword_rank,
   round(coalesce(1e0 / (60 + c.rank), 0e0) + coalesce(1e0 / (60 + b.rank), 0e0), 6) AS score
  FROM cos c FULL JOIN bm b USING (query_id, chunk_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM fused) WHERE rank <= 10""")
def _hybrid(spark, sf):
    rows = cut_lineage(chunks(spark, sf).select("chunk_id", "chunk_text"))
    index = stored_index(spark, sf, rows)
    dense = search.cosine_search(*_cosine(spark, sf, rows, index[0]))
    return search.reciprocal_rank_fusion(dense, search.bm25_search(*index, questions(spark, sf)))


_CAPS = """
capd AS (SELECT * FROM (SELECT query_id, chunk_id, doc_id, score, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id)::INT AS doc_rank
  FROM cos0 JOIN chunks USING (chunk_id) WHERE score >= 0.25e0) WHERE doc_rank <= 3),
capt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM capd) WHERE rank <= 10)"""


def _capped(spark, sf):
    scored = search.cosine_above(*_cosine(spark, sf), 0.25).join(chunks(spark, sf).select("chunk_id", "doc_id"), "chunk_id")
    return search.threshold_and_caps(scored, threshold=0.25)


@query("threshold_and_caps", f"WITH {CHUNKS}, {COS_SQL}, {_CAPS} SELECT * FROM capt")
def _caps(spark, sf):
    return _capped(spark, sf).select("query_id", "chunk_id", "doc_id", "score", "doc_rank", "rank")


# a question's scope, and the settings of some groups; the others have the default row's
_SCOPED_SQL = """
se AS (SELECT 'src' || r_regionkey AS group_id, r_regionkey * 2 AS chunks_per_doc, CASE WHEN r_regionkey <> 1 THEN r_regionkey * 20 END AS max_total_chunks,
  CASE WHEN r_regionkey <> 2 THEN r_regionkey * 0.05e0 END AS similarity_threshold FROM region),
lim AS (SELECT group_id, greatest(1, least(20, coalesce(chunks_per_doc, 2))) AS per_doc, greatest(1, least(50, coalesce(max_total_chunks, 10))) AS total,
  greatest(0e0, least(1e0, coalesce(similarity_threshold, 0.1e0))) AS least_score FROM (SELECT DISTINCT source AS group_id FROM documents) LEFT JOIN se USING (group_id)),
sc AS (SELECT query_id, source AS group_id, doc_id, chunk_id, score FROM cos0 JOIN chunks USING (chunk_id) WHERE source = 'src' || (query_id % 20)),
pd AS (SELECT sc.*, total, per_doc, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id)::INT AS doc_rank
  FROM sc JOIN lim USING (group_id) WHERE score >= least_score)
SELECT query_id, group_id, doc_id, chunk_id, score, doc_rank, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM pd WHERE doc_rank <= per_doc) WHERE rank <= total"""


@query("scoped_retrieval", f"WITH {CHUNKS}, {COS_SQL}, {_SCOPED_SQL}")
def _scoped(spark, sf):
    """Each question searches its group's folder of stored vectors under the group's settings."""
    rows = cut_lineage(chunks(spark, sf))
    vectors, asked = _cosine(spark, sf, rows)
    path = scratch_path(spark, "group-vectors")
    scoped_search.write_group_vectors(vectors, rows.withColumnRenamed("source", "group_id"), path)
    asked = cut_lineage(asked.withColumn("group_id", F.concat(F.lit("src"), F.col("query_id") % 20)))
    r = F.col("r_regionkey")
    own = read_table(spark, sf, "region").select(
        F.concat(F.lit("src"), r).alias("group_id"), F.lit(None).cast("string").alias("provider"), (r * 2).alias("chunks_per_doc"),
        F.when(r != 1, r * 20).alias("max_total_chunks"), F.when(r != 2, r * F.lit(0.05)).alias("similarity_threshold"), F.lit(None).cast("string").alias("default_language"))
    settings = own.unionByName(spark.createDataFrame([("default", None, 2, None, 0.1, None)], own.schema))
    groups = documents(spark, sf).select(F.col("source").alias("group_id")).distinct()
    scored = scoped_search.scoped_scores(scoped_search.read_group_vectors(spark, path, asked), asked)
    return scoped_search.capped_by_group(scored, catalog.resolve_settings(groups, settings))


@query("knn_exact", """
WITH dims AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
m AS (SELECT label, d, avg(x) AS m FROM dims GROUP BY ALL), q AS (SELECT label::BIGINT AS query_id, list(m ORDER BY d) AS qe FROM m GROUP BY 1),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], qe), 6) AS score FROM embeddings, q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10""")
def _knn(spark, sf):
    vectors = read_table(spark, sf, "embeddings")
    return search.knn_exact(vectors, search.question_vectors(vectors, "label"))


@query("knn_ann")
def _ann(spark, sf):
    vectors = read_table(spark, sf, "embeddings")
    return code_search.knn_ann(vectors, search.question_vectors(vectors, "label"))


# model analyses, written from the retrieved rows
_ANALYSIS_SQL = """
ana AS (SELECT query_id, string_agg('Chunk ' || rank || ': ' || substr(chunk_text, 1, 50) || ' ' ||
    CASE rank % 3 WHEN 0 THEN 'Score: ' || ((rank * 7 + query_id) % 11) || '/10' WHEN 1 THEN ((rank + query_id) % 11) || ' out of 10' ELSE 'unscored' END,
    chr(10) ORDER BY rank) AS analysis FROM hits GROUP BY 1)"""


def _analyses(hits):
    c, r, q = F.col("chunk_text"), F.col("rank"), F.col("query_id")
    verdict = (F.when(r % 3 == 0, F.concat(F.lit("Score: "), (r * 7 + q) % 11, F.lit("/10")))
               .when(r % 3 == 1, F.concat((r + q) % 11, F.lit(" out of 10"))).otherwise("unscored"))
    line = F.concat(F.lit("Chunk "), r, F.lit(": "), F.substring(c, 1, 50), F.lit(" "), verdict)
    return hits.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(r.alias("r"), line.alias("l")))), lambda s: s["l"]), "\n").alias("analysis"))


_LLM_SQL = f"""{_ANALYSIS_SQL},
lpos AS (SELECT h.*, a.analysis, strpos(a.analysis, substr(h.chunk_text, 1, 50)) AS p, round(h.score / 100e0, 6) AS initial
  FROM hits h JOIN ana a USING (query_id)),
lspan AS (SELECT *, CASE WHEN p > 0 THEN substr(analysis, greatest(p - 101, 0) + 1, least(p + 299, length(analysis)) - greatest(p - 101, 0)) END AS sp FROM lpos),
llm AS (SELECT query_id, chunk_id, initial, coalesce({', '.join(
    f"CASE WHEN regexp_matches(sp, {lit('(?i)' + p)}) THEN regexp_extract(sp, {lit('(?i)' + p)}, 1)::DOUBLE / 10e0 END" for p in SCORE_PATTERNS)},
    initial) AS llm FROM lspan)"""


def _llm_scores(spark, sf):
    hits = hits_with_text(spark, sf)
    rows = hits.join(_analyses(hits), "query_id").withColumn("initial", F.round(F.col("score") / 100.0, 6))
    return context.extract_llm_scores(rows).select("query_id", "chunk_id", "initial", "llm")


@query("extract_llm_scores", f"WITH {HITS_SQL}, {_LLM_SQL} SELECT * FROM llm")
def _extract_llm(spark, sf):
    return _llm_scores(spark, sf)


@query("rerank", f"""WITH {HITS_SQL}, {_LLM_SQL},
fin AS (SELECT query_id, chunk_id, 0.89e0 * llm + 0.11e0 * initial AS f FROM llm),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, chunk_id)::INT AS rank, lead(f) OVER (PARTITION BY query_id ORDER BY f DESC, chunk_id) AS nxt,
   max(f) OVER (PARTITION BY query_id) AS best FROM fin)
SELECT query_id, chunk_id, round(f, 6) AS final_score, rank FROM rk WHERE rank = 1 OR (rank = 2 AND best - f <= 0.1e0)""")
def _rerank(spark, sf):
    return search.rerank(_llm_scores(spark, sf)).select(
        "query_id", "chunk_id", F.round("final_score", 6).alias("final_score"), "rank")


@query("relevant_documents")
def _relevant(spark, sf):
    hits = hits_with_text(spark, sf)
    cue = F.when(F.col("rank") % 4 == 0, " was not used").otherwise(" Used as source")
    line = F.concat(F.lit("Document: "), "filename", cue, F.lit("\nChunk "), "rank", F.lit(": Score "),
                    (F.col("rank") * 3) % 11, F.lit("/10"))
    log = hits.groupBy(F.col("query_id").alias("analysis_id")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), line.alias("l")))), lambda s: s["l"]), "\n").alias("text"))
    return context.relevant_documents(log)


@query("number_chunks", f"""WITH {HITS_SQL}
SELECT query_id, n, chunk_id, '[' || n || '] Chunk_' || chunk_id || ' from "' || filename || '":' || chr(10) || {trim_sql('chunk_text')} || chr(10) AS line FROM numbered""")
def _number(spark, sf):
    return context.number_chunks(hits_with_text(spark, sf)).select("query_id", "n", "chunk_id", "line")


_CONTEXT_SQL = r"""
lined AS (SELECT query_id, drank, rank, CASE WHEN rank = drank THEN '=== From Document: ' || filename || chr(10) ELSE '' END
   || '[chunk_' || chunk_id || ' from "' || filename || '" (lang: ' || lang || ')] ' || trim(regexp_replace(chunk_text, '\s+', ' ', 'g')) AS line FROM placed),
ctx AS (SELECT query_id, string_agg(line, chr(10) ORDER BY drank, rank) AS context FROM lined GROUP BY 1)"""


#: Sample bodies; a question picks one by its number, and number 2 has none.
TEMPLATES = {"plain": "Read this.\n{context}\nThen say: {query}", "short": "{query}\n---\n{context}"}
_TEMPLATE_SQL = "CASE item_id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'short' ELSE 'missing' END"


@query("assemble_context", f"""WITH {HITS_SQL}, {_CONTEXT_SQL}
SELECT query_id, {_TEMPLATE_SQL} AS template, context,
  CASE item_id % 3 WHEN 0 THEN 'Read this.' || chr(10) || context || chr(10) || 'Then say: ' || text
    WHEN 1 THEN text || chr(10) || '---' || chr(10) || context ELSE '' END AS prompt
FROM ctx JOIN benchmark ON item_id = query_id""")
def _assemble(spark, sf):
    built = context.assemble_context(hits_with_text(spark, sf))
    kind = F.col("query_id") % 3
    asked = questions(spark, sf).withColumnRenamed("text", "query").withColumn(
        "template", F.when(kind == 0, "plain").when(kind == 1, "short").otherwise("missing"))
    templates = spark.createDataFrame(list(TEMPLATES.items()), "name string, body string")
    return context.fill_prompt(built.join(asked, "query_id"), templates).drop("query")


@query("parse_context", f"""WITH {HITS_SQL}
SELECT query_id, n, filename AS document, filename, chunk_id, lang, trim(regexp_replace(chunk_text, '\\s+', ' ', 'g')) AS chunk_text FROM numbered""")
def _parse(spark, sf):
    return context.parse_context(context.assemble_context(hits_with_text(spark, sf)))


@query("context_language", f"""WITH {HITS_SQL},
dl AS (SELECT query_id, doc_id, lang, min(n) AS n FROM numbered GROUP BY ALL), cl AS (SELECT query_id, lang, count(*) AS c, min(n) AS f FROM dl GROUP BY ALL)
SELECT query_id, arg_max(lang, (c, -f)) AS context_lang FROM cl GROUP BY 1""")
def _context_language(spark, sf):
    return context.context_language(context.parse_context(context.assemble_context(hits_with_text(spark, sf))))


# logged answers, written from the numbered chunks
_ANSWERS_SQL = """
f13 AS (SELECT query_id, max(filename) FILTER (WHERE n = 1) AS f1, coalesce(max(filename) FILTER (WHERE n = 3), 'none.txt') AS f3 FROM numbered GROUP BY 1),
answers AS (SELECT query_id AS answer_id, CASE query_id % 5
   WHEN 0 THEN 'Answer: seen. USED CHUNKS: [1 from "' || f1 || '", 3 in ' || f3 || ']'
   WHEN 1 THEN 'Answer: 5 of them. Used chunks: [2, 1, 2]'
   WHEN 2 THEN 'As 3 and 1 and 3 show, 900 times'
   WHEN 3 THEN 'Used chunks: [77 from "' || f1 || '"] and 1'
   ELSE 'nothing to point at' END AS text FROM f13)"""


def _answers(numbered):
    f = numbered.groupBy("query_id").agg(
        F.max(F.when(F.col("n") == 1, F.col("filename"))).alias("f1"),
        F.coalesce(F.max(F.when(F.col("n") == 3, F.col("filename"))), F.lit("none.txt")).alias("f3"))
    kind = F.col("query_id") % 5
    text = (F.when(kind == 0, F.concat(F.lit('Answer: seen. USED CHUNKS: [1 from "'), "f1", F.lit('", 3 in '), "f3", F.lit("]")))
            .when(kind == 1, "Answer: 5 of them. Used chunks: [2, 1, 2]")
            .when(kind == 2, "As 3 and 1 and 3 show, 900 times")
            .when(kind == 3, F.concat(F.lit('Used chunks: [77 from "'), "f1", F.lit('"] and 1')))
            .otherwise("nothing to point at"))
    return f.select(F.col("query_id").alias("answer_id"), text.alias("text"))


_CITED_SQL = f"""{_ANSWERS_SQL},
sec AS (SELECT answer_id, text, regexp_matches(text, {lit('(?is)' + USED_SECTION)}) AS has, regexp_extract(text, {lit('(?is)' + USED_SECTION)}, 1) AS s FROM answers),
ent AS (SELECT answer_id, has, CASE WHEN has THEN CASE WHEN len(regexp_extract_all(s, {lit(USED_ENTRY)}, 1)) > 0 THEN regexp_extract_all(s, {lit(USED_ENTRY)}, 1)
   ELSE regexp_extract_all(s, '(\\d+)', 1) END ELSE regexp_extract_all(text, '(\\d+)', 1) END AS ns FROM sec),
cit AS (SELECT answer_id, has, (generate_subscripts(ns, 1) - 1)::INT AS pos, unnest(ns)::INT AS n FROM ent),
kn AS (SELECT answer_id, has, pos, n, chunk_id, filename FROM cit JOIN numbered USING (n) WHERE query_id = answer_id),
cited AS (SELECT answer_id, pos, n, chunk_id, filename FROM kn WHERE has
  UNION ALL SELECT answer_id, min(pos), min(n), chunk_id, filename FROM kn WHERE NOT has GROUP BY answer_id, chunk_id, filename
  UNION ALL SELECT answer_id, 0, n, chunk_id, filename FROM ent JOIN numbered ON query_id = answer_id AND n = 1
    WHERE NOT has AND answer_id NOT IN (SELECT answer_id FROM kn))""".replace("\\\\", "\\")


def _cited(spark, sf):
    numbered = context.number_chunks(hits_with_text(spark, sf))
    mapping = numbered.select(F.col("query_id").alias("answer_id"), "n", "chunk_id", "filename")
    return context.extract_citations(_answers(numbered), mapping)


@query("extract_citations", f"WITH {HITS_SQL}, {_CITED_SQL} SELECT * FROM cited")
def _citations(spark, sf):
    return _cited(spark, sf)


@query("answer_body", f"""WITH {HITS_SQL}, {_ANSWERS_SQL}
SELECT answer_id, trim(regexp_replace(text, '(?is)used chunks:.*$', '')) AS body FROM answers""")
def _body(spark, sf):
    answers = _answers(context.number_chunks(hits_with_text(spark, sf)))
    return answers.select("answer_id", context.answer_body(F.col("text")).alias("body"))


@query("citation_stats", f"""WITH {HITS_SQL}, {_CITED_SQL}
SELECT c.source, c.doc_id, count(*) AS n_citations, count(DISTINCT answer_id) AS n_answers, count(DISTINCT cited.chunk_id) AS n_chunks
FROM cited JOIN chunks c USING (chunk_id) GROUP BY 1, 2""")
def _citation_stats(spark, sf):
    where = chunks(spark, sf).select("chunk_id", "doc_id", "source")
    return context.citation_stats(_cited(spark, sf).join(where, "chunk_id"), ["source", "doc_id"])


@query("qa_pairs", """
SELECT conv_id, turn, question, text AS answer FROM (
  SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM conversations) WHERE role = 'assistant' AND question IS NOT NULL""")
def _qa(spark, sf):
    return qa_pairs(read_table(spark, sf, "conversations"))


def qa_pairs(conversations):
    """conv_id, turn, question, answer: the message before each assistant message."""
    seen = with_neighbours(conversations.select("conv_id", "turn", "role", "text"), ["conv_id"], "turn", ["text"])
    return seen.filter("role = 'assistant' and prev_text is not null").select(
        "conv_id", "turn", F.col("prev_text").alias("question"), F.col("text").alias("answer"))


_SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
SPANS_SQL = f"""
ndl AS (SELECT query_id, chunk_id, doc_id, {_SQUEEZE.format('d.text')} AS d,
   {_SQUEEZE.format("CASE WHEN query_id % 3 = 0 THEN h.chunk_text || ' #' ELSE h.chunk_text END")} AS nd
  FROM hits h JOIN documents d USING (doc_id)),
led AS (SELECT *, strpos(d, nd) > 0 AS exact, CASE WHEN strpos(d, nd) > 0 THEN nd
    WHEN len({words_sql('nd')}) >= 3 THEN array_to_string(({words_sql('nd')})[1:3], ' ') END AS ky FROM ndl),
pos AS (SELECT query_id, chunk_id, doc_id, strpos(d, ky) AS p FROM led WHERE strpos(d, ky) > 0
  UNION ALL SELECT p.query_id, p.chunk_id, p.doc_id, p.p + strpos(substr(l.d, p.p + 1), l.ky) FROM pos p JOIN led l USING (query_id, chunk_id)
    WHERE strpos(substr(l.d, p.p + 1), l.ky) > 0),
spn AS (SELECT query_id, chunk_id, l.doc_id, d, (p - 1)::INT AS start,
   (CASE WHEN exact THEN p - 1 + length(nd) WHEN strpos(substr(d, p), '.') > 0 THEN p - 1 + strpos(substr(d, p), '.') - 1
     ELSE least(p - 1 + length(nd) * 2, length(d)) END)::INT AS "end" FROM pos JOIN led l USING (query_id, chunk_id))"""


def _spans(spark, sf):
    hits = hits_with_text(spark, sf).select("query_id", "chunk_id", "doc_id", "chunk_text")
    needle = F.when(F.col("query_id") % 3 == 0, F.concat("chunk_text", F.lit(" #"))).otherwise(F.col("chunk_text"))
    docs = documents(spark, sf).select("doc_id", "text")
    hits = hits.repartition(spark.sparkContext.defaultParallelism, "chunk_id")  # few rows, heavy expressions
    return spans.find_spans(hits.withColumn("needle", needle).drop("chunk_text").join(docs, "doc_id"))


@query("find_spans", f"""WITH RECURSIVE {HITS_SQL}, {SPANS_SQL}
SELECT query_id, chunk_id, doc_id, start, "end", trim(substr(d, start + 1, "end" - start)) AS span_text FROM spn""")
def _find_spans(spark, sf):
    return _spans(spark, sf).select("query_id", "chunk_id", "doc_id", "start", "end", "span_text")


@query("merge_spans", f"""WITH RECURSIVE {HITS_SQL}, {SPANS_SQL},
one AS (SELECT doc_id, start, max("end") AS e FROM spn GROUP BY 1, 2),
rch AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM one),
isl AS (SELECT *, sum(CASE WHEN r IS NULL OR start >= r THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start) AS k FROM rch)
SELECT doc_id, min(start) AS start, max(e) AS "end", count(*) AS n_spans FROM isl GROUP BY doc_id, k""")
def _merge_spans(spark, sf):
    return spans.merge_spans(_spans(spark, sf), ["doc_id"])


_PHRASES = ["of the", "de la", "und der", "the and"]


@query("phrase_scan", f"""
SELECT doc_id, phrase, count(*) AS n FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '(?i)(?:{'|'.join(_PHRASES)})'))) AS phrase FROM documents) GROUP BY ALL""")
def _phrase_scan(spark, sf):
    return spans.phrase_scan(texts(spark, sf), "doc_id", _PHRASES)


@query("phrase_list_scan", f"""WITH w AS (SELECT {words_sql('lower(text)')} AS w FROM benchmark),
p AS (SELECT DISTINCT array_to_string(w[i:i + 2], ' ') AS phrase FROM (SELECT w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
d AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, phrase, sum((length(t) - length(replace(t, phrase, ''))) // length(phrase))::BIGINT AS n FROM d JOIN p ON contains(t, phrase) GROUP BY ALL""")
def _phrase_list_scan(spark, sf):
    """Three words in a row of any benchmark passage, searched in all documents."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\S+"), F.lit(0))
    listed = read_table(spark, sf, "benchmark").select(words.alias("w")).filter(F.size("w") > 2).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))).alias("phrase"))
    return phrases.phrase_list_scan(texts(spark, sf), "doc_id", listed)


@query("highlight_records", f"""WITH {HITS_SQL}
SELECT query_id, chunk_id, (chunk_index // 4 + 1)::INT AS page, 'x0=0;y0=' || (chunk_index % 4) * 200 AS coords
FROM hits JOIN (SELECT chunk_id, chunk_index FROM chunks) USING (chunk_id) WHERE chunk_index % 5 <> 4""")
def _highlight_records(spark, sf):
    i = F.col("chunk_index")
    layout = chunks(spark, sf).select(
        "chunk_id", F.when(i % 5 != 4, F.floor(i / 4).cast("int") + 1).alias("page"),
        F.concat(F.lit("x0=0;y0="), (i % 4) * 200).alias("coords"))
    return spans.highlight_records(bm25_hits(spark, sf), layout)
