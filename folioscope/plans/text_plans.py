"""Scans, sectioning, chunking and enrichment (S, P, C, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.text import (
    char_ngrams, extension, key_phrases, normalize_text, word_ngrams,
)
from folioscope.functions.vocab import MAX_BYTES, NO_INFO_PHRASES
from folioscope.operators import build, chunking, enrich, predicates
from folioscope.plans.inputs import chunks, documents, texts, titled
from folioscope.plans.registry import query
from folioscope.plans.sql_parts import (
    CHUNKS, ELEMENTS, TITLE_CHUNKS, char_grams_sql, importance_weight_sql, key_phrases_sql, language_sql, lit,
    normalize_list_sql, semantic_sql, trim_sql, word_grams_sql,
)
from folioscope.session import cut_lineage, read_table, scratch_path, spread
from folioscope.sources import corpus, html


@query("read_corpus", """
SELECT source AS group_id, (strlen(text) + 1)::BIGINT AS n_bytes, sha256(text || chr(10)) AS content_sha256, 'txt' AS extension FROM documents""")
def _read_corpus(spark, sf):
    """Every document as a text file below its group's folder, read back as files."""
    root = scratch_path(spark, "corpus")
    dealt = documents(spark, sf).repartition("source", F.pmod(F.xxhash64("doc_id"), F.lit(1024)))  # a large source goes to many tasks
    corpus.write_text_files(dealt.select("text", F.col("source").alias("group_id")), root)
    return corpus.read_corpus(spark, root).select(
        "group_id", "n_bytes", F.sha2("content", 256).alias("content_sha256"), extension(F.col("filename")).alias("extension"))


@query("size_guard", """
SELECT doc_id, strlen(text)::INT AS n_bytes, strlen(text) <= 8000 AS accepted FROM documents""")
def _size_guard(spark, sf):
    accepted, rejected = corpus.size_guard(documents(spark, sf), limit=8000)
    return accepted.unionByName(rejected).select("doc_id", "n_bytes", "accepted")


_HTML = r"""
clean AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g') AS h
  FROM pages),
marked AS (SELECT page_id, string_split(regexp_replace(h, '(?i)<(/?(?:""" + html.BLOCK_TAGS + r"""))\b[^>]*>', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS b FROM clean),
blocks AS (SELECT page_id, unnest(b) AS piece, generate_subscripts(b, 1) AS i FROM marked),
parts AS (SELECT page_id, i, CASE WHEN contains(piece, chr(2)) THEN lower(split_part(piece, chr(2), 1)) ELSE '' END AS tag,
  trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(
   CASE WHEN contains(piece, chr(2)) THEN split_part(piece, chr(2), 2) ELSE piece END, '<[^>]*>', ' ', 'g'),
   '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM blocks),
els AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS pos,
  CASE WHEN regexp_full_match(tag, 'title|h[1-6]') THEN 'Title' WHEN tag = 'li' THEN 'ListItem' ELSE 'NarrativeText' END AS kind, text
  FROM parts WHERE text <> '')"""


@query("html_elements", f"WITH {_HTML} SELECT page_id, pos, kind, text FROM els")
def _html_elements(spark, sf):
    return html.html_elements(spread(read_table(spark, sf, "pages"), "page_id"))


@query("html_links", r"""
SELECT page_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS href FROM (
 SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'),
        '(?i)<a\s[^>]*href=["'']([^"'']*)["'']', 1) AS l FROM pages)""")
def _html_links(spark, sf):
    return html.html_links(spread(read_table(spark, sf, "pages"), "page_id"))


@query("drop_blank", "SELECT conv_id, turn, text FROM conversations WHERE trim(text) <> ''")
def _drop_blank(spark, sf):
    return chunking.drop_blank(read_table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text")


@query("clean_table", """
SELECT d.doc_id, trim(coalesce(d.source, '')) AS source, trim(coalesce(l.quality::VARCHAR, '')) AS quality,
       trim(coalesce(l.toxic::VARCHAR, '')) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _clean_table(spark, sf):
    wide = documents(spark, sf).select("doc_id", "source").join(read_table(spark, sf, "labels"), "doc_id", "left")
    return predicates.clean_table(wide, keep=["doc_id"])


@query("no_info_answer", f"""
SELECT conv_id, turn, {' OR '.join(f"contains(lower(text), {lit(p)})" for p in NO_INFO_PHRASES)} AS no_info
FROM conversations WHERE role = 'assistant'""")
def _no_info(spark, sf):
    answers = read_table(spark, sf, "conversations").filter("role = 'assistant'")
    return answers.select("conv_id", "turn", predicates.no_info(F.col("text")).alias("no_info"))


@query("scope_filter", """
SELECT d.doc_id, d.source, b.item_id FROM documents d
JOIN benchmark b ON d.source = 'src' || (b.item_id % 20) AND d.doc_id = b.item_id""")
def _scope_filter(spark, sf):
    scopes = read_table(spark, sf, "benchmark").select(
        "item_id", F.concat(F.lit("src"), F.col("item_id") % 20).alias("source"), F.col("item_id").alias("doc_id"))
    return predicates.in_scope(documents(spark, sf).select("doc_id", "source"), scopes, ["source", "doc_id"])


@query("ownership_filter", """
SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def _ownership(spark, sf):
    users = read_table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return predicates.owned_by(read_table(spark, sf, "orders").select("o_orderkey", "o_custkey"), users, "o_custkey")


@query("target_document", """
WITH asked AS (SELECT conv_id * 1000000 + turn AS query_id, conv_id % 150 AS user_id,
    CASE WHEN conv_id % 3 = 0 THEN text ELSE '@' || (conv_id % 12) || ' ' || text END AS text
  FROM conversations WHERE role = 'user'),
docs AS (SELECT doc_id % 150 AS user_id, doc_id AS ord, doc_id || '_' || source || '.TXT' AS filename FROM documents),
parts AS (SELECT *, starts_with(text, '@') AS tagged, regexp_extract(text, '^@(\\S*)', 1) AS prefix FROM asked),
hit AS (SELECT q.query_id, arg_min(d.filename, d.ord) AS filename FROM parts q JOIN docs d
  ON q.user_id = d.user_id AND (NOT q.tagged OR starts_with(lower(d.filename), lower(q.prefix))) GROUP BY 1)
SELECT query_id, filename, CASE WHEN tagged THEN regexp_extract(text, '^@\\S* ?((?s).*)$', 1) ELSE text END AS query_text,
       CASE WHEN filename IS NULL THEN 'no document' END AS error FROM parts LEFT JOIN hit USING (query_id)""".replace("\\\\", "\\"))
def _target_document(spark, sf):
    conv = read_table(spark, sf, "conversations").filter("role = 'user'")
    asked = conv.select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("query_id"), (F.col("conv_id") % 150).alias("user_id"),
        F.when(F.col("conv_id") % 3 == 0, F.col("text"))
        .otherwise(F.concat(F.lit("@"), F.col("conv_id") % 12, F.lit(" "), F.col("text"))).alias("text"))
    docs = documents(spark, sf).select(
        (F.col("doc_id") % 150).alias("user_id"), F.col("doc_id").alias("ord"),
        F.concat("doc_id", F.lit("_"), "source", F.lit(".TXT")).alias("filename"))
    return predicates.target_document(asked, docs)


# ---------------------------------------------------------------- chunking

_MD = f"""{_HTML},
md AS (SELECT page_id, string_agg(CASE kind WHEN 'Title' THEN '# ' || text WHEN 'ListItem' THEN '- ' || text ELSE text END,
        chr(10) || chr(10) ORDER BY pos) AS text FROM els GROUP BY 1),
ml AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM md),
fl AS (SELECT *, trim(line) = '' AS blank,
  contains(line, 'def ') OR contains(line, 'class ') OR contains(line, 'import ') OR contains(line, 'return ') OR contains(line, 'print(')
  OR contains(line, 'if __name__') OR contains(line, '.py') OR contains(line, 'except:') OR contains(line, 'try:') OR contains(line, 'else:')
  OR contains(line, 'elif ') OR contains(line, '    ') OR contains(line, chr(9)) AS codey,
  length(regexp_extract(line, '^(\\s*)', 1)) AS indent, regexp_matches(line, '^\\s*#+ \\s*\\S.*\\S\\s*$') AS heading FROM ml),
-- mode: 0 none open, 1 paragraph, 2 code, 3 heading; sec counts opened sections
run AS (
  SELECT page_id, ln, CASE WHEN codey THEN 2 WHEN heading THEN 3 WHEN blank THEN 0 ELSE 1 END AS mode,
         CASE WHEN blank AND NOT codey THEN 0 ELSE 1 END AS sec, indent AS ci FROM fl WHERE ln = 0
  UNION ALL
  SELECT f.page_id, f.ln,
    CASE WHEN r.mode = 2 THEN CASE WHEN NOT f.blank AND NOT f.codey AND f.indent < r.ci THEN 1 ELSE 2 END
         WHEN f.codey THEN 2 WHEN f.heading THEN 3 WHEN f.blank THEN 0 ELSE 1 END,
    CASE WHEN r.mode = 2 THEN CASE WHEN NOT f.blank AND NOT f.codey AND f.indent < r.ci THEN r.sec + 1 ELSE r.sec END
         WHEN f.codey OR f.heading THEN r.sec + 1 WHEN f.blank THEN r.sec WHEN r.mode = 1 THEN r.sec ELSE r.sec + 1 END,
    CASE WHEN r.mode = 2 THEN r.ci ELSE f.indent END
  FROM run r JOIN fl f ON f.page_id = r.page_id AND f.ln = r.ln + 1)
""".replace("\\\\", "\\")


@query("sectionize", f"""WITH RECURSIVE {_MD}
SELECT r.page_id, (sec - 1)::INT AS section_no,
       CASE max(mode) WHEN 1 THEN 'paragraph' WHEN 2 THEN 'code' ELSE 'heading' END AS kind,
       string_agg(f.line, chr(10) ORDER BY f.ln) AS section_text
FROM run r JOIN fl f ON f.page_id = r.page_id AND f.ln = r.ln WHERE mode > 0 GROUP BY r.page_id, sec""")
def _sectionize(spark, sf):
    return chunking.sectionize(html.marked_text(spread(read_table(spark, sf, "pages"), "page_id")))


@query("title_chunks", f"""WITH RECURSIVE {TITLE_CHUNKS}
SELECT doc_id, chunk_index, chunk_text, page_number, title AS section_title FROM tchunks""")
def _title_chunks(spark, sf):
    return chunking.title_chunks(chunking.line_elements(texts(spark, sf).drop("source", "lang")))


@query("page_of_chunk", f"""WITH RECURSIVE {TITLE_CHUNKS}
SELECT doc_id, chunk_index, coalesce(page_number, (doc_id % 7)::INT) AS page_number FROM tchunks""")
def _page_of_chunk(spark, sf):
    docs = texts(spark, sf).withColumn("own_page", (F.col("doc_id") % 7).cast("int"))
    return chunking.title_chunks(chunking.line_elements(docs)).select("doc_id", "chunk_index", "page_number")


@query("window_chunks", f"WITH {CHUNKS} SELECT doc_id, chunk_index, chunk_text FROM chunks")
def _window_chunks(spark, sf):
    return chunking.window_chunks(texts(spark, sf).select("doc_id", "text"))


@query("sentence_chunks", f"""
WITH s AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?]+')) AS raw,
             generate_subscripts(string_split_regex(text, '[.!?]+'), 1) AS i FROM documents),
t AS (SELECT doc_id, i, {trim_sql('raw')} AS sent FROM s WHERE {trim_sql('raw')} <> ''),
b AS (SELECT *, coalesce(sum(length(sent) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 500 AS bucket,
        lag(sent) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM t)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY bucket) - 1)::INT AS chunk_index,
       concat_ws('. ', first(prev ORDER BY i), string_agg(sent, '. ' ORDER BY i)) || '.' AS chunk_text, count(*)::INT AS n_sentences
FROM b GROUP BY doc_id, bucket""")
def _sentence_chunks(spark, sf):
    return chunking.sentence_chunks(texts(spark, sf).select("doc_id", "text"))


@query("chunk_id", f"WITH {CHUNKS} SELECT doc_id, chunk_index, chunk_id FROM chunks")
def _chunk_id(spark, sf):
    return chunks(spark, sf).select("doc_id", "chunk_index", "chunk_id")


@query("section_path", f"""WITH RECURSIVE {TITLE_CHUNKS}
SELECT chunk_id, coalesce(path_parts[-1], 'Uncategorized') AS section_title, path_parts[-2] AS parent_section,
       array_to_string(path_parts, ' > ') || ' | general' AS context_label FROM tchunks""")
def _section_path(spark, sf):
    return titled(spark, sf).select("chunk_id", "section_title", "parent_section", "context_label")


# ---------------------------------------------------------------- enrichment


@query("semantic_type", f"""WITH {CHUNKS}, st AS ({semantic_sql('chunks', 'chunk_text')})
SELECT chunk_id, semantic_type, round(type_score, 6) AS type_score FROM st""")
def _semantic_type(spark, sf):
    return enrich.semantic_type(chunks(spark, sf).select("chunk_id", "chunk_text")).select(
        "chunk_id", "semantic_type", F.round("type_score", 6).alias("type_score"))


KEYWORDS_SQL = f"""
ktok AS (SELECT chunk_id, unnest(regexp_extract_all(lower(chunk_text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM tchunks),
ktf AS (SELECT chunk_id, term, count(*) AS tf FROM ktok WHERE length(term) >= 4 GROUP BY ALL),
kdf AS (SELECT term, count(*) AS df FROM ktf GROUP BY 1),
ktop AS (SELECT chunk_id, term FROM (SELECT chunk_id, term,
    row_number() OVER (PARTITION BY chunk_id ORDER BY round(tf * ln((SELECT count(*) FROM tchunks) / df::DOUBLE), 6) DESC, term) AS rn
  FROM ktf JOIN kdf USING (term)) WHERE rn <= 5),
kcap AS (SELECT chunk_id, unnest(list_transform(regexp_extract_all(regexp_replace(chunk_text, '([\\p{{L}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(2), 'g'),
    '\\x01([A-Z][a-zA-Z]*\\x02(?:\\s+\\x01[A-Z][a-zA-Z]*\\x02)*)', 1), lambda q: replace(replace(q, chr(1), ''), chr(2), ''))) AS term FROM tchunks),
kall AS (SELECT DISTINCT chunk_id, term FROM (SELECT * FROM ktop UNION ALL SELECT * FROM kcap WHERE length(term) >= 4)),
kws AS (SELECT chunk_id, term AS keyword, rn FROM (SELECT chunk_id, term,
    row_number() OVER (PARTITION BY chunk_id ORDER BY length(term) DESC, term) AS rn FROM kall) WHERE rn <= 10)"""


@query("keywords", f"""WITH RECURSIVE {TITLE_CHUNKS}, {KEYWORDS_SQL}
SELECT chunk_id, array_to_string(list(keyword ORDER BY rn), '; ') AS keywords FROM tchunks LEFT JOIN kws USING (chunk_id) GROUP BY 1""")
def _keywords(spark, sf):
    rows = cut_lineage(titled(spark, sf).select("chunk_id", "chunk_text"))
    return enrich.keywords(rows, "chunk_id", "chunk_text").select(
        "chunk_id", F.when(F.size("keywords") > 0, F.array_join("keywords", "; ")).alias("keywords"))


@query("key_phrases", f"""WITH {CHUNKS}
SELECT chunk_id, array_to_string(list_sort({key_phrases_sql('chunk_text')}), '; ') AS phrases FROM chunks""")
def _key_phrases(spark, sf):
    return chunks(spark, sf).select(
        "chunk_id", F.array_join(F.array_sort(key_phrases(F.col("chunk_text"))), "; ").alias("phrases"))


@query("normalize_text", f"""
SELECT conv_id, turn, array_to_string({normalize_list_sql('text')}, ' ') AS normalized FROM conversations""")
def _normalize(spark, sf):
    return read_table(spark, sf, "conversations").select("conv_id", "turn", normalize_text(F.col("text")).alias("normalized"))


@query("char_ngrams", f"""
SELECT conv_id, turn, len(g)::INT AS n_grams, list_min(g) AS first_gram, list_max(g) AS last_gram
FROM (SELECT conv_id, turn, {char_grams_sql('text')} AS g FROM conversations)""")
def _char_ngrams(spark, sf):
    g = read_table(spark, sf, "conversations").select("conv_id", "turn", char_ngrams(F.col("text")).alias("g"))
    return g.select("conv_id", "turn", F.size("g").alias("n_grams"), F.array_min("g").alias("first_gram"),
                    F.array_max("g").alias("last_gram"))


@query("word_ngrams", f"""
SELECT conv_id, turn, unnest({word_grams_sql('text')}) AS gram FROM conversations""")
def _word_ngrams(spark, sf):
    return read_table(spark, sf, "conversations").select("conv_id", "turn", F.explode(word_ngrams(F.col("text"))).alias("gram"))


_REFS = """
refs AS (SELECT c.chunk_id AS src, f.chunk_id AS dst FROM tchunks c JOIN (
    SELECT md5(chunk_text) AS h, arg_min(chunk_id, (doc_id, chunk_index)) AS chunk_id, min(doc_id) AS doc_id FROM tchunks GROUP BY 1) f
  ON md5(c.chunk_text) = f.h AND c.doc_id <> f.doc_id)"""


@query("importance", f"""WITH RECURSIVE {TITLE_CHUNKS}, {_REFS}, st AS ({semantic_sql('tchunks', 'chunk_text')}),
deg AS (SELECT chunk_id, count(*) AS ref_count FROM (SELECT src AS chunk_id FROM refs UNION ALL SELECT dst FROM refs) GROUP BY 1)
SELECT chunk_id, coalesce(ref_count, 0) AS ref_count,
  round(0.3e0 * least(coalesce(ref_count, 0) / 10e0, 1e0) + 0.2e0 * (1e0 - chunk_index / 100e0) + 0.5e0 * {importance_weight_sql('semantic_type')}, 6) AS importance
FROM st LEFT JOIN deg USING (chunk_id)""")
def _importance(spark, sf):
    from folioscope.operators.graph import first_occurrence_references
    base = titled(spark, sf)
    typed = enrich.semantic_type(base)
    refs = first_occurrence_references(base)
    return enrich.importance(typed, refs).select("chunk_id", "ref_count", F.round("importance", 6).alias("importance"))


@query("detect_language", f"""WITH {language_sql('dl', 'documents', 'doc_id', 'text')}
SELECT doc_id, lang, round(confidence, 6) AS confidence, id_hits FROM dl""")
def _detect_language(spark, sf):
    found = enrich.detect_language(texts(spark, sf).select("doc_id", "text"), ["doc_id"], "text")
    return found.withColumn("confidence", F.round("confidence", 6))


_MAIN = f"""{CHUNKS}, {language_sql('cl', 'chunks', 'source, doc_id, chunk_index', 'chunk_text')},
votes AS (SELECT source, CASE WHEN id_hits >= 2 THEN 'id' WHEN confidence > 0.5e0 THEN lang END AS vote,
   count(*) AS n, min((doc_id, chunk_index)) AS first FROM cl GROUP BY ALL),
main AS (SELECT source, coalesce(vote, 'en') AS main_lang FROM (SELECT *, row_number() OVER (
   PARTITION BY source ORDER BY vote IS NULL, n DESC, first) AS rn FROM votes) WHERE rn = 1)"""


def _main(spark, sf):
    found = enrich.detect_language(chunks(spark, sf), ["source", "doc_id", "chunk_index"], "chunk_text")
    return enrich.main_language(found.withColumn("ord", F.struct("doc_id", "chunk_index")), "source", "ord")


@query("main_language", f"WITH {_MAIN} SELECT * FROM main")
def _main_language(spark, sf):
    return _main(spark, sf)


@query("route_query_language", f"""WITH {_MAIN},
q AS (SELECT conv_id, turn, 'src' || (conv_id % 20) AS source, text FROM conversations WHERE role = 'user'),
{language_sql('ql', 'q', 'conv_id, turn, source', 'text')}
SELECT conv_id, turn, source, lang AS query_lang, coalesce(main_lang, 'en') AS chunk_lang, lang <> coalesce(main_lang, 'en') AS needs_translation
FROM ql LEFT JOIN main USING (source)""")
def _route(spark, sf):
    q = read_table(spark, sf, "conversations").filter("role = 'user'").select(
        "conv_id", "turn", F.concat(F.lit("src"), F.col("conv_id") % 20).alias("source"), "text")
    return enrich.route_query_language(q, ["conv_id", "turn"], "text", "source", _main(spark, sf))


VECTORS_SQL = """
vt AS (SELECT chunk_id, unnest(regexp_extract_all(lower(chunk_text), '[\\p{L}\\p{N}_]+')) AS term FROM chunks),
vtf AS (SELECT chunk_id, term, count(*) AS tf FROM vt GROUP BY ALL),
vdf AS (SELECT term, count(*) AS df FROM vtf GROUP BY 1),
vraw AS (SELECT chunk_id, term, tf * (ln((1e0 + (SELECT count(*) FROM chunks)) / (1e0 + df)) + 1e0) AS raw FROM vtf JOIN vdf USING (term)),
vec AS (SELECT chunk_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY chunk_id)) AS w FROM vraw)"""


@query("vectorize", f"""WITH {CHUNKS}, {VECTORS_SQL}
SELECT chunk_id, count(*) AS n_terms, round(sum(w * w), 6) AS norm, round(max(w), 6) AS top_weight,
       arg_max(term, (round(w, 6), term)) AS top_term FROM vec GROUP BY 1""")
def _vectorize(spark, sf):
    v = enrich.vectorize(cut_lineage(chunks(spark, sf).select("chunk_id", "chunk_text")), "chunk_id", "chunk_text")
    return v.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(F.sum(F.col("w") * F.col("w")), 6).alias("norm"),
        F.round(F.max("w"), 6).alias("top_weight"),
        F.max_by("term", F.struct(F.round("w", 6), "term")).alias("top_term"))


@query("chunk_build", f"""WITH RECURSIVE {TITLE_CHUNKS}, {KEYWORDS_SQL}, {_REFS}, st AS ({semantic_sql('tchunks', 'chunk_text')}),
deg AS (SELECT chunk_id, count(*) AS ref_count FROM (SELECT src AS chunk_id FROM refs UNION ALL SELECT dst FROM refs) GROUP BY 1),
kl AS (SELECT chunk_id, string_agg(keyword, '; ' ORDER BY rn) AS keywords FROM kws GROUP BY 1)
SELECT chunk_id, chunk_text AS text, doc_id, chunk_index, coalesce(path_parts[-1], 'Uncategorized') AS section_title, path_parts[-2] AS parent_section,
  semantic_type, coalesce(keywords, '') AS keywords, page_number, coalesce(ref_count, 0) AS ref_count,
  round(0.3e0 * least(coalesce(ref_count, 0) / 10e0, 1e0) + 0.2e0 * (1e0 - chunk_index / 100e0) + 0.5e0 * {importance_weight_sql('semantic_type')}, 6) AS importance_score,
  lang AS language, NULL::VARCHAR AS rejected FROM st LEFT JOIN deg USING (chunk_id) LEFT JOIN kl USING (chunk_id)
UNION ALL SELECT NULL, NULL, doc_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, lang,
  CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' ELSE 'too large' END FROM documents WHERE text IS NULL OR trim(text) = '' OR strlen(text) > 52428800""")
def _chunk_build(spark, sf):
    usable, rejected = build.split_usable(texts(spark, sf))
    built = build.chunk_build(usable).select(
        "chunk_id", "text", "doc_id", "chunk_index", "section_title", "parent_section", "semantic_type",
        F.array_join("keywords", "; ").alias("keywords"), "page_number", "ref_count",
        F.round("importance_score", 6).alias("importance_score"), F.col("metadata")["language"].alias("language"),
        F.lit(None).cast("string").alias("rejected"))
    return built.unionByName(rejected.select("doc_id", F.col("lang").alias("language"), F.col("reason").alias("rejected")), allowMissingColumns=True)
