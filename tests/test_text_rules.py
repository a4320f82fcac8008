"""Hand fixtures: one per rule, with rows worked out by hand."""

import re

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.vocab import SEMANTIC_TYPES, java_pattern
from folioscope.operators import chunking, enrich, predicates
from folioscope.sources import corpus


def sections(spark, body):
    rows = chunking.sectionize(spark.createDataFrame([(1, body)], "doc_id long, text string")).collect()
    return [(r.kind, r.section_text) for r in sorted(rows, key=lambda r: r.section_no)]


def test_headings_and_paragraphs(spark):
    assert sections(spark, "# Top title\none\ntwo\n\nthree") == [
        ("heading", "# Top title"), ("paragraph", "one\ntwo"), ("paragraph", "three")]
    assert sections(spark, "#no space\n# x") == [("paragraph", "#no space\n# x")]
    assert sections(spark, "") == []


def test_indented_code_ends_at_smaller_indent(spark):
    assert sections(spark, "intro\n    def f():\n\n      return 1\n  back here\nmore") == [
        ("paragraph", "intro"), ("code", "    def f():\n\n      return 1"), ("paragraph", "  back here\nmore")]


def test_margin_code_never_ends(spark):
    assert sections(spark, "import os\nplain\n\n# Heading here") == [("code", "import os\nplain\n\n# Heading here")]


def title_rows(spark, elements):
    df = spark.createDataFrame([(1, elements)], "doc_id long, elements array<struct<kind:string,text:string,page:int>>")
    rows = sorted(chunking.title_chunks(df).collect(), key=lambda r: r.chunk_index)
    return [(r.chunk_text, r.page_number, r.section_title) for r in rows]


def test_title_chunks_limits(spark):
    a, b = "a" * 499, "b" * 500
    assert [t[0] for t in title_rows(spark, [("NarrativeText", a, None), ("Title", "T", 2)])] == [a + "\n\nT"]
    assert [t[0] for t in title_rows(spark, [("NarrativeText", b, 3), ("Title", "T", 4)])] == [b, "T"]
    c = "c" * 800
    assert [t[0] for t in title_rows(spark, [("NarrativeText", c, 1), ("NarrativeText", "x", 1)])] == [c, "x"]
    assert [len(t[0]) for t in title_rows(spark, [("NarrativeText", "d" * 2500, 1)])] == [1000, 1000, 500]


def test_page_and_title_of_chunk(spark):
    got = title_rows(spark, [("Title", "Head", None), ("NarrativeText", "z" * 600, 7)])
    assert got == [("Head\n\n" + "z" * 600, 7, "Head")]


def test_windows_reassemble(spark):
    body = "".join(chr(97 + i % 26) for i in range(1337))
    rows = chunking.window_chunks(spark.createDataFrame([(1, body)], "doc_id long, text string")).orderBy("chunk_index").collect()
    joined = rows[0].chunk_text + "".join(r.chunk_text[50:] for r in rows[1:])
    assert joined == body and all(len(r.chunk_text) <= 500 for r in rows)


def test_section_path(spark):
    rows = chunking.section_path(spark.createDataFrame([("a/b//c",), ("",)], "path string")).collect()
    assert [(r.section_title, r.parent_section, r.context_label) for r in rows] == [
        ("c", "b", "a > b > c | general"), ("Uncategorized", None, " | general")]


def test_language_rules(spark):
    texts = [(1, ""), (2, "yang"), (3, "yang dan pasar"), (4, "yang dan pasar besar"), (5, "the house and the garden of it"),
             (6, "le chat est dans la maison avec nous")]
    rows = {r.id: (r.lang, round(r.confidence, 3)) for r in enrich.detect_language(
        spark.createDataFrame(texts, "id long, t string"), ["id"], "t").collect()}
    assert rows[1] == ("en", 0.0) and rows[2] == ("en", 0.0)
    assert rows[4] == ("id", 0.9)
    assert rows[3][0] == "id" and rows[3][1] != 0.9  # three words: the classifier decides
    assert rows[5][0] == "en" and rows[6][0] == "fr"


def python_type(text):
    best = ("GENERAL", 1.0)
    top = 0.0
    for name, patterns, keys, inds in SEMANTIC_TYPES:
        low = text.lower()
        s = sum(bool(re.search(p, text, re.I | re.M)) for p in patterns) / len(patterns) * 0.4
        s += sum(k in low for k in keys) / len(keys) * 0.3
        s += sum(i in low for i in inds) / len(inds) * 0.2
        if name == "EXAMPLE":
            parts = [p for p in re.split("[.!?]+", text) if p.strip()]
            s += sum(bool(re.search(r"\b(?:like|such)\b", p, re.I)) for p in parts) / max(1, len(parts)) * 0.1
        if s >= 0.5 and s > top:
            best, top = (name, s), s
    return best


def test_semantic_types_against_brute_force(spark):
    texts = [
        "Definition: a cell is defined as a unit. It means life. It refers to parts. These are the known as called described as understood as define.",
        "Steps: 1. First, open the lid. Then follow these steps in sequence; next the process, method, procedure, guide, how to, workflow instruction. Finally, stop. Lastly, rest following.",
        "For example: consider the case such as sample, e.g. a scenario, i.e. an instance, illustration: demonstration like this.",
        "What is the question? Why ask, who can explain, when, where, how: query: what is it? I wonder about the problem and inquire?",
        "nothing of note here",
    ]
    rows = enrich.semantic_type(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, chunk_text string")).collect()
    for r in rows:
        name, score = python_type(r.chunk_text)
        assert (r.semantic_type, round(r.type_score, 9)) == (name, round(score, 9))
    assert len({r.semantic_type for r in rows}) >= 3


def test_patterns_agree_with_python(spark):
    texts = ["Étude XIV du Café99 A", "costs 3.5 kg or 12 percent", 'said "a b" and Éa', "1,5km 7 miles 3 kgs"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.key_phrases(F.col("t")).alias("p")).collect()
    for r in rows:
        want = set(re.findall(r"\b[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*\b", r.t))
        want |= set(re.findall(r"\b\d+(?:[.,]\d+)?(?:\s*(?:%|percent|kg|km|miles|dollars|euros))?\b", r.t.lower()))
        want |= set(re.findall(r'"([^"]+)"', r.t)) | set(re.findall(r"\b(?:[A-Z][a-z]+(?:\d+)?|[A-Z]{2,})\b", r.t))
        assert set(r.p) == want
    assert java_pattern("x", "im") == "(?imdU)x"


def test_no_info_and_target_document(spark):
    asked = spark.createDataFrame([(1, 1, "@re what is it"), (2, 1, "@re"), (3, 1, "@zz x"), (4, 1, "plain"), (5, 9, "plain")],
                                  "query_id long, user_id long, text string")
    docs = spark.createDataFrame([(1, 1, "Alpha.txt"), (1, 2, "Report.txt"), (1, 3, "rest.txt")], "user_id long, ord long, filename string")
    rows = {r.query_id: (r.filename, r.query_text, r.error) for r in predicates.target_document(asked, docs).collect()}
    assert rows == {1: ("Report.txt", "what is it", None), 2: ("Report.txt", "", None), 3: (None, "x", "no document"),
                    4: ("Alpha.txt", "plain", None), 5: (None, "plain", "no document")}


def test_text_files(spark):
    files = spark.createDataFrame([("a.TXT", b"h\xc3\xa9"), ("b.md", b"\xff\xfe\xfa"), ("c.pdf", b"x"), ("d.txt", None), ("e.txt", b"x" * 20)],
                                  "filename string, content binary")
    good, bad = corpus.read_text_files(files, limit=10)
    assert [(r.filename, r.text) for r in good.collect()] == [("a.TXT", "hé")]
    assert {r.filename: r.reason for r in bad.collect()} == {
        "b.md": "not utf-8", "c.pdf": "unsupported type", "d.txt": "no content", "e.txt": "too large"}


def test_chunking_is_linear_in_the_document():
    """Four times the lines take about four times as long; the bound leaves room for a noisy machine."""
    import time

    from folioscope.operators.chunking import sections_of, title_chunks_of
    from folioscope.operators.spans import spans_of

    def seconds(fn):
        best = 1e9
        for _ in range(3):
            t = time.thread_time()
            fn()
            best = min(best, time.thread_time() - t)
        return best

    def body(n):
        return "\n".join("some words in a line of text number " + str(i % 10) + ("\n" if i % 3 == 0 else "") for i in range(n))

    small, large = body(16_000), body(64_000)
    for fn in (sections_of, lambda t: spans_of(t, "in a line"),
               lambda t: title_chunks_of([{"kind": "Title" if i % 9 == 0 else "T", "text": x, "page": None} for i, x in enumerate(t.split("\n"))], None, 1000, 800, 500)):
        assert seconds(lambda fn=fn: fn(large)) < 9 * seconds(lambda fn=fn: fn(small))


def test_a_very_long_document_is_chunked(spark):
    body = "\n".join(f"line {i} of a long document that has very many lines in it" for i in range(64_000))
    docs = spark.createDataFrame([(1, body)], "doc_id long, text string")
    assert chunking.window_chunks(docs).count() == -(-(len(body) - 50) // 450)
    assert chunking.title_chunks(chunking.line_elements(docs)).agg(F.max("chunk_index")).first()[0] > 3000
    assert chunking.sectionize(docs).count() == 1 and chunking.sentence_chunks(docs).count() == 1
