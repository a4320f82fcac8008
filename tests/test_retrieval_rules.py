"""Citations, context, spans, reranking, vector search."""

import random

from pyspark.sql import functions as F

from folioscope.operators import code_search, context, search, similarity, spans


def test_citation_tiers(spark):
    answers = spark.createDataFrame([
        ("files", 'Yes. Used Chunks: [2 from "b.txt", 1 in a.txt, 2 of "b.txt"]'),
        ("numbers", "5. USED CHUNKS: [3, 1]"),
        ("unknown", "1 and 2. Used chunks: [9 from x]"),
        ("loose", "see 3, 1, 3 and 99999999999999"),
        ("none", "nothing")], "answer_id string, text string")
    mapping = spark.createDataFrame([(a, n, f"c{n}", f"f{n}") for a in ("files", "numbers", "unknown", "loose", "none") for n in (1, 2, 3)],
                                    "answer_id string, n int, chunk_id string, filename string")
    got = {}
    for r in sorted(context.extract_citations(answers, mapping).collect(), key=lambda r: r.pos):
        got.setdefault(r.answer_id, []).append(r.n)
    assert got == {"files": [2, 1, 2], "numbers": [3, 1], "loose": [3, 1], "none": [1]}
    body = answers.select(context.answer_body(F.col("text")).alias("b")).collect()[0].b
    assert body == "Yes."


def test_parse_context(spark):
    text = "\n".join([
        "[chunk_0 from \"lost.txt\"] before any header", "=== From Document: A", "[chunk_1 from \"a b.txt\" (lang: en)] first",
        "untagged", "=== From Document: B", "[chunk_2 from bare.txt, (lang: id)] second", "=== From Document: A",
        "[chunk_3] third", "=== From Document: C", "no chunks here"])
    rows = sorted(context.parse_context(spark.createDataFrame([(1, text)], "query_id long, context string")).collect(), key=lambda r: r.n)
    assert [(r.n, r.document, r.filename, r.chunk_id, r.lang, r.chunk_text) for r in rows] == [
        (1, "A", "A", "3", "", "third"), (2, "B", "bare.txt", "2", "id", "second")]


def test_relevant_documents(spark):
    text = ('Document: good.pdf\nChunk 1: Score 3/10\n' + "x" * 120 + '\nSource: bad.txt\nthis one is unrelated to it\n' + "y" * 120
            + '\nDocument: high.txt\nnot used at all\nChunk 2: 9/10\n' + "z" * 120 + '\nFrom "quoted name.doc" we read')
    got = {r.document for r in context.relevant_documents(
        spark.createDataFrame([(1, text)], "analysis_id long, text string")).collect()}
    assert got == {"good.pdf", "high.txt", "quoted name.doc"}


def test_rerank_gap(spark):
    rows = spark.createDataFrame([(1, "a", 0.9, 0.5), (1, "b", 0.8, 0.5), (1, "c", 0.7, 0.5), (2, "a", 0.9, 0.5), (2, "b", 0.5, 0.5),
                                  (3, "a", 0.1, 0.1)], "query_id long, chunk_id string, llm double, initial double")
    got = {(r.query_id, r.chunk_id) for r in search.rerank(rows).collect()}
    assert got == {(1, "a"), (1, "b"), (2, "a"), (3, "a")}


def test_find_spans(spark):
    rows = spark.createDataFrame([(1, "aaaa", "aa"), (2, "one two three four. end", "one two three five"), (3, "x one two three", "one two three zzz"),
                                  (4, "nothing here", "no hit"), (5, r"a \E b \E", r"\E")], "id long, text string, needle string")
    got = {}
    for r in spans.find_spans(rows).collect():
        got.setdefault(r.id, set()).add((r.start, r.end))
    assert got == {1: {(0, 2), (1, 3), (2, 4)}, 2: {(0, 18)}, 3: {(2, 15)}, 5: {(2, 4), (7, 9)}}


def test_merge_spans_across_slices(spark):
    rows = [(1, 0, 5), (1, 0, 8), (1, 8, 10), (1, 9, 30), (1, 25, 26), (2, 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int")
    for width in (4, 10, 65536):
        got = sorted((r.doc_id, r.start, r.end, r.n_spans) for r in spans.merge_spans(df, ["doc_id"], width).collect())
        assert got == [(1, 0, 8, 1), (1, 8, 30, 3), (2, 3, 4, 1)]


def test_knn_blocks_and_recall(spark):
    rnd = random.Random(3)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(16)]
    base = spark.createDataFrame([(i, vec()) for i in range(300)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(i, vec()) for i in range(25)], "query_id long, embedding array<double>")
    one = {tuple(r) for r in search.knn_exact(base, q, 5).collect()}
    many = {tuple(r) for r in search.knn_exact(base, q, 5, block=4).collect()}
    assert one == many and len(one) == 125
    near = {(r.query_id, r.vec_id) for r in code_search.knn_ann(base, q, 5).collect()}
    assert len(near & {(a, b) for a, b, *_ in one}) / 125 > 0.8


def test_term_scores_by_block(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"w{i % 7} w{i % 3} common") for i in range(60)], "chunk_id string, chunk_text string")
    asked = spark.createDataFrame([(i, f"w{i} common common") for i in range(7)], "query_id long, text string")
    index = search.bm25_index(chunks)
    stats = search.index_stats(index)
    weights = search.bm25_weights(index, stats, asked)
    impact = index.withColumn("impact", F.col("tf") * 1.0)
    one = {tuple(r) for r in search.score_terms(impact, weights, threshold=0.0001).collect()}
    many = {tuple(r) for r in search.score_terms(impact, weights, threshold=0.0001, block=3).collect()}
    plain = {(r.query_id, r.chunk_id, r.s) for r in impact.join(weights, "term").groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.col("impact") * F.col("weight")), 6).alias("s")).collect()}
    assert one == many == plain


def test_similarity_edges(spark):
    rows = spark.createDataFrame([(1, "Same Text here now", "Same Text here now"), (2, "aa bb cc", "dd ee ff"), (3, "", ""), (4, "ab", "ab")],
                                 "id long, a string, b string")
    got = {r.id: r for r in rows.select("id", similarity.word_jaccard(F.col("a"), F.col("b")).alias("w"),
                                        similarity.ngram_similarity(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got[1].w == 1.0 and abs(got[1].n - 1.0) < 1e-9
    assert got[2].w == 0.0 and got[3].w == 0.0 and got[4].n == 0.0 and got[4].w == 1.0


def test_overlap_join_against_all_pairs(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    text = lambda: ". ".join(" ".join(rnd.choice(vocab) for _ in range(6)) + " iPhone 7" for _ in range(3))
    left = [(i, text()) for i in range(12)]
    right = [(i, text() + ". " + left[i][1].split(". ")[0] + " w1") for i in range(12)]
    a, b = spark.createDataFrame(left, "lid long, text string"), spark.createDataFrame(right, "rid long, text string")
    found = {(r.lid, r.rid): r.best for r in similarity.sentence_overlap(a, b, ["lid"], ["rid"]).collect()}
    # brute force over every sentence pair, with the same frequencies
    from pyspark.sql import functions as fn
    ls, rs = similarity._long_sentences(a, ["lid"], "text"), similarity._long_sentences(b, ["rid"], "text")
    body = similarity._leading_terms(ls.select("sid", "sentence").unionByName(rs.select("sid", "sentence")), 0.375)
    vec = {r.sid: dict(zip(r.terms, r.weights)) for r in body.collect()}
    pairs = ls.crossJoin(rs.select("rid", fn.col("sid").alias("rsid"), fn.col("sentence").alias("rsent")))
    want = {}
    rows = [(r.lid, r.rid, sum(w * vec[r.rsid].get(t, 0.0) for t, w in vec[r.sid].items()), r.sentence, r.rsent) for r in pairs.collect()]
    scored = spark.createDataFrame(rows, "lid long, rid long, c double, x string, y string").select(
        "lid", "rid", fn.round(similarity.weighted_similarity(fn.col("c"), fn.col("x"), fn.col("y")), 6).alias("s"))
    for r in scored.collect():
        if r.s > 0.75:
            want[(r.lid, r.rid)] = max(r.s, want.get((r.lid, r.rid), 0))
    assert want and found == want


def test_knn_of_text_ids_and_zero_vectors(spark):
    base = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("zero", [0.0, 0.0]), ("up", [0.0, 1.0])], "vec_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 0.0])], "query_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, r["rank"]) for r in search.knn_exact(base, q, 3).collect()]
    assert sorted(got, key=lambda r: r[2]) == [(1, "a", 1), (1, "b", 2), (1, "up", 3)]


def test_prompt_is_filled_once(spark):
    rows = spark.createDataFrame([(1, "what is {context}?", "CTX {query}", "t"), (2, "q", "c", "none")], "id long, query string, context string, template string")
    bodies = spark.createDataFrame([("t", "{context}|{query}|{query}{x}")], "name string, body string")
    got = {r.id: r.prompt for r in context.fill_prompt(rows, bodies).collect()}
    assert got == {1: "CTX {query}|what is {context}?|what is {context}?{x}", 2: ""}


def test_a_pair_scores_the_same_in_any_company(spark):
    pair, others = (1, "the red fox ran home", "the red dog ran away"), [(i, f"the fox {i} ran", f"red dog {i} home") for i in range(2, 40)]
    score = lambda rows: {r.id: r.similarity for r in similarity.combined_similarity(
        spark.createDataFrame(rows, "id long, a string, b string"), ["id"], "a", "b").collect()}
    assert abs(score([pair])[1] - score([pair, *others])[1]) < 1e-12


def test_an_admin_opens_rows_to_nobody_else(spark):
    from folioscope.operators import catalog
    rows = spark.createDataFrame([(1, "g"), (2, "h")], "doc_id long, group_id string")
    member = spark.createDataFrame([(7, "g"), (7, "g"), (8, "x")], "user_id long, group_id string")
    asked = spark.createDataFrame([(7, "user"), (8, None), (9, "admin")], "user_id long, role string")
    got = sorted((r.user_id, r.doc_id) for r in catalog.access_semi_join(rows, member, asked).collect())
    assert got == [(7, 1), (9, 1), (9, 2)]


def test_one_large_group_is_opened_by_several_tasks(spark):
    from folioscope.operators import catalog
    rows = spark.range(3000).selectExpr("id as doc_id", "1 as group_id", "id as _lane").coalesce(1)
    member = spark.range(50).selectExpr("id as user_id", "1 as group_id").coalesce(1)
    asked = member.selectExpr("user_id", "'user' as role")
    got = catalog.access_semi_join(rows, member, asked)
    assert got.columns == ["group_id", "doc_id", "_lane", "user_id"]
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 150_000 and got.distinct().count() == 150_000
    assert max(sizes) <= 75_000  # it was all of them in one


def test_no_visible_word_of_a_page_is_lost(spark):
    from folioscope.sources import html
    page = "<body>top<div class=ad>one <b>two</b></div><p>open <p>three<table><tr><td>x&amp;y</td></tr></table><pre>four</pre><script>gone</script><li>item</body>"
    rows = html.html_elements(spark.createDataFrame([(1, page)], "page_id long, html string")).orderBy("pos").collect()
    assert [(r.kind, r.text) for r in rows] == [("NarrativeText", "top"), ("NarrativeText", "one two"), ("NarrativeText", "open"), ("NarrativeText", "three"),
                                                ("NarrativeText", "x&y"), ("NarrativeText", "four"), ("ListItem", "item")]
