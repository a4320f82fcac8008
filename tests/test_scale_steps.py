"""Steps that grow with the input and no faster: terms met by broadcast and shuffle, parts of bounded text, stored sequences."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from folioscope import session
from folioscope.operators import enrich, predicates, scoped_search
from folioscope.sources import catalog_json


def final_plan(df):
    """The plan that ran, as text."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark, n, seed=3):
    rng = random.Random(seed)
    rows = [(f"k{i}", " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(30)) + f" only{i}") for i in range(n)]
    return rows + [("k1", "w0 again again"), ("k2", ""), (None, "w0 nobody")]


def test_frequencies_of_common_and_rare_terms(spark, monkeypatch):
    rows = texts(spark, 50)
    df = spark.createDataFrame(rows, "k string, t string")
    counts = enrich.term_counts(df, "k", "t")
    tf = Counter((k, w) for k, t in rows for w in t.split())
    df_of = Counter(w for _, w in tf)
    for most in (0, 1, 20, 10_000):
        monkeypatch.setattr(enrich, "COMMON_TERMS", most)
        got = enrich.with_frequency(counts, "k", enrich.vocabulary(counts)).collect()
        # rows without a key have no map to come back with; no operator makes keys without a value
        assert {(r.k, r.term): (r.tf, r.df) for r in got if r.k} == {(k, w): (n, df_of[w]) for (k, w), n in tf.items() if k}
        assert len(got) == len(tf)


def test_keywords_move_each_text_once_and_look_up_no_phrase(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(f"k{i % 300}", f"The Fox {rng.choice(['Ran', 'Sat'])} with word{rng.randrange(40)} word{i} word{i} Long Name{i % 3}") for i in range(320)]
    rows += [("bare", ""), ("bare2", None), ("short", "a b c"), (None, "Nobody knows these words")]
    df = spark.createDataFrame(rows, "k string, t string")
    text, seen = {}, Counter(w for _, t in rows for w in set((t or "").lower().split()) if len(w) >= 4)
    for k, t in rows:
        text.setdefault(k, []).append(t or "")
    expected = {}
    for k, ts in text.items():
        tf = Counter(w for t in ts for w in t.lower().split() if len(w) >= 4)
        terms = sorted(tf, key=lambda w: (-round(tf[w] * math.log(len(rows) / seen[w]), 6), w))[:5]
        phrases = {m for t in ts for m in re.findall(r"\b[A-Z][a-zA-Z]*\b(?:\s+[A-Z][a-zA-Z]*\b)*", t) if len(m) >= 4}
        expected[k] = sorted(phrases | set(terms), key=lambda w: (-len(w), w))[:10]
    for most in (0, 20, 10_000):
        monkeypatch.setattr(enrich, "COMMON_TERMS", most)
        found = enrich.keywords(df, "k", "t")
        plan = final_plan(found)
        assert {r.k: r.keywords for r in found.collect()} == expected
        assert "phrase#" not in plan or most > 300  # with rarer terms, what is looked up and joined holds no phrase rows
        assert plan.count("regexp_extract_all(t#") == 0 or most > 300  # nor does it open the texts again


def test_parts_grow_with_the_text(spark, monkeypatch):
    df = spark.createDataFrame(texts(spark, 200), "k string, t string")
    size = df.agg(F.sum(F.octet_length("t"))).first()[0]
    monkeypatch.setattr(session, "PART_BYTES", size // 64)
    assert session.dealt(df, "k", "t").rdd.getNumPartitions() >= 64
    assert enrich.term_counts(df, "k", "t").rdd.getNumPartitions() >= 64


def test_json_texts_in_files_and_in_sequences(spark):
    one, many = session.scratch_path(spark, "json"), session.scratch_path(spark, "json")
    spark.createDataFrame([('{"chunk_0":\n {"text": "a"}}\n',)], "value string").coalesce(1).write.text(one)
    got = catalog_json.chunk_maps(catalog_json.read_json_texts(spark, one)).select("chunk_key", "text").collect()
    assert [tuple(r) for r in got] == [("chunk_0", "a")]
    rows = spark.createDataFrame([(f"g{i % 2}", f"line\nbreak \x1e {i}") for i in range(30)], "g string, t string")
    maps = rows.select("g", F.to_json(F.create_map(F.lit("chunk_0"), F.struct(F.col("t").alias("text")))).alias("value")).coalesce(1)
    catalog_json.write_json_sequences(maps, many, "g")
    read = catalog_json.chunk_maps(catalog_json.read_json_texts(spark, many))
    assert sorted(r["text"] for r in read.collect()) == sorted(f"line\nbreak \x1e {i}" for i in range(30))
    assert read.select("path").distinct().count() == 2  # not a file for each text


def test_target_document_meets_beginnings_not_documents(spark):
    rng = random.Random(5)
    docs = [(rng.choice([1, 2, None]), i, rng.choice([f"{i}_A.TXT", f"{i % 7}é_b.txt", None])) for i in range(60)]
    asked = [(q % 70, rng.choice([1, 2, 3, None]), rng.choice([None, "@", "@1", "@12 x", "@0É_B rest", "plain", f"@{q}_a.txt", "@" + "1" * 50])) for q in range(120)]
    found = predicates.target_document(spark.createDataFrame(asked, "query_id long, user_id long, text string"),
                                       spark.createDataFrame(docs, "user_id long, ord long, filename string"))
    best = {}
    for q, u, t in asked:
        for du, o, name in docs:
            if u is None or du != u or t is None:
                continue
            if not t.startswith("@") or (name is not None and name.lower().startswith(t[1:].split(" ")[0].lower())):
                if q not in best or o < best[q][0]:
                    best[q] = (o, name)
    assert {(r.query_id, r.filename) for r in found.collect()} == {(q, best.get(q, (0, None))[1]) for q, _, _ in asked}
    joins = [line for line in final_plan(found).splitlines() if "Join" in line and "user_id" in line]
    assert joins and all("startswith" not in line.lower() for line in joins)  # no condition is tried on pairs of a user


def test_group_vectors_are_written_where_they_are(spark):
    path = session.scratch_path(spark, "vectors")
    chunks = spark.createDataFrame([(f"c{i}", f"g{i % 3}", i) for i in range(30)], "chunk_id string, group_id string, doc_id long")
    vectors = spark.createDataFrame([(f"c{i}", t, 0.5) for i in range(30) for t in ("b", "a")], "chunk_id string, term string, w double")
    scoped_search.write_group_vectors(vectors, chunks, path)
    read = scoped_search.read_group_vectors(spark, path, spark.createDataFrame([("g1",)], "group_id string"))
    assert sorted((r.chunk_id, r.term, r.doc_id) for r in read.collect()) == sorted((f"c{i}", t, i) for i in range(1, 30, 3) for t in "ab")
    for file in {r[0] for r in read.select(F.input_file_name()).collect()}:
        terms = [r.term for r in spark.read.parquet(file).collect()]
        assert terms == sorted(terms)
