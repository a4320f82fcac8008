"""Shape of physical plans, stores and streams."""

from pyspark.sql import functions as F

from folioscope.operators import chunking, enrich
from folioscope.operators.windows import top_k
from folioscope.plans import ORACLES, QUERIES
from folioscope.session import scratch_path
from folioscope.sources import catalog_json, index_store

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_is_named_and_most_have_sql():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"knn_ann", "relevant_documents"}


def test_expression_operators_stay_in_the_jvm(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    text = plan(enrich.semantic_type(docs, "text"))
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text


def test_chunkers_are_one_arrow_pass_without_a_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for df in (chunking.sectionize(docs), chunking.window_chunks(docs), chunking.sentence_chunks(docs)):
        text = plan(df)
        assert text.count("MapInArrow") == 1 and "EvalPython" not in text and "Exchange" not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(QUERIES["chunk_counts"](spark, SF))
    assert "n_chars:" not in text.split("ReadSchema")[1]


def test_top_k_is_limited_before_the_shuffle(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("source", "doc_id", "n_chars")
    assert "WindowGroupLimit" in plan(top_k(df, ["source"], [F.desc("n_chars"), F.col("doc_id")], 3))


def test_no_cartesian_products(spark):
    for name in ("access_counts", "resolve_settings", "memberships", "group_report", "target_document", "catalog_listing"):
        assert "CartesianProduct" not in plan(QUERIES[name](spark, SF)), name


def test_index_delete_and_rewrite(spark):
    path = scratch_path(spark, "test-index")
    rows = spark.createDataFrame([("g1", 1, "a"), ("g1", 2, "b"), ("g2", 3, "c")], "group_id string, doc_id long, filename string")
    index_store.write_index(rows, path)
    index_store.delete_from_index(spark, path, spark.createDataFrame([("g1", "a"), ("g2", "c")], "group_id string, filename string"))
    assert [(r.group_id, r.filename) for r in spark.read.parquet(path).collect()] == [("g1", "b")]


def test_index_delete_of_odd_group_names(spark):
    path = scratch_path(spark, "test-index")
    rows = spark.createDataFrame([("a:b", 1, "x"), ("a:b", 2, "y"), ("c/d e%", 3, "x"), (None, 4, "x"), (None, 5, None), ("z", 6, "x")],
                                 "group_id string, doc_id long, filename string")
    index_store.write_index(rows, path)
    gone = [("a:b", "x"), ("a:b", "y"), ("c/d e%", "x"), (None, "x"), (None, None), ("q", "x")]
    index_store.delete_from_index(spark, path, spark.createDataFrame(gone, "group_id string, filename string"))
    assert [(r.group_id, r.doc_id) for r in spark.read.parquet(path).collect()] == [("z", 6)]


def test_settings_json(spark):
    text = '{"default":"p0","groups":{"g1":"p1"},"retrieval_params":{"g2":{"chunks_per_doc":5}}}'
    got = {r.group_id: (r.provider, r.chunks_per_doc) for r in catalog_json.settings_rows(
        spark.createDataFrame([(text,)], "value string")).collect()}
    assert got == {"default": ("p0", None), "g1": ("p1", None), "g2": (None, 5)}


def test_a_large_source_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from folioscope.plans import text_plans
    rows = [(i, f"text {i}", "one", "en") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(text_plans, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be joined in one task
    try:
        assert text_plans._read_corpus(spark, str(tmp_path)).count() == 200
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = list((tmp_path / "corpus" / "group_id=one").glob("part-*"))
    assert len(files) == 200 and len({f.name.split("-")[1] for f in files}) > 1
