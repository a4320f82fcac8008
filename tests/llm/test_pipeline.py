"""The pipeline's stages, each against SQL or brute force on its own input, and the whole run."""

from __future__ import annotations

import collections

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from folioscope.llm import toxicity
from folioscope.llm.packing import pack
from folioscope.llm.plans import ORACLES
from folioscope.llm.tokens import tokenizer
from folioscope.session import cut_lineage, read_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input, output) of every stage."""
    docs, out = read_table(spark, SF, "documents"), []
    for name, fn in corpus_pipeline.STAGES:
        made = cut_lineage(fn(spark, docs, SF))
        out.append((name, docs, made))
        docs = made
    return {name: (a, b) for name, a, b in out}


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def sql(text, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    return con.execute(text).df()


def test_stages_keep_the_columns(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns and after.schema == before.schema


def test_toxicity_stage_drops_what_the_model_rejects(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.train(before, read_table(spark, SF, "labels"))
    scores = {r.doc_id: r.score for r in toxicity.score(before, model).collect()}
    assert ids(after) == sorted(d for d, s in scores.items() if s < toxicity.THRESHOLD)
    assert len(ids(after)) > 0.8 * before.count()


def test_exact_stage_keeps_the_largest_id(stages):
    before, after = stages["exact dedup"]
    want = sql("select max(doc_id) as doc_id from documents group by coalesce(text, '')", documents=before)
    assert ids(after) == sorted(want.doc_id)


def test_near_stage_keeps_one_of_each_component(stages):
    before, after = stages["n-gram Jaccard join"]
    want = sql(ORACLES["op6_jaccard_join"], documents=before)
    assert ids(after) == sorted(want[want.doc_id == want.component_id].doc_id)


def test_benchmark_stage_drops_the_contaminated(spark, stages):
    before, after = stages["benchmark decontamination"]
    want = sql(ORACLES["op4_decontaminate"], documents=before, benchmark=read_table(spark, SF, "benchmark"))
    assert ids(after) == sorted(want[~want.contaminated].doc_id)


def test_packing_stage_holds_every_token(spark, stages):
    before, after = stages["packing"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = pack(before, path).collect()
    held = collections.defaultdict(dict)
    for p in pieces:
        held[p.doc_id].update(enumerate(np.frombuffer(bytes(p.ids), "<u4").tolist(), p.start))
    for r in before.collect():
        want = [*tokenizer(path).tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert [held[r.doc_id][i] for i in range(len(want))] == want and len(held[r.doc_id]) == len(want)
    assert after.count() == len(pieces)


def test_run_is_the_stages_in_order(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages["packing"][1].collect()))


def test_stages_take_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for name in ("labels", "benchmark"):
        read_table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    for rows in ([], [(None, None, None, None, None), (1, "", "x", None, 0), (1, "", "x", None, 0), (2, "a b c", None, "s", 5), (3, "a  B c", "en", "s", None)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = cut_lineage(stage(spark, docs, str(tmp_path)))
            assert docs.columns == schema.replace(" bigint", "").replace(" string", "").split(", ")
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert {r.doc_id for r in packed} == ({1, 2} if rows else set())
