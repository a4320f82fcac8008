"""Sentences that meet on leading terms: only pairs that can reach the threshold leave the task, in lanes and batches of any size."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.operators import similarity


def texts(n, rare, seed):
    """Texts of common words and one rarer word that each ``n / rare`` of them share; some are near copies."""
    rnd = random.Random(seed)
    made = [" ".join(f"c{rnd.randrange(60)}" for _ in range(24)) + f" rare{i % rare}" for i in range(n)]
    return made + [t.replace(" rare", " c1 rare") for t in made[::7]] + [" ".join(t.split()[1:]) for t in made[::11]]


def cosines(sentences):
    """The cosine of each pair of distinct sentences, by brute force."""
    sentences = sorted(set(sentences))
    tf = [Counter(s.split()) for s in sentences]
    df = Counter(t for c in tf for t in c)
    raw = [{t: n * (math.log((1 + len(tf)) / (1 + df[t])) + 1) for t, n in c.items()} for c in tf]
    norm = [math.sqrt(sum(w * w for w in r.values())) for r in raw]
    return {(sentences[i], sentences[j]): sum(w * raw[j].get(t, 0.0) for t, w in raw[i].items()) / (norm[i] * norm[j])
            for i in range(len(tf)) for j in range(i)}


def body_of(spark, sentences, floor):
    rows = spark.createDataFrame([(s,) for s in sentences], "sentence string").withColumn("sid", F.md5("sentence"))
    return similarity._leading_terms(rows, floor)


def test_a_shared_rare_term_alone_makes_no_candidate(spark):
    made = texts(300, 10, 2)
    met = similarity._met_within(body_of(spark, made, 0.8), 0.8).count()
    near = sum(c >= 0.8 - 1e-9 for c in cosines(made).values())
    assert near and met < near + 500  # about 5,000 pairs share their rarest term


@pytest.mark.parametrize("lane, batch", [(2048, 10_000), (4, 3), (7, 50)])
def test_edges_in_lanes_and_batches(spark, monkeypatch, lane, batch):
    monkeypatch.setattr(similarity, "LANE", lane)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        made = texts(60, 3, 4)
        chunks = spark.createDataFrame([(f"{i:04}", t) for i, t in enumerate(made + made[:5])], "chunk_id string, chunk_text string")
        edges, copies = similarity.semantic_edges(chunks, 0.8)
        got, tied = sorted((r.src, r.dst) for r in edges.collect()), copies.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    first = {t: f"{i:04}" for i, t in reversed(list(enumerate(made)))}
    near = [(first[a], first[b]) for (a, b), c in cosines(made).items() if round(c, 6) >= 0.8]
    assert near and got == sorted(near + [(b, a) for a, b in near])
    assert tied == sum(n for n in Counter(made + made[:5]).values() if n > 1)


def test_only_terms_of_the_other_side_are_dealt(spark, monkeypatch):
    seen = []
    meetings = similarity._meetings
    monkeypatch.setattr(similarity, "_meetings", lambda rows, floor, **more: seen.append(rows.groupBy("side").count().collect()) or meetings(rows, floor, **more))
    left = spark.createDataFrame([(i, f"word{i} other{i} thing{i} there{i} shared") for i in range(200)], "lid long, text string")
    right = spark.createDataFrame([(1, "word7 other7 thing7 there7 shared"), (2, "not one of them")], "rid long, text string")
    found = similarity.sentence_overlap(left, right, ["lid"], ["rid"], threshold=0.74)
    assert [(r.lid, r.rid) for r in found.collect()] == [(7, 1)]
    dealt = {r["side"]: r["count"] for r in seen[0]}
    assert dealt[1] <= 8  # the terms of one left sentence, not of 200
