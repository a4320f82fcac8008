"""Span merging by slices with carries, against one pass over each document."""

import random

from folioscope.operators import spans


def plain(rows):
    once = {}
    for d, s, e in rows:
        once[d, s] = max(e, once.get((d, s), e))
    out = []
    for (d, s), e in sorted(once.items(), key=lambda x: (str(x[0][0]), x[0][1])):
        if out and out[-1][0] == d and s < out[-1][2]:
            out[-1] = (d, out[-1][1], max(e, out[-1][2]), out[-1][3] + 1)
        else:
            out.append((d, s, e, 1))
    return sorted(map(str, out))


def test_slices_merge_as_whole_documents(spark):
    rng = random.Random(1)
    rows = []
    for d in [*range(12), None]:
        for _ in range(rng.randrange(1, 80)):
            s = rng.randrange(400)
            rows.append((d, s, s + rng.choice([1, 2, 5, 40, 300])))
    rows += [(50, i * 10, i * 10 + 3) for i in range(100)] + [(51, 0, 10_000)] + [(51, i * 100, i * 100 + 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int")
    for width in (1, 7, 64, 65536):
        got = spans.merge_spans(df, ["doc_id"], width).collect()
        assert sorted(str((r.doc_id, r.start, r.end, r.n_spans)) for r in got) == plain(rows)


def test_one_document_with_a_million_spans_is_spread(spark):
    df = spark.range(1_000_000).selectExpr("cast(7 as bigint) as doc_id", "cast(id * 4 as int) as start", "cast(id * 4 + 3 as int) as end")
    merged = spans.merge_spans(df, ["doc_id"], 65536)
    assert merged.count() == 1_000_000
    windows = [line for line in merged._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in line]
    assert all("_slice" in line for line in windows)  # rows are ordered within slices; only summaries by document
