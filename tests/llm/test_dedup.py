"""Exact dedup, passage dedup and the Jaccard join against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import components as components_of
from folioscope.llm import jaccard_join
from folioscope.llm.components import components
from folioscope.llm.exact_dedup import CuckooIndex, exact_dedup, keep_largest
from folioscope.llm.jaccard_join import jaccard_components, keep_least
from folioscope.llm.text import space_words
from folioscope.llm.unit_dedup import UNIT, dedup_passages

SCHEMA = "doc_id bigint, text string, digest string, _id int, row string, node bigint"
BIG = (1 << 60) + 1


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, None, 2) for i, t in rows], SCHEMA)


def test_cuckoo_index_keeps_live_digests_through_deletes_and_growth():
    index, live, rng = CuckooIndex(2), {}, random.Random(1)
    for step in range(6000):
        digest = hashlib.sha256(str(rng.randrange(3000)).encode()).digest()
        if digest in live and rng.random() < 0.5:
            assert index.delete(digest)
            del live[digest]
        elif digest not in live:
            index.insert(digest, step)
            live[digest] = step
        assert index.get(digest) == live.get(digest)
    assert dict(index.items()) == live and index.size == len(live) and index.resizes > 3
    assert not index.delete(b"\0" * 32)


ODD = [(1, "a b"), (2, None), (3, ""), (BIG, "a b"), (None, "a b"), (5, "A b"), (5, "A b"), (6, "a b "), (None, "z"), (7, "é" * 50_000)]


def test_exact_dedup_of_odd_rows(spark):
    got = {}
    for r in exact_dedup(frame(spark, ODD)).collect():
        got.setdefault((r.doc_id, r.text_sha256[:6]), []).append((r.keep_id, r.group_size, r.kept))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()[:6]
    assert got[BIG, sha("a b")] == [(BIG, 3, True)] and got[1, sha("a b")] == [(BIG, 3, False)] and got[None, sha("a b")] == [(BIG, 3, False)]
    assert got[2, sha("")] == [(3, 2, False)] and got[3, sha("")] == [(3, 2, True)]
    assert sorted(got[5, sha("A b")]) == [(5, 2, False), (5, 2, True)]
    assert got[None, sha("z")] == [(None, 1, True)] and got[6, sha("a b ")] == [(6, 1, True)]
    kept = keep_largest(frame(spark, ODD))
    assert kept.columns == ["doc_id", "text", "digest", "_id", "row", "node"]
    assert sorted((str(r.doc_id), len(r.text or "")) for r in kept.collect()) == sorted(
        [(str(BIG), 3), ("3", 0), ("5", 3), ("6", 4), ("None", 1), ("7", 50_000)])
    assert exact_dedup(frame(spark, [])).count() == 0 and keep_largest(frame(spark, [])).count() == 0


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = space_words(t)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - min(5, len(w)) + 1)} if w else set())
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((str(doc), len(sets[i]), min(ids) if ids and sets[i] else doc))
    return sorted(out, key=str)


def near_copies(seed):
    """Chains and clouds of near copies, and documents that share a long passage but not enough for a link."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(60)]
    rows, doc = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 6, 40, 120]))]
        for _ in range(rng.choice([1, 2, 9])):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 12)):
                words[rng.randrange(len(words))] = word()
            rows.append((rng.randrange(1, 10_000), " ".join(words)))
    for _ in range(25):
        rows.append((rng.randrange(1, 10_000), " ".join(passage + [word() for _ in range(rng.choice([12, 15, 18, 25]))])))
    chain = [word() for _ in range(80)]
    for doc in range(14):  # each links with its neighbours only
        chain = chain[4:] + [word() for _ in range(4)]
        rows.append((20_000 + doc, " ".join(chain)))
    return rows


def test_jaccard_components_are_exact(spark):
    rows = near_copies(1) + [(i + 50_000, t) for i, t in near_copies(2)]
    got = jaccard_components(frame(spark, rows)).collect()
    assert sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


def test_jaccard_join_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \n\t"), (9, "One two"), (4, "one  TWO"), (None, text), (8, text), (8, text), (7, text + " end"), (None, "lone text"),
            (5, "ONE two"), (6, " ".join(str(i % 977) for i in range(30_000)))]
    got = jaccard_components(frame(spark, rows)).collect()
    assert sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)
    kept = keep_least(frame(spark, rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "6", "7", "None"])
    assert jaccard_components(frame(spark, [])).count() == 0 and keep_least(frame(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a int, b int")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {101: 100}


def brute_passages(rows, least):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        text, spans, run = text or "", [], []
        for m in [*UNIT.finditer(text), None]:
            words = space_words(m[0]) if m else []
            if m and tuple(words) in seen:
                run.append((m.start(), m.end(), len(words)))
                continue
            if sum(r[2] for r in run) >= least:
                spans.append((run[0][0], run[-1][1]))
            run = []
            seen.add(tuple(words))
        left, at = "", 0
        for a, b in spans:
            left, at = left + text[at:a], b
        out.append((str(doc), left + text[at:], spans))
    return sorted(out)


def test_passages_keep_their_earliest_occurrence(spark):
    rng = random.Random(5)
    sentence = lambda: " ".join(rng.choices(["la", "le", "é", "un", "deux", "x"], k=rng.randrange(1, 9))) + rng.choice([". ", "!\n", "?? ", "\n\n"])
    passage = "".join(sentence() for _ in range(8))
    rows = []
    for doc in rng.sample(range(1000), 40):
        parts = [sentence() for _ in range(rng.randrange(0, 12))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts) + 1), passage)
        rows.append((doc, "".join(parts)))
    rows += [(2000, passage + passage), (2001, None), (2002, ""), (None, passage), (2003, "one " * 30_000)]
    got = dedup_passages(frame(spark, rows), least_words=6).collect()
    assert sorted((str(r.doc_id), r.text, [(s["first"], s["last"]) for s in r.spans]) for r in got) == brute_passages(rows, 6)
    again = dedup_passages(frame(spark, [(1, passage), (1, passage), (2, passage)]), least_words=6).collect()
    assert sorted((r.doc_id, r.text) for r in again) == [(1, passage), (1, passage), (2, "")]
    assert dedup_passages(frame(spark, [])).count() == 0


def test_rows_that_repeat_id_and_text_keep_their_passages_in_any_partitioning(spark):
    passage = "".join(f"Sentence {i} has five words. " for i in range(8))
    rows = [(1, passage), (1, passage), (None, passage), (2, passage + "End."), (3, "Alone. " + passage), (1, passage), (None, passage)]
    for parts in (1, 3, 7):
        for order in (rows, rows[::-1]):
            docs = frame(spark, order).repartition(parts) if parts > 1 else frame(spark, order).coalesce(1)
            got = sorted((str(r.doc_id), r.text) for r in dedup_passages(docs).collect())
            assert got == [("1", passage)] * 3 + [("2", " End."), ("3", "Alone."), ("None", ""), ("None", "")]


def test_members_met_in_a_region_are_only_those_that_sketches_admit(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(60)[:60 - cut]], rng.integers(0, 1 << 63, cut, dtype=np.uint64)])) for cut in [25] * 40 + [3] * 6]
    sets += [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 2, 700)]
    nodes = [bytes([i]) for i in range(len(sets))]
    points = spark.createDataFrame([(x, len(f), bytearray(jaccard_join.parity_bits(np.unique(f)))) for x, f in zip(nodes, sets)], "node binary, n int, bits binary")
    marks = jaccard_join._sketched(points).withColumn("tokens", F.array(F.lit(7).cast("bigint")))
    regions = spark.createDataFrame(
        [(7, x, len(f), i, len(sets), 0, x, True, 0.0, 1.0) for i, (x, f) in enumerate(zip(nodes, sets))],
        "token bigint, node binary, n int, place int, size bigint, done int, root binary, waits boolean, low double, high double")
    none = spark.createDataFrame([], "x binary, p binary, low double, high double, linked boolean")
    got = {(bytes(r.x)[0], bytes(r.p)[0]) for r in jaccard_join._next_pairs(regions, marks, none, 1000).collect()}
    common = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i in range(len(sets)) for j in range(i)}
    linked = {(i, j) for (i, j), c in common.items() if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c)}
    assert linked and linked <= got
    assert len(got - linked) < 20  # of the more than 1,000 pairs that are far apart


def test_components_stop_at_stars(spark):
    is_forest = lambda rows: components_of._is_forest(spark.createDataFrame(rows, "a int, b int"))
    assert is_forest([(2, 1), (3, 1), (5, 4)])
    assert not is_forest([(3, 2), (2, 1)]) and not is_forest([(3, 1), (3, 2)])
