"""Periodic runs against brute force."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import periodic_runs as runs


def words_in(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def plain_runs(w):
    """Every period, every place: stretches equal to themselves a period on, the smallest period of each."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(v for i, v in enumerate(w) if i not in gone)


def random_text(rng):
    kinds, words, most = rng.choice([1, 2, 3, 40]), [], rng.choice([5, 60, 300, 600])
    while len(words) < most:
        unit = [str(rng.randrange(kinds)) for _ in range(rng.randrange(1, 90))]
        words += unit * rng.choice([1, 1, 2, 3, 8])
        if rng.random() < 0.4:
            words = words[:-rng.randrange(1, 5)]
    return rng.choice([" ", "\t\n", "  "]).join(words)


def test_transforms_are_exact():
    rng = np.random.default_rng(1)
    for size in (1, 2, 8, 64):
        a, b = rng.integers(0, runs.PRIME, (2, 3, size)).astype(np.uint64)
        assert (runs.untransformed(runs.transformed(a)) == a).all()
        product = runs.untransformed(runs.transformed(a) * runs.transformed(b) % np.uint64(runs.PRIME))
        want = [[sum(int(a[r, j]) * int(b[r, (i - j) % size]) for j in range(size)) % runs.PRIME for i in range(size)] for r in range(3)]
        assert product.tolist() == want


def test_occurrences_are_those_of_comparing():
    rng = np.random.default_rng(2)
    for block, first, last in ((4, 8, 16), (3, 5, 40), (8, 16, 32)):
        x = rng.integers(0, 2, 300)
        at = np.arange(0, 300 - block - first, 7)
        place, distance = runs.occurrences(x, at, block, first, last)
        want = {(i, q) for i in at.tolist() for q in range(first, last) if i + q + block <= 300 and (x[i:i + block] == x[i + q:i + q + block]).all()}
        assert set(zip(place.tolist(), distance.tolist())) == want


def test_runs_are_those_of_brute_force():
    rng = random.Random(3)
    for _ in range(100):
        texts = [rng.choice([None, "", " \n"]) if rng.random() < 0.1 else random_text(rng) for _ in range(rng.randrange(1, 5))]
        for text, (words, found) in zip(texts, runs.runs_in(texts)):
            w = words_in(text)
            want = plain_runs(w)
            assert [tuple(r) for r in found.tolist()] == want
            assert runs.collapsed(words, found).decode() == plain_collapsed(w, want)


def test_small_blocks_give_the_same_runs():
    rng = random.Random(4)
    for _ in range(30):
        x = np.array([int(v) for v in random_text(rng).split()] + [99])
        ends = np.full(len(x), len(x) - 1)
        assert (runs.runs_of(x, ends, largest=4) == runs.runs_of(x, ends)).all()


def test_table_with_nulls_ties_repeats_and_clashing_names(spark):
    rng = random.Random(5)
    rows = [(i, random_text(rng)) for i in range(60)]
    long = " ".join(f"w{i % 5000}" for i in range(120_000)) + " end"
    rows += [(100, None), (101, ""), (None, "a b " * 8), (102, "\u00e9\u00a0\u00fc\u2003 " * 12), (103, "x " * 6 + "y " + "x " * 6), (104, long), (105, "a " * 50_000)]
    rows += [rows[3], rows[3]]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, runs int, planted string").repartition(3)
    found = runs.periodic_runs(docs).collect()
    plain = sorted((str(d), len(words_in(t)), str(plain_runs(words_in(t)) if d not in (104, 105) else None)) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_words, str([tuple(x) for x in r.runs] if r.doc_id not in (104, 105) else None)) for r in found) == plain
    by_id = {r.doc_id: r for r in found}
    assert [tuple(x) for x in by_id[104].runs] == [(0, 120_000, 5000)] and len(by_id[104].collapsed.split()) == 5001
    assert [tuple(x) for x in by_id[105].runs] == [(0, 50_000, 1)] and by_id[105].collapsed == "a"
    assert by_id[102].collapsed == "\u00e9\u00a0\u00fc\u2003" and not by_id[103].runs
    digests = {r.doc_id: r for r in runs.run_digests(runs.periodic_runs(docs)).collect()}
    assert digests[104].exponent_milli == 24_000 and digests[100].start is None and digests[100].n_runs == 0
    assert runs.run_digests(runs.periodic_runs(docs.limit(0))).count() == 0


def test_planted_tails(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("id")), lambda i: i.cast("string")), " ").alias("text"))
    docs = docs.union(spark.createDataFrame([(None, "a b"), (7, None)], "doc_id long, text string"))
    changed = 0
    for r in runs.with_planted_tails(docs).collect():
        if r.doc_id is None or r.doc_id == 7 and not r.text:
            assert r.text == ("a b" if r.doc_id is None else "")
            continue
        w = [str(i) for i in range(r.doc_id + 1)]
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            changed += 1
        assert r.text.split() == w
    assert changed > 10
