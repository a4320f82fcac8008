"""Long phrase lists against counting one phrase at a time, and against the alternation of a short list."""

import random

from pyspark.sql import functions as F

from folioscope.operators import phrases, spans


def occurrences(text, phrase):
    return [i for i in range(len(text)) if text.startswith(phrase, i)]


def test_trie_finds_every_occurrence():
    rng = random.Random(1)
    for _ in range(200):
        letters = rng.choice(["ab", "abc ", "aéß🙂"])
        word = lambda n: "".join(rng.choices(letters, k=rng.randrange(1, n)))
        listed = sorted({word(6) for _ in range(rng.randrange(1, 30))})
        texts = [word(40) if rng.random() < 0.9 else "" for _ in range(rng.randrange(0, 6))]
        trie = phrases.PhraseTrie.of(listed)
        begin = [sum(len(t) + 1 for t in texts[:i]) for i in range(len(texts))]
        got = sorted((int(t), int(p) - begin[t], listed[f]) for t, p, f in zip(*trie.hits(texts)))
        assert got == sorted((i, at, p) for i, t in enumerate(texts) for p in listed for at in occurrences(t, p))
        counted = {(int(t), listed[f]): int(n) for t, f, n in zip(*trie.counts(texts))}
        assert counted == {(i, p): t.count(p) for i, t in enumerate(texts) for p in listed if p in t}


def test_self_overlaps_count_from_the_left():
    trie = phrases.PhraseTrie.of(["aa", "aba", "a"])
    got = {(int(t), trie.phrases[p]): int(n) for t, p, n in zip(*trie.counts(["aaaaa", "abababa", "xaax aaa", ""]))}
    assert got == {(0, "aa"): 2, (0, "a"): 5, (1, "aba"): 2, (1, "a"): 4, (2, "aa"): 2, (2, "a"): 5}


def test_short_list_equals_the_alternation(spark):
    docs = spark.createDataFrame([(1, "Of the roof them, of THE"), (2, "de la De La delà"), (3, None), (4, ""), (5, "und der of the " * 30_000), (1, "of the")],
                                 "doc_id long, text string")
    listed = ["of the", "de la", "und der", "the and"]
    long = phrases.phrase_list_scan(docs, "doc_id", spark.createDataFrame([(p,) for p in listed], "phrase string"))
    assert sorted(map(tuple, long.collect())) == sorted(map(tuple, spans.phrase_scan(docs, "doc_id", listed).collect()))


def test_hundred_thousand_phrases_in_shards(spark):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]
    listed = {" ".join(rng.choices(words, k=3)) for _ in range(103_500)}
    rows = [(i, " ".join(rng.choices(words, k=3000)).title()) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    given = spark.createDataFrame([(p.upper(),) for p in listed] + [(p,) for p in list(listed)[:50]] + [("",), (None,)], "phrase string")
    want = {}
    for i, t in rows:
        w = t.lower().split()
        last = {}
        for j in range(len(w) - 2):
            p = " ".join(w[j:j + 3])
            if p in listed and j >= last.get(p, -3) + 3:
                last[p] = j
                want[i, p] = want.get((i, p), 0) + 1
    assert len(listed) >= 100_000
    got = phrases.phrase_list_scan(docs, "doc_id", given, shard_chars=400_000)
    assert {(r.doc_id, r.phrase): r.n for r in got.collect()} == want
    assert phrases.phrase_list_scan(docs, "doc_id", given.limit(0)).count() == 0
    assert phrases.phrase_list_scan(docs.limit(0), "doc_id", given.limit(10)).agg(F.count("*")).first()[0] == 0
