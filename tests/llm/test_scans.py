"""Decontamination, personal data, toxicity, language model and url verdicts against brute force and held-out rows."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import char_tagger, lm_score, pii, toxicity
from folioscope.llm.decontaminate import benchmark_hits, judged, keep_uncontaminated
from folioscope.llm.plans import QUERIES, URL_RULES
from folioscope.llm.text import freeing, space_words
from folioscope.llm.url_templates import url_verdicts

SCHEMA = "doc_id bigint, text string, score double, spans string, _n int, toxic string"
BIG = (1 << 60) + 1


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "x", 3, None) for i, t in rows], SCHEMA)


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("block", [1_000_000, 7])
def test_contamination_is_that_of_every_window(spark, block):
    rng = random.Random(8)
    word = lambda: rng.choice(["Ab", "é", "x1", "ÉÉ", "the", "zz"])
    items = [("a", " ".join(word() for _ in range(30))), ("b", "Short item, here"), ("c", None), ("d", ""), (None, "three more words"),
             ("a", "short ITEM here"), ("e", " ".join(word() for _ in range(13)))]
    rows = [(1, None), (2, ""), (3, "..."), (BIG, "a short-item: here!"), (None, "three more words again"), (9, "x " * 40_000 + items[0][1])]
    for i in range(20):
        text = [word() for _ in range(rng.randrange(200))]
        if i % 2:
            text[rng.randrange(len(text) + 1):0] = word_list(items[rng.choice([0, 1, 6])][1])
        rows.append((100 + i, " ".join(text)))
    rows += [rows[-1], rows[3]]
    want = []
    for doc, text in rows:
        words, hit, ids = word_list(text), set(), set()
        for item, of in items:
            w = word_list(of)
            n = min(13, len(w))
            for k in range(len(w) - n + 1 if w else 0):
                for i in range(len(words) - n + 1):
                    if words[i:i + n] == w[k:k + n]:
                        hit.update(range(i, i + n))
                        ids.add(item or "")
        want.append((str(doc), len(words), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(words)))
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id string, text string")
    hits = benchmark_hits(docs, bench, block=block)
    got = [(str(r.doc_id), r.n_words, sum(s["last"] - s["first"] for s in r.spans), r["items"]) for r in hits.collect()]
    assert sorted(got) == sorted(w[:4] for w in want)
    assert sorted((str(r.doc_id), r.contaminated) for r in judged(hits).collect()) == sorted((w[0], w[4]) for w in want)
    kept = keep_uncontaminated(docs, bench, block=block)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(w[0] for w in want if not w[4])
    assert judged(benchmark_hits(docs, bench.limit(0))).where("contaminated").count() == 0
    assert benchmark_hits(docs.limit(0), bench).count() == 0


# The contract's patterns, as they are written there.
PLAIN = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                                 r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else 0, 12 <= len(digits) <= 19 and pii.luhn(digits),
                    9 <= len(digits) <= 15)[kind]
            if fine:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_patterns_match_the_plain_ones():
    rng = random.Random(9)
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    for _ in range(30_000):
        text = "".join(rng.choices("ab@@..1290-+ ()%é", k=rng.randrange(40)))
        assert pii.base_spans(text) == plain_spans(text), text
    for text in ("1" * 60_000, "a" * 200_000 + "@", "1." * 30_000, "+1" + "(" * 50_000, "4539 5787 6362 1486", "x@y.zz.@w.v"):
        assert pii.base_spans(text) == (plain_spans(text) if len(text) < 100 else pii.base_spans(text))


def test_tagger_slopes_are_those_of_its_loss():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in char_tagger.initial(5).items()}
    x, y = rng.integers(0, char_tagger.SYMBOLS, (9, 4)), rng.integers(0, 5, (9, 4))
    _, slopes = char_tagger.loss_and_slopes(p, x, y)
    for name in p:
        at = tuple(rng.integers(0, n) for n in p[name].shape)
        moved = [{k: v.copy() for k, v in p.items()} for _ in range(2)]
        moved[0][name][at] += 1e-3
        moved[1][name][at] -= 1e-3
        slope = (char_tagger.loss_and_slopes(moved[0], x, y)[0] - char_tagger.loss_and_slopes(moved[1], x, y)[0]) / 2e-3
        assert slope == pytest.approx(float(slopes[name][at]), abs=2e-4)


def test_tagger_finds_what_patterns_miss(spark):
    rng = random.Random(10)
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    def card():
        digits = number(15)
        return next(digits + d for d in "0123456789" if pii.luhn(digits + d))
    makers = [lambda: f"{rng.choice(['jo', 'ana.b'])}{number(2)}@mail{number(1)}.com", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), card,
              lambda: f"+{number(2)} {number(3)} {number(4)} {number(3)}"]
    filler = lambda: " ".join(rng.choices("the of and in thand ering on tion".split(), k=rng.randrange(5, 30)))
    rows = [(i, f"{filler()} {rng.choice(makers)()} {filler()}") for i in range(600)]
    bad_card = "4539578763621487"
    rows += [(9000, f"{filler()} {bad_card} {filler()} " * 40), (9001, None), (9002, ""), (None, "a@b.cc"), (9003, filler()), (9003, filler())]
    docs = frame(spark, rows)
    model = pii.train(docs)
    found = {}
    for r in pii.find_pii(docs, model).collect():
        found.setdefault(r.doc_id, []).append(r)
    texts = dict(rows)
    for doc, rs in found.items():
        for r in rs:
            if doc != 9003:
                assert [(s["start"], s["kind"], s["end"]) for s in r.base] == [(a, pii.KINDS[k], b) for a, k, b in plain_spans(texts[doc] or "")]
            assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    text = texts[9000]
    added = [text[s["start"]:s["end"]] for s in found[9000][0].spans]
    assert added.count(bad_card) >= 30  # in windows everywhere in a long text
    assert not any(r.spans for r in found[9003]) and not found[9001][0].spans
    digest = {r.doc_id: r for r in pii.span_digests(pii.find_pii(docs, None)).collect()}
    assert digest[None].spans == "email:0:6" and digest[None].n_email == 1 and digest[9002].spans == ""
    assert pii.train(docs.limit(0)) is None and pii.find_pii(docs.limit(0), model).count() == 0


def test_windows_are_reconciled_like_one():
    """Tags of a text do not depend on what stands beside it in the batch, nor does a long text lose its last window."""
    model = char_tagger.initial(5)
    rng = random.Random(11)
    texts = ["".join(rng.choices("abc 12@.", k=n)) for n in (1, 31, 255, 256, 257, 480, 481, 1000, 0)]
    together = pii.tagged(model, texts)
    assert [len(t) for t in together] == [len(t) for t in texts]
    for text, tags in zip(texts, together):
        assert (pii.tagged(model, [text])[0] == tags).all()
    assert (together[3] == char_tagger.decode(model, char_tagger.symbols(texts[3])[:, None])[:, 0]).all()


@pytest.fixture(scope="module")
def toxic_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return toxicity.train(docs, labels), docs, labels


def test_toxicity_holds_on_rows_it_has_not_seen(toxic_model):
    model, docs, labels = toxic_model
    rows = toxicity.judged(toxicity.score(docs, model)).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert len(toxic) > 100 and sum(r.predicted for r in toxic) > 0.75 * len(toxic)
    assert sum(r.predicted for r in clean) < 0.01 * len(clean)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)


def test_channel_restores_disguised_words(spark, toxic_model):
    model, _, _ = toxic_model
    rows = [(1, "you 1d10t"), (2, "what an i d i o t !"), (3, "st.u.p.i.d"), (4, "l0ser"), (5, "idiiiot"), (6, "thing on the"), (7, None), (8, ""),
            (9, "tr@sh " + "the of " * 60_000), (None, "m-o-r-o-n"), (6, "thing on the")]
    docs = frame(spark, rows)
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for doc in (1, 2, 3, 4, 5, 9, None):
        assert score[doc] > 10 * score[8], doc
    assert score[6] == score[7] == score[8]
    kept = toxicity.keep_clean(docs, model, threshold=score[8] * 2)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [6, 6, 7, 8]
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_channel_restores_stretches_of_any_length(spark, toxic_model):
    model, _, _ = toxic_model
    spaced = lambda text, gap: "  ".join(gap.join(w) for w in text.split())
    rows = [(1, "  ".join("gohomeyouworthlessidiotnow")), (2, spaced("you are such a worthless stupid idiot and a loser", " ")),
            (3, " ".join("youaresuchaworthlessstupididiot" * 40)), (4, "the_of-" * 20_000 + "1d10t"), (5, "of the " + "-".join("on" * 50_000) + " idiot"), (6, "")]
    score = {r.doc_id: r.score for r in toxicity.score(frame(spark, rows), model).collect()}
    for doc in range(1, 6):
        assert score[doc] > 3 * score[6], doc
    reader = toxicity.Reader(toxicity.Channel(model.costs), None)
    assert "=abc" in reader.features("a b c") and "=abc" in reader.features("so a-b-c, then") and "=abc" not in reader.features("a b")


def test_settled_beginnings_change_no_reading(toxic_model):
    whole = toxicity.Channel(toxic_model[0].costs)
    whole.WINDOW = 1 << 60  # one window
    rng = random.Random(14)
    for n in (5, 64, 65, 300, 1500):
        for letters in ("idot 1", "1|10 .-", "abc aa!", "éß?x0 -"):
            text = "".join(rng.choices(letters, k=n))
            assert toxicity.Channel(toxic_model[0].costs).restored(text) == whole.restored(text), text


def test_unigram_scores_are_exact_and_the_model_is_better_on_copies(spark):
    rng = random.Random(12)
    words = [f"W{i}" for i in range(400)]
    phrase = lambda: " ".join(rng.choices(words, k=30))
    common = [phrase() for _ in range(8)]
    rows = [(i, " ".join(rng.choices(common, k=3)) + " " + phrase()) for i in range(300)] + [(1000, None), (1001, ""), (None, "w1 new\x0bword"), (5, "w1 w1")]
    rows += [(1002, "unseen " * 20_000)]
    fold = F.coalesce(toxicity.fold_of(5) != 1, F.lit(True))
    got = lm_score.score(frame(spark, rows), fold).collect()
    trained = lambda d: d is None or zlib.crc32(str(d).encode()) % 5 != 1
    counts = collections.Counter(w for d, t in rows if trained(d) for w in [*space_words(t), b"\n"])
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for d, t in rows:
        tokens = [*space_words(t), b"\n"]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens)
        want.append((str(d), len(tokens), sum(w in counts for w in tokens), round(base, 4)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == sorted(want)
    assert {r.train_tokens for r in got} == {total}
    held = [r for r in got if not trained(r.doc_id) and r.n_tokens > 50 and r.doc_id < 1000]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_score.score(frame(spark, []), fold).count() == 0
    nothing = lm_score.score(frame(spark, rows[:3]), F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens) for r in nothing} == {(0, 0)} and all(math.isfinite(r.score) for r in nothing)


#: How the work is cut up: the filter in one segment, in many, and in several passes.
CUTS = [{}, {"segment_tokens": 200, "segment_text": 900}, {"segment_tokens": 100, "segment_text": 300, "pass_bytes": 60_000}]


def lm_rows(rng):
    words = [f"w{i}" for i in range(1500)] + ["the", "of"] * 200
    return [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(120)] + [(500, None), (None, "w1 w2 neverseen w3"), (7, "w1 w2"), (7, "w1 w2")]


def read_at(n):
    """What the filter gives for a count: the least whole number of its bracket."""
    level = 0
    while n and 1.4 ** level <= n * (1 + 1e-9):
        level += 1
    return math.ceil(1.4 ** (level - 1) - 1e-9) if level else 0


def plain_model_scores(rows, trained):
    lists = [[*space_words(t), b"\n"] for _, t in rows]
    count, pairs = collections.Counter(), collections.Counter()
    for (d, _), tokens in zip(rows, lists):
        if trained(d):
            count.update(tokens)
            pairs.update(zip([b"\n", *tokens], tokens))
    total, distinct = sum(count.values()), len(count)
    out = []
    for (d, _), tokens in zip(rows, lists):
        own = 0.0
        for a, b in zip([b"\n", *tokens], tokens):
            before, pair = read_at(count[a]), read_at(pairs[a, b])
            single = (read_at(count[b]) + 0.5) / (total + 0.5 * (distinct + 1))
            own += math.log10(0.8 * min(pair, before) / before + 0.2 * single if before else single)
        out.append((str(d), len(tokens), round(own, 6)))
    return sorted(out)


@pytest.mark.parametrize("cut", CUTS)
def test_model_scores_are_those_of_the_counts_read_from_the_filter(spark, cut):
    """With so many bits that no level is found by mistake, against plain counters; pairs seen once are in."""
    rows = lm_rows(random.Random(13))
    got = lm_score.score(frame(spark, rows).repartition(5), F.col("doc_id") % 4 != 1, item_bits=2500, **{**cut, **({"pass_bytes": 300_000} if "pass_bytes" in cut else {})}).collect()
    want = plain_model_scores(rows, lambda d: d is not None and d % 4 != 1)
    assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in got) == want


def test_results_do_not_depend_on_passes(spark):
    docs = frame(spark, lm_rows(random.Random(14))).repartition(3)
    one, many = ([tuple(r) for r in lm_score.score(docs, F.col("doc_id") % 4 != 1, segment_tokens=100, pass_bytes=b).collect()] for b in (10 ** 8, 2_000))
    assert sorted(map(str, one)) == sorted(map(str, many)) and len(one) == 124


@pytest.mark.parametrize("segments", [1, 8])
def test_filter_reads_counts_back(segments):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2 ** 64, 20_000, dtype=np.uint64))
    counts = np.maximum(1, rng.pareto(0.8, len(keys))).astype(np.int64)
    of = lm_score.segment_of(keys, segments)
    made = [lm_score.filled([(lm_score.WORD, keys[of == s], counts[of == s]), (lm_score.PAIR, keys[of == s][:100], counts[of == s][:100])], 8) for s in range(segments)]
    model = lm_score.CountFilter(segments, 0, np.array([b for b, _ in made]), np.frombuffer(b"".join(d for _, d in made), np.uint8))
    read = lm_score.counts_at(model.levels(keys, lm_score.WORD).astype(int))
    assert (read >= counts / lm_score.BASE - 1e-6).all()  # never too small by more than a bracket
    assert (read <= counts).mean() > 0.95 and (read[counts == 1] == 1).mean() > 0.95
    absent = model.levels(rng.integers(0, 2 ** 64, 20_000, dtype=np.uint64), lm_score.WORD)
    assert 0 < (absent > 0).mean() < 0.04
    assert (model.levels(keys[-100:], lm_score.PAIR) > 0).mean() < 0.5  # kinds are apart
    part = lm_score.CountFilter(segments, 0, model.bits[:1], model.data[:model.bits[0] // 8])
    assert ((part.levels(keys, lm_score.WORD) > 0) == ((of == 0) & (model.levels(keys, lm_score.WORD) > 0))).all()


def test_level_brackets():
    assert lm_score.counts_at(lm_score.levels_of(np.arange(1, 2000))).tolist() == [read_at(n) for n in range(1, 2000)]
    assert lm_score.counts_at(np.array([0])).tolist() == [0.0] and lm_score.counts_at(lm_score.levels_of(np.array([1, 2, 3]))).tolist() == [1, 2, 3]


def test_url_rules_and_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://ExAmple.ORG/es/1?q=/x", "http://a.example.org/en/12#x", "http://org", "x://fr.COM/fr/", "x://com/de/?a",
            "y://badexample.org/es/", "http://a.net?x=/de/", "http://a.net/de/1", "http://É.com/de/É\nb", "http://a.com//de/", "://b.com/fr/1/2/3/4/5/6/7"]
    rows = [(i, u, "x", "y", 1) for i, u in enumerate(urls)] + [(None, urls[4], "x", "y", 1), (3, urls[3], "x", "y", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, shape string, share int")
    got = url_verdicts(pages, URL_RULES).collect()

    def want(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        return host, path, best and best[0] + best[1], best and best[2]
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = want(urls[r.page_id if r.page_id is not None else 4])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (rule is None or r.verdict == verdict)
    assert url_verdicts(pages.limit(0), URL_RULES).count() == 0


def test_url_templates_generalise_and_reject(spark):
    rows = []
    for i in range(60):
        rows += [f"http://s.com/de/{i}", f"http://s.com/fr/{i}", f"http://t.com/de/x{i}", f"http://t.com/en/{chr(97 + i % 26)}{chr(97 + i // 26)}q"]
        rows += [f"http://u.net/a/{w}/p" for w in ("k", "l")]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string")
    got = {}
    for r in url_verdicts(pages, URL_RULES).collect():
        got.setdefault((r.host, r.path.split("/")[1]), set()).add((r.template, r.verdict))
    assert got["s.com", "de"] == {("/de/#", "block")} and got["s.com", "fr"] == {("/fr/#", "allow")}
    assert {v for _, v in got["t.com", "en"]} == {"block"}  # all that the host's labels say
    assert {t for t, _ in got["t.com", "en"]} == {"/~/*"} or all(t.endswith("/*") for t, _ in got["t.com", "en"])
    assert got["u.net", "a"] == {("/a/~/p", "allow")}


def test_native_operator_runs_no_python(spark):
    plan = QUERIES["op3_url_templates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_worker_gives_back_what_a_task_no_longer_uses():
    def held() -> float:
        with open("/proc/self/smaps_rollup") as f:
            return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", f.read()))) / 1024

    def run(batches):
        for batch in batches:
            grown = [pa.array([f"{i} {j}" * 20 for j in range(20_000)]) for i in range(20)]
            assert len(grown) == 20
            yield batch

    some = pa.RecordBatch.from_pydict({"x": [1]})
    assert list(freeing(run)([some])) == [some]  # libraries are loaded
    before = held()
    assert list(freeing(run)([some] * 3)) == [some] * 3
    kept = held() - before
    assert list(run([some] * 3)) == [some] * 3
    assert kept < 20 < held() - before
