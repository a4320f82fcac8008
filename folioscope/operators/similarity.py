"""Text similarity of given pairs, and the overlap join between two collections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.rows import explode_rows
from folioscope.functions.text import (
    char_ngrams, jaccard, key_phrases, normalize_text, normalized_sentences, tokens, word_ngrams, words,
)
from folioscope.functions.vocab import (
    EDGE_WEIGHTS, HIGHLIGHT_BASE, HIGHLIGHT_BOOST, HIGHLIGHT_LONG, HIGHLIGHT_SHORT, NGRAM_WEIGHTS, OVERLAP_THRESHOLD,
    SIMILARITY_WEIGHTS,
)
from folioscope.operators.enrich import term_counts, vocabulary, with_frequency
from folioscope.session import cut_lineage


def word_jaccard(a: Column, b: Column) -> Column:
    return jaccard(words(F.lower(a)), words(F.lower(b)))


def ngram_similarity(a: Column, b: Column, n: int = 3) -> Column:
    chars = jaccard(char_ngrams(a, n), char_ngrams(b, n))
    grams = jaccard(word_ngrams(a, n), word_ngrams(b, n))
    return F.lit(NGRAM_WEIGHTS["char"]) * chars + F.lit(NGRAM_WEIGHTS["word"]) * grams


def weighted_similarity(cosine: Column, a: Column, b: Column) -> Column:
    w = SIMILARITY_WEIGHTS
    return (
        F.lit(w["cosine"]) * cosine + F.lit(w["ngram"]) * ngram_similarity(a, b)
        + F.lit(w["phrase"]) * jaccard(key_phrases(a), key_phrases(b)) + F.lit(w["word"]) * word_jaccard(a, b)
    )


def _idf(n: Column, df: Column) -> Column:
    return F.log((1.0 + n) / (1.0 + df)) + 1.0


def pair_cosine(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, cosine of the two texts' tf-idf vectors over these two texts alone: a pair's score has no other input."""
    def shares(name: str, side: int) -> Column:
        return F.transform(tokens(F.col(name)), lambda t: F.struct(t.alias("term"), F.lit(side).alias("side")))

    terms = explode_rows(pairs.filter(F.col(a).isNotNull() | F.col(b).isNotNull()), keys,
                         F.concat(F.coalesce(shares(a, 1), F.array()), F.coalesce(shares(b, 2), F.array())), "s")
    tf = terms.groupBy(*keys, F.col("s.term").alias("term")).agg(
        F.count(F.when(F.col("s.side") == 1, 1)).alias("ta"), F.count(F.when(F.col("s.side") == 2, 1)).alias("tb"))
    idf = _idf(F.lit(2), (F.col("ta") > 0).cast("int") + (F.col("tb") > 0).cast("int"))
    wa, wb = F.col("ta") * idf, F.col("tb") * idf
    norm = F.sqrt(F.sum(wa * wa)) * F.sqrt(F.sum(wb * wb))
    return tf.groupBy(*keys).agg(F.when(norm > 0, F.sum(wa * wb) / norm).otherwise(F.lit(0.0)).alias("cosine"))


def combined_similarity(pairs: DataFrame, keys: list[str], a: str, b: str, name: str = "similarity") -> DataFrame:
    """pairs plus ``name``: cosine, n-gram, phrase and word parts in fixed weights."""
    cos = pair_cosine(pairs, keys, a, b)
    return pairs.join(cos, keys, "left").withColumn(
        name, weighted_similarity(F.coalesce("cosine", F.lit(0.0)), F.col(a), F.col(b))).drop("cosine")


def _long_sentences(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    parts = explode_rows(df, keep, normalized_sentences(F.col(text)), "sentence")
    return parts.filter(F.size(words(F.col("sentence"))) >= 4).withColumn("sid", F.md5("sentence"))


def sentence_overlap(left: DataFrame, right: DataFrame, left_id: list[str], right_id: list[str],
                     on: list[str] = (), text: str = "text", threshold: float = OVERLAP_THRESHOLD) -> DataFrame:
    """left_id, right_id, (on), best: pairs that share a sentence (four words or more) above the threshold.

    An exact similarity join. Beyond the threshold the cosine part alone must exceed ``floor``; two unit
    vectors can do so only if they share one of their leading terms, rarest first, up to the point where
    the rest is shorter than ``floor``. Only those terms are joined, so frequent words never meet.
    Copies of a sentence are compared once and spread out again at the end.
    """
    w = SIMILARITY_WEIGHTS
    floor = (threshold - w["ngram"] - w["phrase"] - w["word"]) / w["cosine"]
    if floor <= 0:
        raise ValueError("threshold too low for the overlap join: every pair would have to be compared")
    on = list(on)
    # read several times below, so written out once
    ls = cut_lineage(_long_sentences(left, [*left_id, *on], text))
    rs = cut_lineage(_long_sentences(right, [*right_id, *on], text))
    part = lambda rows, side: rows.select("sid", "sentence", *(F.lit(s == side).alias(f"in_{s}") for s in "lr"))
    distinct = _distinct(part(ls, "l").unionByName(part(rs, "r")))
    body = _vectors(distinct, floor)
    met = cut_lineage(_met(_placed(body, ls, "l", on), _placed(body, rs, "r", on), floor))
    side = lambda p: distinct.select(F.col("num").alias(p), F.col("sid").alias(f"{p}sid"), F.col("sentence").alias(f"{p}text"))
    close = cut_lineage(_cosines(met, body).filter(F.col("cosine") > floor)).join(side("l"), "l").join(side("r"), "r")
    # exploding a one-element array keeps the costly value from being worked out again in the filter
    # rounded first: equal sentences without key phrases reach the threshold exactly, not past it
    score = F.round(weighted_similarity(F.col("cosine"), F.col("ltext"), F.col("rtext")), 6)
    similar = cut_lineage(explode_rows(close, ["lsid", "rsid"], F.filter(F.array(score), lambda s: s > threshold), "s"))
    found = lambda rows, ids, key: rows.select(*ids, *on, F.col("sid").alias(key)).join(
        similar.select(key).distinct(), key, "left_semi").distinct()
    out = list(dict.fromkeys([*left_id, *right_id, *on]))
    return found(ls, left_id, "lsid").join(similar, "lsid").join(found(rs, right_id, "rsid"), ["rsid", *on]).groupBy(*out).agg(F.max("s").alias("best"))


#: Leading terms of one kind that meet in one lane of the join.
LANE = 2048
#: Parts of a sketch, which holds the length of a vector in each of them.
BUCKETS = 128
#: Pairs that are looked at together.
PAIRS = 1 << 17
#: What rounding may take from a bound.
SLACK = 1e-5


def _distinct(sentences: DataFrame) -> DataFrame:
    """num, sid, sentence per sid, written out; columns besides sid and sentence are combined by ``max``."""
    more = [F.max(c).alias(c) for c in sentences.columns if c not in ("sid", "sentence")]
    once = sentences.groupBy("sid").agg(F.first("sentence").alias("sentence"), *more)
    return cut_lineage(once.withColumn("num", F.monotonically_increasing_id()))


def _vectors(distinct: DataFrame, floor: float) -> DataFrame:
    """The columns of ``distinct`` but the sentence, terms, raws, norm, lead and weights (the unit vector, raws / norm), written out.

    Terms stand in the order of their frequency, common ones first. The last ``lead`` of them are to be joined on: what comes
    before them is shorter than ``floor``.
    """
    total = distinct.agg(F.count(F.lit(1)).alias("n"))
    per_term = vocabulary(explode_rows(distinct, [], F.array_distinct(tokens(F.col("sentence"))), "term"))
    weighted = with_frequency(term_counts(distinct, "num", "sentence"), "num", per_term).join(F.broadcast(total)).select(  # one-row side
        "num", "df", "term", (F.col("tf") * _idf(F.col("n"), F.col("df"))).alias("raw"))
    # a list holds the terms of one sentence; common terms first, so that the sum runs from the tail
    rows = weighted.groupBy("num").agg(F.reverse(F.array_sort(F.collect_list(F.struct("df", "term", "raw")))).alias("t"))
    mass = F.aggregate("t", F.lit(0.0), lambda acc, x: acc + x["raw"] * x["raw"])
    bound = F.col("m") * (floor * floor - 1e-9)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def step(acc, x):
        total = acc["sum"] + x["raw"] * x["raw"]
        return F.struct(total.alias("sum"), (acc["n"] + (total >= bound).cast("int")).alias("n"))

    held = cut_lineage(rows.withColumn("m", mass).select(
        "num", F.transform("t", lambda x: x["term"]).alias("terms"), F.transform("t", lambda x: x["raw"]).alias("raws"),
        F.sqrt("m").alias("norm"), F.aggregate("t", start, step, lambda acc: acc["n"]).alias("lead"),
    ).join(distinct.drop("sentence"), "num"))
    return held.withColumn("weights", F.transform("raws", lambda x: x / F.col("norm")))


def _leading_terms(sentences: DataFrame, floor: float) -> DataFrame:
    """The vectors of the distinct sentences of sid, sentence."""
    return _vectors(_distinct(sentences), floor)


def _leads(body: DataFrame) -> DataFrame:
    """num, key, data: the leading terms of each vector.

    ``key`` is a hash of the term; equal hashes of two terms only make more candidates. ``data`` holds as float32 the term's weight,
    the length of what is left of the vector in more frequent terms, and the unit of the sketch; then the sketch in half bytes,
    rounded up: the length of the vector in each bucket of terms. The product of two sketches is no less than the cosine.
    """
    rows = body.select("num", "lead", F.transform("terms", lambda t: F.xxhash64(t)).alias("hashes"), "weights")
    schema = "num long, key long, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("weights").value_lengths().fill_null(0).to_numpy().astype(np.int64)
            w, hashes = (batch.column(c).flatten().to_numpy() for c in ("weights", "hashes"))
            if not len(w):
                continue
            of, square = np.repeat(np.arange(len(size)), size), w * w
            upto = np.cumsum(square)
            upto -= np.repeat(np.append(0, upto)[np.cumsum(size) - size], size)
            sketch = np.sqrt(np.bincount(of * BUCKETS + (hashes & (BUCKETS - 1)), square, minlength=len(size) * BUCKETS)).reshape(-1, BUCKETS)
            unit = (sketch.max(axis=1) / 15 * (1 + 1e-6)).astype(np.float32)
            steps = np.minimum(np.ceil(sketch / np.maximum(unit, 1e-30)[:, None]), 15).astype(np.uint8)
            packed = (steps[:, ::2] << 4) | steps[:, 1::2]
            lead = np.flatnonzero(np.arange(len(of)) >= (np.cumsum(size) - batch.column("lead").to_numpy())[of])
            row = of[lead]
            head = np.stack([w[lead], np.sqrt(np.maximum(upto[lead] - square[lead], 0)), unit[row]], axis=1).astype("<f4")
            data = np.concatenate([head.view(np.uint8).reshape(len(lead), 12), packed[row]], axis=1)
            ends = pa.array(np.arange(len(lead) + 1) * data.shape[1], pa.int32())
            made = pa.Array.from_buffers(pa.binary(), len(lead), [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays([batch.column("num").take(pa.array(row)), pa.array(hashes[lead]), made], names=["num", "key", "data"])

    return rows.mapInArrow(run, schema)


def _placed(body: DataFrame, rows: DataFrame, side: str, on: list[str]) -> DataFrame:
    """num, key, data: the leading terms of one side's sentences; with ``on``, sentences of different values do not meet."""
    leads = _leads(body.filter(f"in_{side}"))
    if not on:
        return leads
    place = rows.select("sid", *on).distinct().join(body.select("sid", "num"), "sid").select("num", F.xxhash64(*on).alias("place"))
    return leads.join(place, "num").select("num", F.xxhash64("key", "place").alias("key"), "data")


def _lanes(leads: DataFrame, name: str) -> DataFrame:
    """key and the number of lanes of the keys that fill more than one; so few that there is at most one in ``LANE`` rows."""
    return cut_lineage(leads.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LANE).select(
        "key", F.ceil(F.col("n") / LANE).cast("int").alias(name)))


def _met(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """l, r that meet on a leading term. Both lists of a term are cut into lanes, and each lane meets each of the other side's."""
    keys = cut_lineage(right.select("key").distinct())
    left = left.join(keys, "key", "left_semi")
    many = {"a": _lanes(left, "a"), "b": _lanes(right, "b")}

    def dealt(rows: DataFrame, own: str, other: str, side: int) -> DataFrame:
        count = lambda c: F.coalesce(c, F.lit(1))
        known = rows.join(many[own], "key", "left").join(many[other], "key", "left")
        lane = {own: F.pmod(F.xxhash64("num"), count(own)).cast("int"), other: F.explode(F.sequence(F.lit(0), count(other) - 1))}
        each = known.select("key", "num", "data", lane[other].alias("_o"), lane[own].alias("_m"))
        i, j = ("_m", "_o") if own == "a" else ("_o", "_m")
        return each.select(F.xxhash64("key", i, j).alias("meeting"), F.lit(side).alias("side"), "num", "data")

    return _meetings(dealt(left, "a", "b", 1).unionByName(dealt(right, "b", "a", 2)), floor)


def _met_within(body: DataFrame, floor: float) -> DataFrame:
    """l < r that meet on a leading term, each pair of lanes of a term's list in a group of its own."""
    leads = _leads(body)
    lanes = F.coalesce("lanes", F.lit(1))
    each = leads.join(_lanes(leads, "lanes"), "key", "left").withColumn("mine", F.pmod(F.xxhash64("num"), lanes).cast("int")).select(
        "key", "num", "data", "mine", F.explode(F.sequence(F.lit(0), lanes - 1)).alias("other"))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return _meetings(each.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("meeting"),
                                 side.alias("side"), "num", "data"), floor, within=True)


def _meetings(rows: DataFrame, floor: float, within: bool = False) -> DataFrame:
    """l, r whose cosine can reach ``floor``: pairs of a meeting's rows of sides 1 and 2, and of its rows of side 0 among themselves.

    A pair goes on if it can reach the floor when the term it meets on is the rarest that it shares (what rarer terms hold is lost,
    and the more frequent ones add no more than the product of the rests), and if its sketches allow it. Pairs are formed here, in
    a sorted pass; only those that go on leave the task. ``within``: the smaller of both comes first, and none meets itself.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.repartition(parts, "meeting").sortWithinPartitions("meeting", "side")
    schema = "l long, r long"

    def tested(meeting: np.ndarray, side: np.ndarray, num: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(np.append(0, meeting[1:] != meeting[:-1]))
        place = np.arange(len(num))
        code = group * 3 + side
        first = np.where(side == 0, place + 1, np.searchsorted(code, group * 3 + 2))
        count = np.where(side == 2, 0, np.searchsorted(code, group * 3 + np.where(side == 0, 0, 2), "right") - first)
        w, rest, unit = np.ascontiguousarray(data[:, :12]).view("<f4").astype(np.float64).T
        steps = np.empty((len(num), BUCKETS), np.uint8)
        steps[:, ::2], steps[:, 1::2] = data[:, 12:] >> 4, data[:, 12:] & 15
        upto, some = np.cumsum(count), 0
        while some < len(num):
            end = max(some + 1, int(np.searchsorted(upto, (upto[some - 1] if some else 0) + PAIRS, "right")))
            n = count[some:end]
            a = np.repeat(place[some:end], n)
            b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[some:end], n)
            some = end
            can = np.flatnonzero((w[a] * w[b] + rest[a] * rest[b] >= floor - SLACK) & ((num[a] != num[b]) | (not within)))
            a, b = a[can], b[can]
            can = (steps[a] * steps[b]).sum(axis=1, dtype=np.uint32) * unit[a] * unit[b] >= floor - SLACK
            l, r = num[a[can]], num[b[can]]
            if within:
                l, r = np.minimum(l, r), np.maximum(l, r)
            if len(l):
                yield pa.RecordBatch.from_arrays([pa.array(l), pa.array(r)], names=["l", "r"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            data = batch.column("data").cast(pa.binary())
            start = np.frombuffer(data.buffers()[1], np.int32)[data.offset]
            new = [*(batch.column(c).to_numpy() for c in ("meeting", "side", "num")),
                   np.frombuffer(data.buffers()[2], np.uint8)[start:start + batch.num_rows * (12 + BUCKETS // 2)].reshape(batch.num_rows, -1)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            whole = int(np.searchsorted(held[0], held[0][-1]))  # the last meeting may go on in the next batch
            if whole:
                yield from tested(*(x[:whole] for x in held))
                held = [x[whole:].copy() for x in held]
        if held is not None:
            yield from tested(*held)

    return dealt.mapInArrow(run, schema).distinct()


def semantic_edges(chunks: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(edges, copies): chunk pairs whose tf-idf cosine reaches the threshold, as a 'semantic' edge each way.

    Equal texts are one node of the join: its first chunk carries the edges, and ``copies`` (hub, chunk_id)
    ties the others to it. The join meets only on leading terms, as in the overlap join.
    """
    rows = chunks.select("chunk_id", F.md5("chunk_text").alias("sid"), F.col("chunk_text").alias("sentence"))
    body = _leading_terms(rows.select("sid", "sentence"), threshold)
    met = cut_lineage(_met_within(body, threshold))
    close = _cosines(met, body).filter(F.round("cosine", 6) >= threshold)
    ids = cut_lineage(rows.select("chunk_id", "sid"))
    first = cut_lineage(ids.groupBy("sid").agg(F.min("chunk_id").alias("first"), F.count(F.lit(1)).alias("n")))
    named = cut_lineage(body.select("num", "sid").join(first, "sid").select("num", "first"))
    ends = close.select("l", "r").join(named.select(F.col("num").alias("l"), F.col("first").alias("src")), "l").join(
        named.select(F.col("num").alias("r"), F.col("first").alias("dst")), "r").select("src", "dst")
    # written out once: each edge goes both ways
    ends = cut_lineage(ends)
    both = ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = both.withColumn("type", F.lit("semantic")).withColumn("weight", F.lit(EDGE_WEIGHTS["semantic"]))
    copies = ids.join(first.filter("n > 1"), "sid").select(F.col("first").alias("hub"), "chunk_id")
    return edges, copies


def _cosines(pairs: DataFrame, body: DataFrame) -> DataFrame:
    """l, r, cosine of the pairs' unit vectors; the terms of many pairs are matched by one sort per Arrow batch."""
    schema = "l long, r long, cosine double"
    side = lambda p: body.select(F.col("num").alias(p), *(F.col(c).alias(f"{p}{c}") for c in ("terms", "raws", "norm")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c) for c in ("lterms", "rterms"))
            n, sizes = batch.num_rows, [c.value_lengths().to_numpy() for c in (left, right)]
            both = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode()
            codes, kinds = both.indices.to_numpy().astype(np.int64), max(1, len(both.dictionary))
            a, b = (np.repeat(np.arange(n), size) * kinds + code for size, code in zip(sizes, np.split(codes, [int(sizes[0].sum())])))
            order = np.argsort(b)
            at = np.minimum(np.searchsorted(b, a, sorter=order), max(0, len(b) - 1))
            found = np.flatnonzero(b[order[at]] == a) if len(b) else np.empty(0, np.int64)
            wa, wb = (batch.column(f"{p}raws").flatten().to_numpy() / np.repeat(batch.column(f"{p}norm").to_numpy(), size) for p, size in zip("lr", sizes))
            dot = np.bincount(a[found] // kinds, wa[found] * wb[order[at[found]]], minlength=n) if n else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("l"), batch.column("r"), pa.array(dot, pa.float64())], names=["l", "r", "cosine"])

    joined = pairs.join(side("l"), "l").join(side("r"), "r")
    return joined.mapInArrow(run, schema)


def should_highlight(pairs: DataFrame, keys: list[str], section: str = "section", answer: str = "answer") -> DataFrame:
    """pairs plus sim, overlap and highlight: does a section carry what the answer says."""
    clean = pairs.withColumn("_a", normalize_text(F.col(section))).withColumn("_b", normalize_text(F.col(answer)))
    scored = combined_similarity(clean, keys, "_a", "_b", "_sim")
    shared = sentence_overlap(
        pairs.select(*keys, F.col(section).alias("text")), pairs.select(*keys, F.col(answer).alias("text")),
        [], [], on=keys).select(*keys, F.lit(True).alias("_hit"))
    n = F.size(words(F.col("_a")))
    limit = F.lit(HIGHLIGHT_BASE) * F.when(n < HIGHLIGHT_SHORT[0], F.lit(HIGHLIGHT_SHORT[1])).when(
        n > HIGHLIGHT_LONG[0], F.lit(HIGHLIGHT_LONG[1])).otherwise(F.lit(1.0))
    overlap = F.coalesce("_hit", F.lit(False))
    sim = F.when(overlap, F.col("_sim") * F.lit(HIGHLIGHT_BOOST)).otherwise(F.col("_sim"))
    return (
        scored.join(shared, keys, "left").withColumn("overlap", overlap).withColumn("sim", sim)
        .withColumn("highlight", (F.col("sim") > limit) | F.col("overlap")).drop("_a", "_b", "_sim", "_hit")
    )


def best_section(pairs: DataFrame, keys: list[str], answer_key: str, section_no: str, section: str = "section",
                 answer: str = "answer") -> DataFrame:
    """answer_key, section_no, similarity of the highlighted section closest to the answer."""
    marked = should_highlight(pairs, keys, section, answer).filter("highlight").select(*pairs.columns)
    scored = combined_similarity(marked, keys, section, answer).withColumn("similarity", F.round("similarity", 6))
    best = F.max(F.struct(F.col("similarity"), (-F.col(section_no)).alias("neg")))
    return scored.groupBy(answer_key).agg(best.alias("b")).select(
        answer_key, (-F.col("b.neg")).alias(section_no), F.col("b.similarity").alias("similarity"))


