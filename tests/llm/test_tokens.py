"""Tokenising, token files and packing: exact round trips."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folioscope.llm import id_coder, packing, token_files
from folioscope.llm.packing import first_fit_decreasing, pack, pack_group
from folioscope.llm.token_files import read_tokens, write_tokens
from folioscope.llm.tokens import PieceTokenizer, tokenizer
from folioscope.session import scratch_path

WORDS, BYTES = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
SCHEMA = "doc_id bigint, text string, ids int, part string, start double"
ODD = ["", None, "don't we'll x's\n\n  hi \t", "<|endoftext|> a", "… é é İ ABC's ''s a_b 12 ½", "a" * 4000, "\n", "   ", "ÀÉ ß ÿ×÷",
       "one two " * 3000, " 's 'S x 're", "日本語 text", "\u2028x\x1cy", "12345 6 7a b8"]


def whole(path, text):
    return tokenizer(path).tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_piecewise_ids_are_those_of_whole_texts(path):
    rng, tk = random.Random(3), PieceTokenizer(path)
    tk.LIMIT = 50  # forgets all the time
    texts = ODD + ["".join(rng.choices("ab Z'é\n.,-_19 \t<|>sœ", k=rng.randrange(60))) for _ in range(3000)]
    for i in range(0, len(texts), 100):
        ids, sizes = tk.encode(texts[i:i + 100])
        ends = np.cumsum(sizes)
        for text, n, end in zip(texts[i:i + 100], sizes, ends):
            assert ids[end - n:end].tolist() == tk.tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_coder_round_trips_and_notices_damage():
    rng = np.random.default_rng(0)
    pieces = [np.array(x, np.uint32) for x in ([5], [0] * 2048, [65535] * 2048, rng.integers(0, 65536, 2048), np.arange(2000) % 7,
                                              (rng.pareto(0.4, 1500).astype(np.int64) % 49408), [])]
    coded = id_coder.encode(pieces)
    assert all((a == b).all() for a, b in zip(id_coder.decode(coded), pieces))
    assert all((a == b).all() for a, b in zip(id_coder.decode(coded[::-1]), pieces[::-1]))  # each block alone
    assert len(coded[1]) < 60 and len(coded[4]) < 100
    bad = bytearray(coded[3])
    bad[40] ^= 4
    with pytest.raises(ValueError):
        id_coder.decode([bytes(bad)])
    with pytest.raises(ValueError):
        id_coder.encode([np.array([1 << 16])])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in rows], SCHEMA)


def test_token_files_read_back_in_id_order(spark):
    rows = [(10 * i, t) for i, t in enumerate(ODD)] + [(None, "first"), (70, "again"), (70, "again"), ((1 << 60) + 1, "last one")]
    path = scratch_path(spark, "tokens")
    write_tokens(frame(spark, rows).repartition(3), path, WORDS, end_id=1)
    got = sorted(read_tokens(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids) and ids[-1] == 1
        at += len(ids)
    found = [(r.doc_id, np.frombuffer(bytes(r.ids), "<u4")[:-1].tolist()) for r in got]
    key = lambda d: (d is not None, d or 0)
    assert [d for d, _ in found] == sorted((d for d, _ in rows), key=key)
    assert sorted(found, key=str) == sorted(((d, whole(WORDS, t)) for d, t in rows), key=str)
    empty = scratch_path(spark, "tokens")
    write_tokens(frame(spark, []), empty, WORDS, end_id=1)
    assert read_tokens(spark, empty).count() == 0


def test_first_fit_decreasing_is_the_plain_one():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.randrange(1, 65) for _ in range(rng.randrange(0, 40))]
        bins: list[list[int]] = []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fit = next((b for b in bins if sum(sizes[k] for k in b) + sizes[i] <= 64), None)
            bins.append([i]) if fit is None else fit.append(i)
        assert first_fit_decreasing(sizes, 64) == bins


def test_groups_hold_every_token_once():
    rng = random.Random(4)
    for _ in range(100):
        totals = [rng.choice([1, 5, 64, 65, 200, rng.randrange(1, 300)]) for _ in range(rng.randrange(0, 60))]
        seen = set()
        for pieces in pack_group(totals, 64, 4):
            assert 0 < sum(p[2] for p in pieces) <= 64
            for doc, start, size in pieces:
                tokens = {(doc, t) for t in range(start, start + size)}
                assert size > 0 and not tokens & seen
                seen |= tokens
        assert seen == {(d, t) for d, n in enumerate(totals) for t in range(n)}


def test_packed_sequences_hold_every_document(spark):
    rng = random.Random(6)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "word " * rng.randrange(900)) for i in range(150)] + [(3, ODD[3]), (None, "x y"), (None, "x y")]
    pieces = pack(frame(spark, rows).repartition(4), BYTES, length=256, group_docs=60).collect()
    want: dict = {}
    for doc, text in rows:
        want.setdefault((doc, len(whole(BYTES, text)) + 1), []).append(whole(BYTES, text) + [0])
    fill: dict = {}
    tokens: dict = {}
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert len(ids) == p.length
        fill.setdefault(p.sequence_id, []).append((p.offset, p.length))
        tokens.setdefault((p.doc_id, p.doc_tokens), []).extend((p.start + k, t) for k, t in enumerate(ids))
    for parts in fill.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 256
    assert {k: sorted(v) for k, v in tokens.items()} == {k: sorted((i, t) for ids in v for i, t in enumerate(ids)) for k, v in want.items()}
    total = sum(len(ids) for v in want.values() for ids in v)
    assert sum(256 - sum(n for _, n in parts) for parts in fill.values()) < 0.03 * total
    assert zlib.crc32(b"") == 0 and pack(frame(spark, []), BYTES).count() == 0


def test_many_repeated_rows_are_dealt_over_groups(spark):
    docs = spark.range(50_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("same text").alias("text"), F.lit(1).alias("part")).repartition(4)
    rows = packing.tokenised(docs, BYTES, 0)
    assert rows.groupBy("nth").count().agg(F.max("count")).first()[0] <= 4
    pieces = packing.pack(docs, BYTES)
    sizes = pieces.groupBy((F.col("sequence_id") / 2 ** 32).cast("int").alias("group")).agg(F.count("*").alias("n"))
    assert sizes.agg(F.sum("n")).first()[0] >= 50_000 and sizes.agg(F.max("n")).first()[0] < 3 * packing.GROUP_DOCS


def test_near_empty_documents_take_linear_time(spark):
    import time
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")).coalesce(1)
    began = time.time()
    segments = token_files.token_segments(docs, WORDS, end_id=1).collect()
    assert sum(len(s.docs) for s in segments) == 60_000 and time.time() - began < 60
