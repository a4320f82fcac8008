"""Encoding and decoding against the SentencePiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from folioscope.llm import piece_merges as pieces
from folioscope.llm.plans import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    return pieces.PieceCoder(PATH, remembered=200_000)


def both(coder, library, texts):
    ids, sizes = coder.encode(texts)
    cuts = np.append(0, np.cumsum(sizes)).tolist()
    got = [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])]
    want = [library.encode(t or "") for t in texts]
    for t, g, w in zip(texts, got, want):
        assert g == w, t if len(t) < 300 else t[:100]
    assert [t.decode() for t in coder.model.decode(ids, sizes)] == [library.decode(w) for w in want]


def test_random_texts(coder, library):
    rng = random.Random(1)
    alphabets = ["ab ", "the quick brown fox", "aeiou  \n\t", "日本語中文 a", "▁ a", "0123456789.,- ", "éüß ñÅﬁ  ", "\0\x01\x7f🙂🙃 �", "=-_#* ", "<s></s><0x41> <unk>"]
    texts = [None, "", " ", "▁", "\n"]
    for _ in range(4000):
        letters = rng.choice(alphabets) if rng.random() < 0.8 else "".join(alphabets)
        texts.append("".join(rng.choices(letters, k=rng.choice([1, 3, 10, 60]))))
    both(coder, library, texts)


def test_words_of_the_vocabulary_side_by_side(coder, library):
    rng = random.Random(2)
    vocabulary = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    both(coder, library, ["".join(rng.choices(vocabulary, k=rng.randrange(1, 12))) for _ in range(4000)])
    both(coder, library, vocabulary)


def test_very_long_words_and_stretches(coder, library):
    rng = random.Random(3)
    both(coder, library, [" " * 5000, "a" * 20_000, "ab" * 9_000, "-" * 3333 + "=" * 4444, "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFXYZ0123456789+/", k=20_000)),
                          "".join(rng.choices("et aoinshr", k=50_000)), "日" * 3000 + "🙂" * 2000, "ab " * 50_000])


def test_agenda_gives_the_same(library, monkeypatch):
    monkeypatch.setattr(pieces, "MOST_ROUNDS", 1)
    monkeypatch.setattr(pieces, "MANY_SYMBOLS", 2)
    rng = random.Random(4)
    both(pieces.PieceCoder(PATH), library, ["".join(rng.choices("internationalization ", k=rng.randrange(1, 90))) for _ in range(800)] + [" " * 99])


def test_long_texts_are_cut_between_words(coder):
    text = "▁▁a▁bb▁▁▁c▁" * 50
    parts = list(pieces.PieceCoder._parts(text, most=17))
    assert "".join(parts) == text and len(parts) > 20
    assert [w for p in parts for w in coder.model.words(p)] == coder.model.words(text)


def test_decoding_any_ids(coder, library):
    rng = random.Random(5)
    some = [0, 1, 2, 3, 131, 198, 230, 231, 258, 259, 260, 264, 300, 28705, 29142]
    rows = [rng.choices(some, k=rng.randrange(8)) for _ in range(3000)]
    got = coder.model.decode(np.array([i for r in rows for i in r], np.int64), np.array([len(r) for r in rows], np.int64))
    for r, g in zip(rows, got):
        assert g.decode() == library.decode(r), r


def test_table_with_nulls_repeats_and_clashing_names(spark, library):
    rows = [(1, "one  two"), (1, "one  two"), (None, "x"), (2, None), (3, ""), (4, "word " * 60_000), (5, "日本 🙂")]
    docs = spark.createDataFrame([(*r, 7, "z") for r in rows], "doc_id long, text string, ids int, n_tokens string")
    encoded = pieces.encode_pieces(docs, PATH)
    assert sorted((str(r.doc_id), str(r.ids)) for r in encoded.collect()) == sorted((str(d), str(library.encode(t or ""))) for d, t in rows)
    decoded = pieces.decode_pieces(encoded, PATH, most=1000)
    assert sorted((str(r.doc_id), r.text) for r in decoded.collect()) == sorted((str(d), t or "") for d, t in rows)
    assert sorted(map(str, pieces.encode_pieces(docs, PATH, decoded=True).collect())) == sorted(map(str, decoded.collect()))
    assert pieces.piece_digests(pieces.decode_pieces(pieces.encode_pieces(docs.limit(0), PATH), PATH)).count() == 0
    no_ids = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.piece_digests(pieces.decode_pieces(no_ids, PATH)).collect()[0][1] == 0


def test_query_is_what_the_library_gives(spark, library):
    folder = "/root/testdata/sf0.001"
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["op13_sentence_pieces"](spark, folder).collect()} == want
