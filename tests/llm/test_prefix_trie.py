"""The conversation trie against plain dictionaries."""

import hashlib
import random
import zlib

import numpy as np

from folioscope.llm import prefix_trie as trie


def rebuilt(turns, shared):
    own = {}
    for c, t, r, x in turns:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    if not shared:
        return own
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + v[h:]
    return out


def plain(turns, shared):
    members = {}
    for c, seq in rebuilt(turns, shared).items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append((c, len(seq) == d))
    rows = {}
    for seq, of in members.items():
        below = [s for s in members if s[:len(seq)] == seq]
        children = [s for s in below if len(s) == len(seq) + 1]
        leaf = [s for s in below if not any(len(t) == len(s) + 1 and t[:len(s)] == s for t in below)]
        saved = sum((len(members[s]) - 1) * len(s[-1][1]) for s in below if s)
        ends = ",".join(map(str, sorted(c for c, e in of if e)))
        rows[(min(c for c, _ in of), len(seq))] = (
            min(c for c, _ in members[seq[:-1]]) if seq else None, len(of), len(children), len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest())
    return rows


def found(spark, turns, **options):
    df = spark.createDataFrame([(*t, 5, "z") for t in turns], "conv_id long, turn long, role string, text string, depth int, key string").repartition(3)
    rows = trie.conversation_trie(df, **options).collect()
    out = {(r.conv_id, r.depth): tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


def random_turns(rng):
    turns = []
    for c in rng.sample(range(-3, 260), 70) + [0, 100, 200]:
        for t in range(rng.choice([0, 1, 2, 4, 7]) + (c % 50 == 0)):
            turns.append((c, rng.choice([t, t, None, 3]), rng.choice(["user", "bot", None]), rng.choice(["a", "bb", "ééé", None, ""])))
    return turns + turns[:5]  # repeated rows


def test_trie_is_that_of_dictionaries(spark):
    rng = random.Random(1)
    for shared, in_task in ((True, 10_000), (True, 20), (False, 7)):
        turns = random_turns(rng)
        assert found(spark, turns, shared=shared, in_task=in_task) == plain(turns, shared)


def test_long_conversation_in_slices(spark, monkeypatch):
    monkeypatch.setattr(trie, "SLICE", 7)
    turns = [(c, t, "u", f"t{t // (40 * c)}" if c < 3 else "x" * t) for c in (1, 2, 3) for t in range(60)] + [(None, 1, "u", "x"), (4, 1, None, None)]
    assert found(spark, turns, in_task=25) == plain(turns, False)


def test_one_node_with_most_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "MEMBERS", 10)
    turns = [(c, 0, "u", "same") for c in range(400)] + [(c, 1, "u", "also") for c in range(150)]
    got = found(spark, turns, in_task=50)
    assert got == {
        (0, 0): (None, 400, 1, 1, 399 * 4 + 149 * 4, hashlib.sha256(b"").hexdigest()),
        (0, 1): (0, 400, 1, 1, 399 * 4 + 149 * 4, hashlib.sha256(",".join(map(str, range(150, 400))).encode()).hexdigest()),
        (0, 2): (0, 150, 0, 1, 149 * 4, hashlib.sha256(",".join(map(str, range(150))).encode()).hexdigest())}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.conversation_trie(empty).count() == 0 and trie.conversation_trie(empty, shared=True).count() == 0


def test_split_rounds_on_random_forests():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 400):
        for reach in (1, 3, n):  # paths, bushes, stars
            parent = np.array([i if i % 97 == 0 else max(i - i % 97, i - 1 - int(rng.integers(reach))) for i in range(n)])
            top, depth = np.arange(n), np.zeros(n, np.int64)
            weight, values = rng.integers(1, 5, n), rng.integers(0, 9, (n, 2))
            want, heavy = values.copy(), weight.copy()
            for i in range(n):
                if parent[i] != i:
                    top[i], depth[i] = top[parent[i]], depth[parent[i]] + 1
            for i in range(n - 1, -1, -1):
                if parent[i] != i:
                    want[parent[i]] += want[i]
                    heavy[parent[i]] += heavy[i]
            order = rng.permutation(n)
            back = np.argsort(order)
            got = trie.split_rounds(back[top[order]], back[parent[order]], depth[order], heavy[order], values[order])
            assert (got == want[order]).all()
