"""Stretches of words that repeat with a period, found by block convolution.

A run is a stretch whose words equal those ``period`` words on, at least twice as long as its smallest period and as long as
it can be. Periods are sought at dyadic scales. At the scale of periods from ``d`` to ``2 d - 1`` the words are cut into blocks
of ``d / 2``: every run of such a period holds a whole block that comes again, word for word, a period later. The sum of
squared differences between a block and each place of the window after it is one exact integer convolution, done by number-
theoretic transforms over a prime field; where it is zero the block occurs, and the distance is a candidate period. From
there the stretch is extended word by word in both directions. Periods below ``SHORT`` are compared place by place, which is
the same sum for blocks of one word.

A block without its first words anywhere in its window cannot occur there; such blocks are left out of the transforms. So
are blocks whose whole window lies in a run of a shorter period already found: their occurrences are multiples of it.

All work is inside a row: map-only, linear in the words but for two logarithmic factors, whatever the texts repeat.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.text import encoded, keyed, map_texts

#: A prime of the form c * 2^23 + 1 with the generator 3: transforms of up to 2^23 places, so blocks of up to 2^20.
PRIME, GENERATOR, LARGEST = 998_244_353, 3, 1 << 20
SHORT, LEAST_LENGTH = 8, 12
#: Numbers that one batch of transforms holds.
HELD = 1 << 18
#: Texts that are searched together.
TEXTS = 500


def _roots(size: int, cache: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}) -> tuple[list[np.ndarray], list[np.ndarray]]:  # noqa: B006
    """Powers of the roots of unity for each step of a transform of ``size``, and of their inverses."""
    if size not in cache:
        def powers(base: int, n: int) -> np.ndarray:
            out = np.ones(1, np.uint64)
            while len(out) < n:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
            return out[:n]

        there, back, n = [], [], size
        while n > 1:
            root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
            there.append(powers(root, n // 2))
            back.append(powers(pow(root, PRIME - 2, PRIME), n // 2))
            n //= 2
        cache[size] = there, back
    return cache[size]


def _once(x: np.ndarray) -> np.ndarray:
    """Values below twice the prime, reduced; below it unsigned wrap-around makes the other one larger."""
    return np.minimum(x, x - np.uint64(PRIME))


def transformed(rows: np.ndarray) -> np.ndarray:
    """The number-theoretic transform of each row, in bit-reversed order."""
    n, size = rows.shape
    p, a, width = np.uint64(PRIME), rows, size
    for w in _roots(size)[0]:
        v = a.reshape(n, -1, 2, width // 2)
        out = np.empty_like(v)
        out[:, :, 0] = _once(v[:, :, 0] + v[:, :, 1])
        out[:, :, 1] = (v[:, :, 0] + (p - v[:, :, 1])) * w % p
        a, width = out, width // 2
    return a.reshape(n, size)


def untransformed(rows: np.ndarray) -> np.ndarray:
    """The inverse of ``transformed``."""
    n, size = rows.shape
    p, a, width = np.uint64(PRIME), rows, 2
    for w in reversed(_roots(size)[1]):
        v = a.reshape(n, -1, 2, width // 2)
        out = np.empty_like(v)
        odd = v[:, :, 1] * w % p
        out[:, :, 0] = _once(v[:, :, 0] + odd)
        out[:, :, 1] = _once(v[:, :, 0] + (p - odd))
        a, width = out, width * 2
    return a.reshape(n, size) * np.uint64(pow(size, PRIME - 2, PRIME)) % p


def occurrences(x: np.ndarray, at: np.ndarray, block: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place, distance) where x[place:place + block] comes again ``distance`` on; first <= distance < last.

    ``x`` holds integers below 2^23; places beyond its end match nothing. Distances are searched 4 blocks at a time.
    """
    p, padded = np.uint64(PRIME), np.concatenate([x, np.full(block, x.max() + 1 if len(x) else 0)]).astype(np.uint64)
    squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(padded * padded % p)])
    places, distances = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for lo in range(first, last, 4 * block):
        hi = min(last, lo + 4 * block)
        width = hi - lo + block - 1
        size = 1 << (width - 1).bit_length()
        step = max(1, HELD // size)
        for i in range(0, len(at), step):
            some = at[i:i + step, None]
            blocks, windows = np.zeros((len(some), size), np.uint64), np.zeros((len(some), size), np.uint64)
            blocks[:, block - 1::-1] = padded[some + np.arange(block)]  # reversed: the product is a sum at each shift
            windows[:, :width] = padded[np.minimum(some + lo + np.arange(width), len(padded) - 1)]
            cross = untransformed(transformed(blocks) * transformed(windows) % p)[:, block - 1:width]
            start = np.minimum(some + lo + np.arange(hi - lo), len(x))
            apart = squares[some + block] - squares[some] + squares[start + block] - squares[start] + np.uint64(2) * (p - cross)
            row, shift = np.nonzero(apart % p == 0)
            places.append(some[row, 0])
            distances.append(shift + lo)
    return np.concatenate(places), np.concatenate(distances)


def _equal_to(x: np.ndarray, at: np.ndarray, distance: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many places in a row, from ``at`` on in the direction ``step``, equal those ``distance`` on; up to ``most``."""
    out, live, done = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    width = 8
    while len(live) and done < most:
        width = min(width, most - done, max(1, HELD // len(live)))
        i = at[live, None] + step * (done + np.arange(width))
        j = i + distance[live, None]
        same = (i >= 0) & (j < len(x))
        same &= x[np.where(same, i, 0)] == x[np.where(same, j, 0)]
        n = np.where(same.all(1), width, same.argmin(1))
        out[live] += n
        live, done, width = live[n == width], done + width, width * 2
    return out


class _Grams:
    """The ``size`` places from each place on as a dense number within its text, to look up where they come again."""

    def __init__(self, x: np.ndarray, ends: np.ndarray, size: int):
        n = self.n = len(x) - size + 1
        h = ends[:n].astype(np.uint64)
        for j in range(size):
            h = (h + x[j:j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        self.keys = np.unique(h, return_inverse=True)[1].astype(np.int64) * n
        self.held = np.sort(self.keys + np.arange(n))

    def recur(self, at: np.ndarray, first: int, last: int) -> np.ndarray:
        """Which of the places have theirs again at a distance from ``first`` to below ``last``."""
        least, beyond = self.keys[at] + at + first, self.keys[at] + np.minimum(at + last, self.n)
        found = self.held[np.minimum(np.searchsorted(self.held, least), self.n - 1)]
        return (found >= least) & (found < beyond)


def runs_of(x: np.ndarray, ends: np.ndarray, largest: int = LARGEST) -> np.ndarray:
    """The runs (start, length, period) in the integers ``x``, by start, then period.

    ``ends`` holds, for each place, where its text ends; a place whose number occurs nowhere else stands between texts, so no
    run goes from one into the next. ``largest`` bounds a block, and with it a transform.
    """
    n = len(x)
    found = [np.empty((0, 3), np.int64)]  # first and end of the places that match those a period on, period
    for q in range(1, min(SHORT, n)):
        edge = np.diff(np.concatenate([[False], x[:-q] == x[q:], [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep = end - start >= max(LEAST_LENGTH - q, q)
        found.append(np.stack([start[keep], end[keep], np.full(keep.sum(), q)], 1))
    reach = np.zeros(n, np.int64)  # where the run of a short period that goes farthest from a place ends
    waiting, grams, d = np.concatenate(found), {}, SHORT
    longest = int((ends - np.arange(n)).max()) if n else 0
    while 2 * d <= longest:
        block = min(d // 2, largest)
        short = waiting[:, 2] <= block
        for s, e, q in waiting[short].tolist():
            reach[s:e + q] = np.maximum(reach[s:e + q], e + q)
        waiting, size = waiting[~short], min(block, 8)
        if size not in grams:
            grams[size] = _Grams(x, ends, size)
        at = np.arange(0, n - block - d + 1, block)
        at = at[(reach[at] < np.minimum(at + 2 * d + block - 1, ends[at])) & (at + block + d <= ends[at])]
        place, q = occurrences(x, at[grams[size].recur(at, d, 2 * d)], block, d, 2 * d)
        if len(q):
            order = np.lexsort((place, q))
            place, q = place[order], q[order]
            # Neighbouring blocks that come again at the same distance belong to one stretch.
            new = np.append(True, (q[1:] != q[:-1]) | (place[1:] != place[:-1] + block))
            start, period = place[new], q[new]
            end = place[np.append(np.flatnonzero(new)[1:] - 1, len(q) - 1)] + block
            same = _equal_to(x, start, period, 1, block) == block  # the sum is zero in the field only, once in a blue moon
            start, end, period = start[same], end[same], period[same]
            start, end = start - _equal_to(x, start - 1, period, -1, n), end + _equal_to(x, end, period, 1, n)
            keep = end - start >= np.maximum(LEAST_LENGTH - period, period)
            found.append(np.unique(np.stack([start[keep], end[keep], period[keep]], 1), axis=0))
            waiting = np.concatenate([waiting, found[-1]])
        d *= 2
    runs = np.concatenate(found)
    runs[:, 1] += runs[:, 2] - runs[:, 0]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)  # one stretch has one smallest period
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_in(texts: list[str | None]) -> list[tuple[list[bytes], np.ndarray]]:
    """The words of each text and its runs (start, length, period)."""
    words = [encoded(t).split() for t in texts]
    number: dict[bytes, int] = {}
    for w in words:
        for v in w:
            if v not in number:
                number[v] = len(number)
    parts, ends, at = [], [], 0
    for i, w in enumerate(words):
        parts.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)))
        parts.append(np.array([len(number) + i], np.int64))
        at += len(w) + 1
        ends.append(np.full(len(w) + 1, at - 1))
    if not parts:
        return []
    begins = np.cumsum([0, *(len(w) + 1 for w in words)])
    runs = runs_of(np.concatenate(parts), np.concatenate(ends))
    cut = np.searchsorted(runs[:, 0], begins)
    out = []
    for i, w in enumerate(words):
        own = runs[cut[i]:cut[i + 1]].copy()
        own[:, 0] -= begins[i]
        out.append((w, own))
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside runs and the first period of each run, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()])


def _finder() -> Callable[[list], dict]:
    def run(texts: list) -> dict:
        out = {"n_words": [], "runs": [], "collapsed": []}
        for words, found in (r for i in range(0, len(texts), TEXTS) for r in runs_in(texts[i:i + TEXTS])):
            out["n_words"].append(len(words))
            out["runs"].append([dict(zip(("start", "length", "period"), r)) for r in found.tolist()])
            out["collapsed"].append(collapsed(words, found).decode("utf-8"))
        return out
    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period; in words from 0) and collapsed, the text
    whose words within a run but after its first period are gone, the others joined by one space.

    Words are stretches without ASCII white space. Null and empty texts have no words, no runs and an empty collapsed text;
    very long texts are searched whole. Each row gives one row: repeated rows and null ids pass through. Ties between periods
    of one stretch go to the smallest. An empty table gives an empty one. Other columns are left out, whatever their names.
    """
    return map_texts(keyed(docs, id_col, text_col), _finder,
                     "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """Per document: n_runs, the longest run (ties: smallest start, then period), and digests of runs and collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r.length, (-r.start).alias("start"), (-r.period).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text: in one document of ten the words from some place on repeat with a period; which, and how, follows from
    the checksum of the id. A null id leaves its text as it is."""
    rows = keyed(docs).withColumns({"text": F.coalesce("text", F.lit("")), "h": F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))})
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = rows.withColumns({"w": F.when(F.col("h") % 10 == 0, words), "g": F.expr("h div 10")})
    rows = rows.withColumn("a", F.expr("if(size(w) > 0, g % size(w), null)"))
    rows = rows.withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    tail = "slice(flatten(array_repeat(slice(w, int(a + 1), int(p)), int((size(w) - a) div p + 1))), 1, int(size(w) - a))"
    return rows.select("doc_id", F.expr(f"if(a is null, text, array_join(concat(slice(w, 1, int(a)), {tail}), ' '))").alias("text"))
