"""Toxicity of texts: a noisy channel restores obfuscated words, a linear model scores what they say.

Someone who writes ``1d10t``, ``i d i o t`` or ``idiiiot`` sends a plain word through a channel that swaps letters for
look-alikes, puts separators between them and repeats them. Every such stretch becomes a lattice of what each character
may stand for; Viterbi decoding finds the cheapest path under a character trigram model of the corpus and the channel's
costs. The restored words and their beginnings are the features of a logistic model.

The character model counts all documents; it is a table of fixed size. The logistic model is fitted on a bounded sample
of labelled documents (``TRAIN_ROWS``), which is all that reaches the driver besides the tables.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.text import arrow_schema, freeing, keyed, map_texts, parts_of
from folioscope.session import cut_lineage

#: Labelled documents the model is fitted on, at most; taken in the order of a hash of their ids.
TRAIN_ROWS = 20_000
FEATURES = 4_000
PREFIXES = (3, 4, 5, 6, 7)
THRESHOLD = 0.7

# What a look-alike may stand for.
LOOK_ALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
               "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SEPARATORS = " .-_*~"

#: Symbols of the character model: a-z (accents taken off), word end, anything else.
END, OTHER, SYMBOLS = 26, 27, 28
# The base letters of Latin-1.
ACCENTED = {"a": "àáâãäåÀÁÂÃÄÅ", "c": "çÇ", "e": "èéêëÈÉÊË", "i": "ìíîïÌÍÎÏ", "n": "ñÑ", "o": "òóôõöøÒÓÔÕÖØ",
            "s": "ß", "u": "ùúûüÙÚÛÜ", "y": "ýÿÝ"}
_CODES = np.full(256, END, np.uint16)
_CODES[48:58] = _CODES[192:] = OTHER
for _letter in "abcdefghijklmnopqrstuvwxyz":
    for _form in _letter + _letter.upper() + ACCENTED.get(_letter, ""):
        _CODES[ord(_form)] = ord(_letter) - 97
_CODES[ord("?")] = OTHER  # what Latin-1 cannot write

LETTERS = re.compile(r"[^\W\d_]+")
#: Punctuation around a token, and runs of one sign behind it, say nothing about its letters.
BEFORE, BEHIND = "\"'([", ".,;:!?\"')]"
SIGN_RUN = re.compile(r"([^\w\s])\1\1+\Z")
THRICE = re.compile(r"(.)\1\1")
#: Single letters (or look-alikes) with a separator between them, three or more; and what every such stretch holds.
SPACED = re.compile(r"(?<![^\s.\-_*~])(?:[^\W_]|[@$!|+(€])(?:[ .\-_*~]{1,2}(?:[^\W_]|[@$!|+(€])){2,}(?![^\s.,;:?\-_*~])")
SPACED_INSIDE = re.compile(r"[ .\-_*~][^\s.\-_*~][ .\-_*~]{1,2}[^\s.\-_*~](?![^\s.,;:?\-_*~])")
RUN = re.compile(r"(.)\1*", re.S)


def symbols(text: str) -> np.ndarray:
    return _CODES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


def character_counts(texts: DataFrame) -> np.ndarray:
    """Counts of character triples over all texts, SYMBOLS x SYMBOLS x SYMBOLS."""
    to = arrow_schema("triple int, n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SYMBOLS ** 3, np.int64)
        for batch in batches:
            for part in parts_of(batch):
                s = symbols("\n\n".join(t for t in part.column("text").to_pylist() if t)).astype(np.int32)
                if len(s) > 2:
                    counts += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], schema=to)

    counts = np.zeros(SYMBOLS ** 3, np.int64)
    rows = texts.select("text").mapInArrow(freeing(run), "triple int, n bigint").groupBy("triple").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # at most SYMBOLS ** 3 rows
        counts[r["triple"]] = r["n"]
    return counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def character_costs(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """-log P(third | first two), each order smoothed by the one below."""
    one = (counts.sum((0, 1)) + 1.0) / (counts.sum() + SYMBOLS)
    pairs = counts.sum(0)
    two = (pairs + weight * one) / (pairs.sum(1, keepdims=True) + weight)
    return -np.log((counts + weight * two) / (counts.sum(2, keepdims=True) + weight)).astype(np.float32)


class Channel:
    """Restores stretches of text by Viterbi decoding."""

    SWAP, DROP, KEEP, REPEAT, KEPT_ODD = 0.5, 0.2, 2.0, 0.3, 4.0
    #: After so many steps, what all paths agree on is settled. Paths that differ further back than ``PENDING`` characters end.
    WINDOW, PENDING = 32, 256

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()

    def options(self, char: str, times: int) -> list[tuple[str, float]]:
        """What a run of one character may stand for, with the channel's cost."""
        if char.isspace() or char in SEPARATORS:
            return [("", self.DROP), (" ", self.KEEP)]
        letters = LOOK_ALIKES.get(char, "")
        if letters:
            found = [(x * k, self.SWAP * times) for x in letters for k in sorted({1, min(times, 2)})]
            return [*found, (char * times, self.KEPT_ODD * times)]
        if times == 1 or not char.isalpha():
            return [(char * min(times, 2), 0.0)]
        once = (char, self.REPEAT * (times - 1))
        return [once, (char * 2, self.REPEAT * (times - 2))]

    def settled(self, paths: dict[tuple[int, int], tuple[float, str]], done: list[str]) -> dict[tuple[int, int], tuple[float, str]]:
        """The paths without the beginning that they share, which goes to ``done``."""
        shared = os.path.commonprefix([text for _, text in paths.values()])
        best = min(paths.values())[1]
        if len(best) > len(shared) + self.PENDING:
            ahead = best[:len(best) - self.PENDING // 2]
            shared = ahead[:ahead.rfind(" ") + 1] or ahead  # between words, if there are any
            paths = {at: path for at, path in paths.items() if path[1].startswith(shared)}
        done.append(shared)
        return {at: (total, text[len(shared):]) for at, (total, text) in paths.items()}

    def restored(self, stretch: str) -> str:
        """The cheapest reading of a stretch of any length, in time linear in it."""
        paths: dict[tuple[int, int], tuple[float, str]] = {(END, END): (0.0, "")}
        done: list[str] = []
        for nth, run in enumerate(RUN.finditer(stretch), 1):
            steps: dict[tuple[int, int], tuple[float, str]] = {}
            for written, cost in self.options(run[1], len(run[0])):
                codes = symbols(written).tolist()
                for (a, b), (total, text) in paths.items():
                    total += cost
                    for c in codes:
                        total += self.costs[a][b][c]
                        a, b = b, c
                    if (a, b) not in steps or (total, text + written) < steps[a, b]:
                        steps[a, b] = (total, text + written)
            paths = steps if nth % self.WINDOW else self.settled(steps, done)
        return "".join(done) + min((total + self.costs[a][b][END], text) for (a, b), (total, text) in paths.items())[1]

    def words(self, token: str) -> list[str]:
        """Letter words of a lower-case token, restored too if it looks obfuscated."""
        token = SIGN_RUN.sub("", token).lstrip(BEFORE).rstrip(BEHIND)
        plain = token.isalpha()
        if (plain and not THRICE.search(token)) or not any(map(str.isalpha, token)):
            return [token] if plain else LETTERS.findall(token)
        return LETTERS.findall(token) + LETTERS.findall(self.restored(token))


def features(word: str) -> Iterator[str]:
    yield "=" + word
    for n in PREFIXES:
        if len(word) >= n:
            yield "^" + word[:n]


@dataclass(frozen=True)
class ToxicityModel:
    costs: np.ndarray
    weights: dict[str, float]
    bias: float

    def reader(self) -> "Reader":
        return Reader(Channel(self.costs), set(self.weights))


class Reader(dict):
    """Token to its known features, remembered up to a fixed number of tokens."""

    LIMIT = 300_000

    def __init__(self, channel: Channel, known: set[str] | None):
        self.channel, self.known = channel, known
        self.heads = None if known is None else {f[1:4] for f in known}  # no other word has a known feature

    def _of(self, token: str) -> tuple[str, ...]:
        words = self.channel.words(token)
        if self.known is None:
            return tuple({f for w in words for f in features(w)})
        return tuple({f for w in words if w[:3] in self.heads for f in features(w)} & self.known)

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[token] = self._of(token)
        return value

    def features(self, text: str | None) -> set[str]:
        if not text:
            return set()
        text = text.lower()
        found = set().union(*map(self.__getitem__, set(text.split())))
        if SPACED_INSIDE.search(text):
            for m in SPACED.finditer(text):
                found.update(self[m[0]])
        return found


def _labelled(docs: DataFrame, labels: DataFrame, rows: int, fold: Column, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """doc_id, toxic, text of at most ``rows`` labelled documents that ``fold`` admits."""
    chosen = (labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
              .dropna().where(fold).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return keyed(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")


def fold_of(parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, fold: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """The character model of all documents and a logistic model of the labelled ones in ``fold``.

    Without labelled documents of both kinds there are no features and every text gets the same score.
    """
    fold = fold_of(3) != 1 if fold is None else fold
    costs = character_costs(character_counts(keyed(docs, id_col, text_col)))
    sample = cut_lineage(_labelled(docs, labels, rows, fold, id_col, text_col, label_col).repartition("doc_id"))
    of = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = of.get(1, 0), sum(n for k, n in of.items() if k != 1)
    if not toxic or not clean:
        return ToxicityModel(costs, {}, math.log((toxic + 1) / (clean + 1)))
    shared = docs.sparkSession.sparkContext.broadcast(costs)
    to = arrow_schema("feature string, toxic int, n int")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Channel(shared.value), None)
        for batch in batches:
            for part in parts_of(batch):
                found: dict[tuple[str, int], int] = {}
                for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    for f in reader.features(text):
                        found[f, label] = found.get((f, label), 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([t for _, t in found], pa.int32()),
                                                  pa.array(list(found.values()), pa.int32())], schema=to)

    bad, good = F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("toxic") != 1, F.col("n")).otherwise(0))
    counted = sample.select("text", "toxic").mapInArrow(freeing(read), "feature string, toxic int, n int").groupBy("feature").agg(bad.alias("bad"), good.alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (toxic + 1)) - F.log((F.col("good") + 0.5) / (clean + 1))
    strength = odds / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = (counted.withColumn("strength", strength).where("bad >= 3 and strength > 2.5")
            .orderBy(F.desc("strength"), "feature").limit(FEATURES).collect())
    names = [r["feature"] for r in best]
    known = ToxicityModel(costs, dict.fromkeys(names, 0.0), 0.0)
    hits = sample.select(F.col("toxic").cast("bigint").alias("doc_id"), "text")  # the label takes the id's place
    found = map_texts(hits, _matches(docs.sparkSession.sparkContext.broadcast(known)), "found array<string>").collect()
    weights, bias = fitted([r["found"] for r in found], [int(r["doc_id"] == 1) for r in found], names)
    return ToxicityModel(costs, weights, bias)


def _matches(shared):
    def make():
        reader = shared.value.reader()
        return lambda texts: {"found": [sorted(reader.features(t)) for t in texts]}
    return make


def fitted(found: list[list[str]], labels: list[int], names: list[str], steps: int = 1000, rate: float = 0.05,
           penalty: float = 1e-5) -> tuple[dict[str, float], float]:
    """Weights (none negative) and bias of a logistic model over the presence of features, by Adam steps."""
    order = {f: i for i, f in enumerate(names)}
    rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
    cols = np.array([order[f] for x in found for f in x], np.int64)
    y = np.array(labels, float)
    w = np.zeros(len(names) + 1)
    w[-1] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        z = w[-1] + np.bincount(rows, w[cols], minlength=len(y))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        slope = np.append(np.bincount(cols, error[rows], minlength=len(names)) / len(y) + penalty * w[:-1], error.mean())
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope ** 2
        w -= rate * (mean / (1 - 0.9 ** k)) / (np.sqrt(square / (1 - 0.999 ** k)) + 1e-8)
        w[:-1] = np.maximum(0.0, w[:-1])
    return {f: float(w[i]) for f, i in order.items() if w[i] > 0}, float(w[-1])


def scorer(shared):
    """Per task: scores of a list of texts under a broadcast model."""
    def make():
        model = shared.value
        reader = model.reader()

        def scores(texts: list) -> dict:
            z = [model.bias + sum(map(model.weights.__getitem__, sorted(reader.features(t)))) for t in texts]
            return {"score": [1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in z]}
        return scores
    return make


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every row. Null and empty texts get the score of no evidence.

    Very long texts are read whole. Repeated rows and null ids give a row each; equal texts get equal scores. An empty table gives
    an empty one. Other columns are not looked at, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(keyed(docs, id_col, text_col), scorer(shared), "score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, all columns as they are; map-only.

    Null and empty texts have the score of no evidence, so they stay unless that is toxic. Very long texts are read whole. Each
    of repeated rows is judged, and alike; a score at the threshold goes. An empty table stays empty.
    """
    make = scorer(docs.sparkSession.sparkContext.broadcast(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = make()
        for batch in batches:
            for part in parts_of(batch, text_col):
                clean = np.array(scores(part.column(text_col).to_pylist())["score"]) < threshold
                yield part.filter(pa.array(clean))

    return docs.mapInArrow(freeing(run), docs.schema)


def judged(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Scores with held_out (fold 1 of 3) and predicted."""
    return scores.select("doc_id", F.coalesce(fold_of(3) == 1, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
