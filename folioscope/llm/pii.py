"""Personal data: fixed patterns, and spans that a trained character tagger adds.

The tagger (bidirectional LSTM with CRF transitions) is trained on the driver from a bounded sample of windows whose
labels are the pattern matches (``TRAIN_DOCS``, ``TRAIN_WINDOWS``); it generalises to forms that the patterns miss. Every
text is then tagged whole: overlapping windows run in lockstep, each position takes its tag from the window in which it
lies farthest from an edge, and runs of one tag across windows become spans. The scan is map-only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm import char_tagger
from folioscope.llm.text import arrow_schema, keyed, map_texts, parts_of

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, TRAIN_WINDOWS, TRAIN_LENGTH = 4_000, 4_000, 64
#: Window length, and how many characters neighbouring windows share.
WINDOW, SHARED = 256, 32
#: Shorter windows are padded to a multiple of this.
PADDING = 32
#: Windows tagged at a time.
LANES = 2048
#: What a span that the tagger adds must hold: so many of these characters, by kind.
NEEDED = (("@", 1), (".", 2), ("0123456789", 12), ("0123456789", 9))

# Fixed patterns. Lookbehinds and possessive repeats only spare retries that cannot match.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @ sign so that a long run without one costs nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_SIGNS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        else:
            end = max(end, at + 1)  # no local part reaches over an @
        at = text.find("@", max(end, at + 1))


def luhn(digits: str) -> bool:
    twice = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns' matches, sorted."""
    found = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def labels_of(size: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tag per character: 0, or the kind's number and one. Of overlapping spans the first listed kind wins."""
    tags = np.zeros(size, np.uint8)
    for start, kind, end in sorted(spans, key=lambda s: -s[1]):
        tags[start:end] = kind + 1
    return tags


def training_windows(docs: DataFrame, rows: int, windows: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags (time, windows): around every match of the sampled documents, and as many from elsewhere."""
    schema = "symbols binary, tags binary"
    to = arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch):
                out = []
                for text in part.column("text").to_pylist():
                    spans = base_spans(text or "")
                    if not text or len(text) < length:
                        continue
                    codes, tags = char_tagger.symbols(text), labels_of(len(text), spans)
                    rng = np.random.default_rng(len(text))
                    for a, _, b in spans:
                        for at in (rng.integers(max(0, b - length), a + 1) if b - length < a else a, rng.integers(0, len(text))):
                            at = int(min(at, len(text) - length))
                            out.append({"symbols": codes[at:at + length].tobytes(), "tags": tags[at:at + length].tobytes()})
                yield pa.RecordBatch.from_pylist(out, to)

    ids = docs.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    cuts = docs.join(F.broadcast(ids), "doc_id").select("text").mapInArrow(cut, schema)
    found = cuts.orderBy(F.xxhash64("symbols", "tags"), "symbols").limit(windows).collect()
    if not found:
        return np.zeros((length, 0), np.uint8), np.zeros((length, 0), np.uint8)
    return tuple(np.frombuffer(b"".join(r[c] for r in found), np.uint8).reshape(len(found), length).T for c in ("symbols", "tags"))


def train(docs: DataFrame, rows: int = TRAIN_DOCS, windows: int = TRAIN_WINDOWS, length: int = TRAIN_LENGTH,
          id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """The tagger's parameters; none if the sampled documents hold no match at all."""
    x, y = training_windows(keyed(docs, id_col, text_col), rows, windows, length)
    return char_tagger.fit(x, y, len(KINDS) + 1) if x.shape[1] else None


def tagged(model: dict, texts: list[str]) -> list[np.ndarray]:
    """The tags of every character of each text. Windows of one padded length run together, so no tag depends on the batch."""
    stride = WINDOW - SHARED
    codes = [char_tagger.symbols(t) for t in texts]
    by_length: dict[int, list[tuple[int, int]]] = {}
    for d, c in enumerate(codes):
        for at in range(0, max(1, len(c) - SHARED), stride) if len(c) else ():
            by_length.setdefault(-(-min(WINDOW, len(c) - at) // PADDING) * PADDING, []).append((d, at))
    out = [np.zeros(len(c), np.uint8) for c in codes]
    for length, windows in by_length.items():
        for i in range(0, len(windows), LANES):
            some = windows[i:i + LANES]
            x = np.full((len(some), length), char_tagger.LINE, np.uint8)
            for row, (d, at) in zip(x, some):
                piece = codes[d][at:at + WINDOW]
                row[:len(piece)] = piece
            tags = char_tagger.decode(model, np.ascontiguousarray(x.T)).T
            for row, (d, at) in zip(tags, some):
                first = SHARED // 2 if at else 0
                last = len(out[d]) - at if at + WINDOW >= len(out[d]) else WINDOW - SHARED // 2
                out[d][at + first:at + last] = row[first:last]
    return out


def added_spans(text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of one tag that overlap no base span, hold what their kind needs and do not begin or end inside a word."""
    if not tags.any():
        return []
    taken = labels_of(len(text), base) > 0
    edges = np.concatenate([[0], np.flatnonzero(tags[1:] != tags[:-1]) + 1, [len(tags)]]).tolist()
    found = []
    for a, b in zip(edges[:-1], edges[1:]):
        kind = int(tags[a]) - 1
        if kind < 0:
            continue
        piece = text[a:b]
        a, b = a + len(piece) - len(piece.lstrip()), b - (len(piece) - len(piece.rstrip()))
        signs, least = NEEDED[kind]
        inside = b > a and ((a and text[a - 1].isalnum() and text[a].isalnum()) or (b < len(text) and text[b - 1].isalnum() and text[b].isalnum()))
        if b > a and not inside and sum(map(text[a:b].count, signs)) >= least and not taken[a:b].any():
            found.append((a, kind, b))
    return found


def _find(shared):
    def make():
        model = shared.value

        def find(texts: list) -> dict:
            texts = [t or "" for t in texts]
            base = [base_spans(t) for t in texts]
            tags = tagged(model, texts) if model else [np.zeros(len(t), np.uint8) for t in texts]
            both = [sorted(b + added_spans(t, g, b)) for t, g, b in zip(texts, tags, base)]
            rows = lambda spans: [{"kind": KINDS[k], "start": a, "end": e} for a, k, e in spans]
            return {"base": [rows(b) for b in base], "spans": [rows(s) for s in both]}

        return find

    return make


def find_pii(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base (the patterns' spans), spans (with the tagger's): kind, start, end.

    Offsets count code points, ends are exclusive; spans are sorted by start, then kind. Null and empty texts have none.
    Very long texts are searched whole, in overlapping windows. Spans that start together are ordered by kind. Rows that repeat
    an id are searched one by one; an empty table gives an empty one. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(keyed(docs, id_col, text_col), _find(shared), f"base {SPANS}, spans {SPANS}")


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _number_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, matches of each pattern, base_sha256, spans as text."""
    counts = [_number_of(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
