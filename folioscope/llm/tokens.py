"""Token ids of whole texts by a tokenizers file, with each distinct piece encoded once.

Byte-pair encoding works inside the pieces that the file's splitting pattern cuts a text into, so the ids of a text are
the ids of its pieces in order. Pieces recur; a worker encodes new ones in bulk and looks up the others. Texts with
characters beyond ASCII and the Latin-1 letters go to the tokenizer whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Characters for which the patterns below split exactly as the tokenizer files do.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
# The splitting patterns of the two kinds of tokenizer file, for such characters.
LETTER, MARK = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-/:-@\[-`{-~]"
BYTE_PIECES = re.compile(rf" ?{LETTER}+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?{MARK}+|\s+(?!\S)|\s+")
WORD_PIECES = re.compile(rf"{LETTER}+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|{MARK}+")
WORD_END = "</w>"


#: Marks a whole text among the new pieces; no plain piece begins with it.
WHOLE = "\0"


class _Codes(dict):
    """Piece to code; new pieces get the next code and wait to be encoded."""

    def __init__(self, known):
        super().__init__(known)
        self.new: list[str] = []
        self.next = len(self)

    def __missing__(self, piece: str) -> int:
        code = self[piece] = self.add(piece)
        return code

    def add(self, piece: str) -> int:
        self.new.append(piece)
        self.next += 1
        return self.next - 1


class PieceTokenizer:
    #: Pieces that are remembered. Beyond that, those seen once are forgotten.
    LIMIT = 500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        strings = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.by_word = any(t.endswith(WORD_END) for t in strings.values())
        self.pieces = (WORD_PIECES if self.by_word else BYTE_PIECES).findall
        mark = (lambda t: t.endswith(WORD_END)) if self.by_word else (lambda t: t.startswith("Ġ"))
        self.marks = np.array([mark(strings.get(i, "")) for i in range(self.tokenizer.get_vocab_size() + 1)])
        self.line_end = None if self.by_word else self._ids(["\n"])[0][0]
        self._start([], np.empty(0, np.uint32), np.empty(0, np.int64))

    def _start(self, pieces: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        self.codes = _Codes(zip(pieces, range(len(pieces))))
        self.flat, self.size, self.begin = flat, sizes, np.cumsum(sizes) - sizes
        self.seen = np.zeros(len(pieces), np.int64)

    def _forget(self) -> None:
        kept = [(p, c) for p, c in self.codes.items() if self.seen[c] > 1]
        kept = kept if len(kept) < self.LIMIT // 2 else []
        at = np.array([c for _, c in kept], np.int64)
        self._start([p for p, _ in kept], self._gathered(at), self.size[at])

    def _gathered(self, codes: np.ndarray) -> np.ndarray:
        sizes = self.size[codes]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.begin[codes] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _in_one(self, pieces: list[str], glue: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of pieces without inner white space and their numbers, from one run over their concatenation."""
        ids = np.array(self._ids([glue.join(pieces)])[0], np.uint32)
        if glue == "\n":
            ends = np.append(np.flatnonzero(ids == self.line_end) - np.arange(len(pieces) - 1), len(ids) - len(pieces) + 1) if (
                ids == self.line_end).sum() == len(pieces) - 1 else ()
            ids = ids[ids != self.line_end]
        elif self.by_word:
            ends = np.flatnonzero(self.marks[ids]) + 1
        else:
            ends = np.append(np.flatnonzero(self.marks[ids])[1:], len(ids))
        sizes = np.diff(ends, prepend=0)
        return (ids, sizes) if len(sizes) == len(pieces) and sizes.all() and sizes.sum() == len(ids) else None

    def _learn(self) -> None:
        """Encodes the new pieces: those of one form in bulk, the others and whole texts one by one."""
        new, first = self.codes.new, len(self.size)
        if not new:
            return
        if self.by_word:
            simple = [not p.startswith(WHOLE) for p in new]
            groups = [(" ", [i for i, s in enumerate(simple) if s]), (None, [i for i, s in enumerate(simple) if not s])]
        else:
            kinds: dict[str | None, list[int]] = {"": [], "\n": [], None: []}
            for i, p in enumerate(new):
                kinds[None if p.isspace() or p.startswith(WHOLE) else "" if p[0] == " " else "\n"].append(i)
            groups = list(kinds.items())
        flat, sizes, order = [self.flat], [], []
        for glue, at in groups:
            for j in range(0, len(at), 5000):
                some = [new[i] for i in at[j:j + 5000]]
                found = None if glue is None else self._in_one(some, glue)
                if found is None:
                    each = self._ids([p.removeprefix(WHOLE) for p in some])
                    found = np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each])
                flat.append(found[0])
                sizes.append(found[1])
                order += at[j:j + 5000]
        lengths = np.concatenate(sizes).astype(np.int64)
        begins, where = np.cumsum(lengths) - lengths + len(self.flat), np.array(order)
        size, begin = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        size[where], begin[where] = lengths, begins
        self.flat, self.size, self.begin = np.concatenate(flat), np.append(self.size, size), np.append(self.begin, begin)
        self.seen = np.append(self.seen, np.zeros(len(new), np.int64))
        self.codes.new = []
        assert len(self.size) == first + len(new)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has. Null is empty."""
        if len(self.codes) > self.LIMIT or len(self.flat) > 8 * self.LIMIT:
            self._forget()
        codes: list[int] = []
        ends = [0]
        for text in texts:
            if text and PLAIN.fullmatch(text):
                codes.extend(map(self.codes.__getitem__, self.pieces(text.lower() if self.by_word else text)))
            elif text:
                codes.append(self.codes.add(WHOLE + text))
            ends.append(len(codes))
        self._learn()
        at = np.array(codes, np.int64)
        self.seen += np.bincount(at, minlength=len(self.seen))
        total = np.concatenate([[0], np.cumsum(self.size[at])])
        return self._gathered(at), np.diff(total[np.array(ends)])


    def forget(self) -> None:
        """Drops all pieces; for the end of a task, since a worker lives on between tasks and stages."""
        self._start([], np.empty(0, np.uint32), np.empty(0, np.int64))


@lru_cache(maxsize=1)
def tokenizer(path: str) -> PieceTokenizer:
    """One per worker process, for the file last used, kept from task to task; its pieces are not."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core already
    return PieceTokenizer(path)
