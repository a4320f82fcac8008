"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds.

The symbols of all new words stand in one flat numpy array, and next to each the rank of the piece that it and its right
neighbour would make. A round takes each word's least rank, merges that pair, leftmost first, in all words at once, closes the
gaps, and looks up only the pairs that changed; words without a pair that makes a piece leave. Sequential encoding merges one
pair at a time, best score first, leftmost on ties. A round may merge several pairs of a word without changing the outcome:

* all occurrences of the least rank, unless the piece they make could at once join a neighbour to a piece of equal or better rank;
* any pair that no neighbour can break up before its turn: its rank beats every piece that its left symbol could end, given
  the character before it, and its right symbol could begin, given the character after it.

Words end where no piece goes on: pieces hold the space mark only at their beginning. Texts are cut there, and longer stretches
between any two characters that no piece holds side by side. A worker remembers the ids of words, up to a bound in bytes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.text import arrow_schema, keyed, map_texts

#: What stands for a space inside pieces.
MARK = "▁"
NEXT_WORD = re.compile(f"[^{MARK}](?={MARK})")
#: No pair: worse than every rank.
NONE = np.int32(2**31 - 1)
#: Bytes of remembered words and ids in one task.
REMEMBERED_BYTES = 48_000_000
#: Rounds after which a word that still has many symbols is merged on one by one.
MOST_ROUNDS, MANY_SYMBOLS = 96, 256


def _gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int = 100_000) -> np.ndarray:
    """The stretches flat[begin:begin + size], one after the other; the places are worked out for ``most`` at a time."""
    out = [flat[:0]]
    for i in range(0, len(begin), most):
        some = size[i:i + most]
        ends = np.cumsum(some)
        out.append(flat[np.repeat(begin[i:i + most] - ends + some, some) + np.arange(ends[-1])])
    return np.concatenate(out)


class PieceModel:
    """The pieces, scores and pair ranks of a SentencePiece byte-pair model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        if p.normalize("  Åﬁ x  ") != f"{MARK * 3}Åﬁ{MARK}x{MARK * 2}":
            raise ValueError("only models that leave texts as they are and begin them with a space are supported")
        self.n, ids = p.get_piece_size(), range(p.get_piece_size())
        self.pieces = [p.id_to_piece(i) for i in ids]
        kind = np.array([1 if p.is_byte(i) else 2 if p.is_control(i) else 3 if p.is_unknown(i) else 0 for i in ids])
        if (kind == 1).sum() != 256 or any(p.is_unused(i) for i in ids) or any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in ids if not kind[i]):
            raise ValueError("only models with byte pieces and with the space mark at the beginning of pieces are supported")
        self.byte_of = {int(t[3:5], 16): i for i, t in enumerate(self.pieces) if kind[i] == 1}
        number = {t: i for i, t in enumerate(self.pieces) if kind[i] == 0}
        scores = np.array([p.get_score(i) for i in ids])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.chars = {t: i for t, i in number.items() if len(t) == 1}
        self._pair_tables(number, rank)
        self._decode_tables(kind, p)
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def _pair_tables(self, number: dict[str, int], rank: np.ndarray) -> None:
        """Which pairs of pieces make which piece, and what could break a pair up."""
        code = {c: i for i, c in enumerate(sorted({c for t in number for c in t}))}
        self.n_chars = len(code) + 1  # the last one stands for all others
        self.first, self.last = np.full(self.n + 1, len(code), np.int64), np.full(self.n + 1, len(code), np.int64)
        left, right, made, beside = [], [], [], set()
        for t, i in number.items():
            self.first[i], self.last[i] = code[t[0]], code[t[-1]]
            for j in range(1, len(t)):
                beside.add(code[t[j - 1]] * self.n_chars + code[t[j]])
                a, b = number.get(t[:j]), number.get(t[j:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
        left, right, made = np.array(left, np.int64), np.array(right, np.int64), np.array(made, np.int64)
        order = np.argsort(left * (self.n + 1) + right)
        self.pair_keys = (left * (self.n + 1) + right)[order]
        self.pair_made = made[order].astype(np.int32)
        self.pair_rank = rank[self.pair_made]
        self.rank, self.beside = rank, np.array(sorted(beside), np.int64)
        # The best rank of a piece that ends in a symbol, by the character before it; and that begins with it, by the one after.
        self.before_keys, self.before_rank = self._least(self.last[left] * (self.n + 1) + right, rank[made])
        self.after_keys, self.after_rank = self._least(self.first[right] * (self.n + 1) + left, rank[made])
        # Pieces that a neighbour could join at once to a piece of equal or better rank.
        self.restless = np.zeros(self.n + 1, bool)
        self.restless[left[rank[made] <= rank[left]]] = True
        self.restless[right[rank[made] <= rank[right]]] = True

    @staticmethod
    def _least(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((values, keys))
        keys, values = keys[order], values[order]
        new = np.append(True, keys[1:] != keys[:-1])
        return keys[new], values[new]

    @staticmethod
    def _found(table: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, values[at], NONE)

    def _decode_tables(self, kind: np.ndarray, processor) -> None:
        surface = [t.replace(MARK, " ").encode() for t in self.pieces]
        for i in np.flatnonzero(kind):
            surface[i] = bytes([int(self.pieces[i][3:5], 16)]) if kind[i] == 1 else b"" if kind[i] == 2 else processor.decode([int(i)]).encode()
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(s) for s in surface], np.int64)
        self.surface_begin = np.cumsum(self.surface_size) - self.surface_size
        self.kind, self.marked = kind, np.array([t.startswith(MARK) for t in self.pieces]) & (kind == 0)

    # Encoding

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each word has."""
        known, other = self.chars, self.n
        text = "".join(words)
        sym = np.fromiter((known.get(c, other) for c in text), np.int64, len(text))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids, place = self._merged(sym, np.repeat(np.arange(len(words)), sizes))
        unknown = np.flatnonzero(ids == other)
        begins = np.cumsum(sizes) - sizes
        if not len(unknown):
            return ids, np.diff(np.searchsorted(place, np.append(begins, len(text))))
        # A character that is no piece becomes one id for each of its bytes.
        spelt = [[self.byte_of[b] for b in text[place[i]].encode("utf-8", "replace")] for i in unknown.tolist()]
        many = np.ones(len(ids), np.int64)
        many[unknown] = [len(s) for s in spelt]
        out, at = np.repeat(ids, many), np.cumsum(many) - many
        for i, s in zip(at[unknown].tolist(), spelt):
            out[i:i + len(s)] = s
        return out, np.diff(np.searchsorted(np.repeat(place, many), np.append(begins, len(text))))

    def _merged(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left once no pair makes a piece, and the place of each one's first character."""
        n = len(sym)
        if not n:
            return sym, np.empty(0, np.int64)
        beside = self.last[sym[:-1]] * self.n_chars + self.first[sym[1:]]
        at = np.minimum(np.searchsorted(self.beside, beside), len(self.beside) - 1)
        ends = np.append((word[:-1] != word[1:]) | (self.beside[at] != beside), True)  # of stretches that merge apart
        part = np.cumsum(ends) - ends
        place, rank = np.arange(n), self._ranks(sym, ends, np.arange(n))
        done_sym, done_place = [], []
        for round_ in range(n):
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(sym)))
            live = least < NONE
            if round_ >= MOST_ROUNDS and (slow := live & (size > MANY_SYMBOLS)).any():
                for s, m in zip(starts[slow].tolist(), size[slow].tolist()):
                    one_sym, one_place = self._one_by_one(sym[s:s + m], place[s:s + m])
                    done_sym.append(one_sym)
                    done_place.append(one_place)
                stay, live = np.repeat(~slow, size), live & ~slow
                kept = np.repeat(live, size)
                done_sym.append(sym[stay & ~kept])
                done_place.append(place[stay & ~kept])
            else:
                kept = np.repeat(live, size)
                if live.all():
                    kept = None
                else:
                    done_sym.append(sym[~kept])
                    done_place.append(place[~kept])
            if kept is not None:
                sym, place, rank, part, ends = sym[kept], place[kept], rank[kept], part[kept], ends[kept]
                least, size = least[live], size[live]
            if not len(sym):
                break
            take = self._chosen(sym, rank, ends, np.repeat(least, size))
            sym[take] = self._made(sym, take)
            gone = take + 1
            ends[take] = ends[gone]
            keep = np.ones(len(sym), bool)
            keep[gone] = False
            moved = take - np.arange(len(take))  # where the merged symbols stand once the gaps are closed
            sym, place, part, ends, rank = sym[keep], place[keep], part[keep], ends[keep], rank[keep]
            changed = np.unique(np.concatenate([moved, np.maximum(moved - 1, 0)]))
            rank[changed] = self._ranks(sym, ends, changed)
        sym, place = np.concatenate([*done_sym, sym]), np.concatenate([*done_place, place])
        order = np.argsort(place, kind="stable")
        return sym[order], place[order]

    def _ranks(self, sym: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the piece that the symbol at each place makes with its right neighbour."""
        right = sym[np.minimum(at + 1, len(sym) - 1)]
        found = self._found(self.pair_keys, self.pair_rank, sym[at] * (self.n + 1) + right)
        return np.where(ends[at], NONE, found).astype(np.int32)

    def _made(self, sym: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.pair_made[np.searchsorted(self.pair_keys, sym[at] * (self.n + 1) + sym[at + 1])]

    def _chosen(self, sym: np.ndarray, rank: np.ndarray, ends: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The places whose pair is merged in this round."""
        can = np.flatnonzero(rank < NONE)
        # Pairs that nothing can break up before their turn.
        left_open, right_open = np.append(True, ends[:-1])[can], ends[can + 1]
        before = self._found(self.before_keys, self.before_rank, self.last[sym[np.maximum(can - 1, 0)]] * (self.n + 1) + sym[can])
        after = self._found(self.after_keys, self.after_rank, self.first[sym[np.minimum(can + 2, len(sym) - 1)]] * (self.n + 1) + sym[can + 1])
        safe = (left_open | (rank[can] < before)) & (right_open | (rank[can] <= after))
        # The least rank of each stretch: every other one of those that overlap; only the leftmost of a restless piece.
        best = can[rank[can] == least[can]]
        chain = np.append(True, (best[1:] != best[:-1] + 1) | ends[best[:-1]])
        head = np.maximum.accumulate(np.where(chain, np.arange(len(best)), 0))
        nth = np.arange(len(best)) - head
        wait = self.restless[self._made(sym, best)]
        if wait.any():
            stretch = (np.cumsum(ends) - ends)[best]
            first = np.append(True, stretch[1:] != stretch[:-1])
            best = best[np.where(np.isin(stretch, stretch[wait]), first, nth % 2 == 0)]
        else:
            best = best[nth % 2 == 0]
        return np.union1d(best, can[safe])

    def _one_by_one(self, sym: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same merges from an agenda, for a long stretch of pieces that wait for each other."""
        s, at = sym.tolist(), place.tolist()
        after, before = [*range(1, len(s)), -1], list(range(-1, len(s) - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def offer(lefts: list[int]) -> None:
            lefts = [i for i in lefts if i >= 0 and after[i] >= 0]
            keys = np.array([s[i] * (self.n + 1) + s[after[i]] for i in lefts], np.int64)
            for i, r in zip(lefts, self._found(self.pair_keys, self.pair_rank, keys).tolist() if lefts else ()):
                if r < NONE:
                    heapq.heappush(agenda, (r, i, s[i], s[after[i]]))

        offer(list(range(len(s))))
        while agenda:
            _, i, a, b = heapq.heappop(agenda)
            j = after[i]
            if s[i] != a or j < 0 or s[j] != b:
                continue  # one of the two has merged meanwhile
            s[i] = int(self._made(np.array([a, b]), np.array([0]))[0])
            s[j] = -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer([before[i], i])
        kept = [i for i, v in enumerate(s) if v >= 0]
        return np.array([s[i] for i in kept], np.int64), np.array([at[i] for i in kept], np.int64)

    # Decoding

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The texts, in UTF-8, whose ids stand in a row. The space that encoding put first goes; stray bytes become U+FFFD."""
        size = self.surface_size[ids]
        begin = self.surface_begin[ids]
        ends = np.cumsum(sizes)
        first = (ends - sizes)[sizes > 0]
        kind = self.kind[ids]
        lead = first[kind[first] != 2]
        for i in first[kind[first] == 2].tolist():  # control ids before the first piece
            while i < len(ids) and kind[i] == 2:
                i += 1
            if i < len(ids) and i < ends[np.searchsorted(ends, i, "right")] and i not in first:
                lead = np.append(lead, i)
        lead = lead[self.marked[ids[lead]]]
        size, begin = size.copy(), begin.copy()
        size[lead] -= 1
        begin[lead] += 1
        data = _gathered(self.surface, begin, size).tobytes()
        cuts = np.append(0, np.cumsum(size))[np.append(0, ends)].tolist()
        texts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(kind == 1), "right")).tolist():
            own = slice(ends[k] - sizes[k], ends[k])
            # Bytes make a character only where they stand side by side, with nothing between them.
            runs = np.flatnonzero(np.diff(kind[own] == 1)) + 1
            parts = [(kind[own][i[0]] == 1, _gathered(self.surface, begin[own][i], size[own][i]).tobytes())
                     for i in np.split(np.arange(sizes[k]), runs)]
            texts[k] = b"".join(self._mended(t) if in_bytes else t for in_bytes, t in parts)
        return texts

    @staticmethod
    def _mended(text: bytes) -> bytes:
        """Every byte that belongs to no character, replaced."""
        out: list[str] = []
        while text:
            try:
                out.append(text.decode("utf-8"))
                break
            except UnicodeDecodeError as e:
                out.append(text[:e.start].decode("utf-8") + "�")
                text = text[e.start + 1:]
        return "".join(out).encode("utf-8")


class PieceCoder:
    """Encodes texts by the distinct words in them and remembers those."""

    def __init__(self, path: str, remembered: int = REMEMBERED_BYTES):
        self.model, self.remembered = PieceModel(path), remembered
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.size, self.begin, self.held = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), 0

    @staticmethod
    def _parts(text: str, most: int = 1_000_000) -> Iterator[str]:
        """A long text in parts that begin with a word."""
        begin = 0
        while len(text) - begin > most and (cut := NEXT_WORD.search(text, begin + most)):
            yield text[begin:cut.start() + 1]
            begin = cut.start() + 1
        yield text[begin:] if begin else text

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has. Null is empty."""
        if self.held > self.remembered:
            self._forget()
        codes: list[int] = []
        new: list[str] = []
        ends = [0]
        code = self.code
        for text in texts:
            if text:
                for part in self._parts(MARK + text.replace(" ", MARK)):
                    for word in self.model.words(part):
                        c = code.get(word)
                        if c is None:
                            c = code[word] = len(code)
                            new.append(word)
                        codes.append(c)
            ends.append(len(codes))
        if new:
            ids, sizes = self.model.encode_words(new)
            self.begin = np.append(self.begin, np.cumsum(sizes) - sizes + len(self.flat))
            self.size, self.flat = np.append(self.size, sizes), np.append(self.flat, ids.astype(np.int32))
            self.held += sum(map(len, new)) + 130 * len(new) + 4 * len(ids)
        at = np.array(codes, np.int64)
        total = np.append(0, np.cumsum(self.size[at]))
        return _gathered(self.flat, self.begin[at], self.size[at]), np.diff(total[ends])


def _encoder(path: str, remembered: int, decoded: bool) -> Callable[[], Callable[[list], dict]]:
    def make() -> Callable[[list], dict]:
        coder = PieceCoder(path, remembered)

        def run(texts: list) -> dict:
            ids, sizes = coder.encode(texts)
            out = {"ids": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(ids, pa.int32()))}
            return out | ({"text": [t.decode("utf-8") for t in coder.model.decode(ids, sizes)]} if decoded else {})
        return run
    return make


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED_BYTES,
                  decoded: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of the whole text, as the SentencePiece library gives them without begin and end ids; if
    ``decoded``, also text, what the ids stand for, decoded in the same pass.

    Null and empty texts have no ids. Very long texts are encoded whole; so are words of any length. Each row gives one row:
    repeated rows and null ids pass through; an empty table gives an empty one. Equal scores go to the leftmost pair. Other
    columns are left out, whatever their names. Map-only.
    """
    return map_texts(keyed(docs, id_col, text_col), _encoder(path, remembered, decoded), "ids array<int>" + ", text string" * decoded)


def decode_pieces(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", most: int = 500_000) -> DataFrame:
    """doc_id, ids and text, the text that the ids stand for; about ``most`` ids are decoded at a time.

    Byte pieces that make no character become U+FFFD, one each; control ids give nothing. Null and empty ids give an empty
    text, very long ones are decoded whole; an id beyond the model's, or a null one, is an error. Each row gives one row; an
    empty table gives an empty one. Other columns are left out, whatever their names. Map-only.
    """
    schema = "doc_id bigint, ids array<int>, text string"
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path)
        for batch in batches:
            for part in _slices(batch, most):
                ids = part.column("ids").flatten()
                values = ids.to_numpy(zero_copy_only=False).astype(np.int64) if not ids.null_count else np.array([-1])
                if len(values) and not (0 <= values.min() and values.max() < model.n):
                    raise ValueError(f"an id is null or outside of 0 to {model.n - 1}")
                sizes = part.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                text = pa.array(model.decode(values, sizes), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), text.cast(to.field("text").type)], schema=to)

    return rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    sizes, begin = batch.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0
    while begin < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), most, "right")))
        yield batch.slice(begin, n)
        begin += n


def piece_digests(decoded: DataFrame) -> DataFrame:
    """Per document: the number of ids and digests of the ids and of the decoded text."""
    return decoded.select(
        "doc_id", F.size(F.coalesce("ids", F.array().cast("array<int>"))).cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
