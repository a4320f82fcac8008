"""An adaptive context-mixing range coder for token ids.

Ids are coded in blocks that know nothing of each other: every block starts from a fresh model and carries a checksum.
In a block, each id is predicted by three orders: order 2 and order 1 name the id that last followed the two (or the
one) ids before it, order 0 is an adaptive distribution over all ids, coded in four 4-bit digits. The orders' shares are
mixed by adaptive weights, chosen by how often the predictors have been right in their context. The mixture drives one
arithmetic coder with a 64-bit range and 16-bit output words.

All blocks of a call run in lockstep, one column of the state each, so a coding step is a few array operations. Encoder
and decoder run the same model code.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
#: Blocks coded at a time.
LANES = 2048
#: Contexts of orders 1 and 2, and of the last digit.
SLOTS, LAST = 2048, 256
#: What a seen digit adds to its count of 1, and a right order to its weight.
DIGIT_STEP, MIX_STEP = 6, 2
FLOOR = np.uint64(1 << 48)
MAGIC = b"IDC1"
U16, U32, U48 = np.uint64(16), np.uint64(32), np.uint64(48)


_BELOW = np.tril(np.ones((16, 16), np.float32))  # times counts: their running sums


class _Words:
    """The arithmetic coder's state and words, one row per block. ``low`` of a decoder is its distance from the low end."""

    def __init__(self, lanes: int, words: np.ndarray | None = None):
        self.reads = words is not None
        self.words = np.zeros((lanes, 4096), np.uint32) if words is None else words
        self.lanes, self.at = np.arange(lanes), np.zeros(lanes, np.int64)
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.whole = self
        if self.reads:
            for _ in range(4):
                self._shift(slice(None))

    def some(self, which: slice | np.ndarray) -> "_Words":
        """The state of some blocks; its changes go back with ``give_back``."""
        part = object.__new__(_Words)
        part.reads, part.whole = self.reads, self.whole
        part.lanes, part.at, part.low, part.range = self.lanes[which], self.at[which], self.low[which], self.range[which]
        return part

    def give_back(self, to: "_Words", which: np.ndarray) -> None:
        to.at[which], to.low[which], to.range[which] = self.at, self.low, self.range

    def _shift(self, which: slice | np.ndarray) -> None:
        at, lanes, whole = self.at[which], self.lanes[which], self.whole
        if self.reads:
            self.low[which] = (self.low[which] << U16) | whole.words[lanes, at]
        else:
            if len(at) and at.max() >= whole.words.shape[1]:
                whole.words = np.concatenate([whole.words, np.zeros_like(whole.words)], axis=1)
            whole.words[lanes, at] = self.low[which] >> U48
            self.low[which] <<= U16
        self.at[which] += 1

    def renew(self) -> None:
        """Brings every range to 48 bits or more."""
        while len(short := np.flatnonzero(self.range < FLOOR)):
            self._shift(short)
            self.range[short] <<= U16

    def point(self, total: np.ndarray) -> np.ndarray:
        """Where in 0..total-1 the decoder stands; divides its range by the total."""
        self.range //= total
        return np.minimum(self.low // self.range, total - np.uint64(1))

    def narrow(self, start: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        """To the part start..start+size-1 of total."""
        if self.reads:
            self.low -= start * self.range
        else:
            self.range //= total
            moved = start * self.range
            self.low += moved
            carried = np.flatnonzero(self.low < moved)
            if len(carried):
                self.whole.words[self.lanes[carried], self.at[carried] - 1] += np.uint32(1)
        self.range *= size

    def finish(self) -> list[bytes]:
        for _ in range(4):
            self._shift(slice(None))
        for k in range(int(self.at.max()) - 1, 0, -1):  # carries
            self.words[:, k - 1] += self.words[:, k] >> np.uint32(16)
        return [self.words[i, :n].astype(">u2").tobytes() for i, n in enumerate(self.at.tolist())]


class _Mixer:
    """The model of every block. Tables are flat, one stretch per block."""

    def __init__(self, lanes: int):
        # per context: the id that followed, times 4, plus how far it is trusted (0 unseen, then 1 to 3)
        self.followed = [np.zeros(lanes * SLOTS, np.int32) for _ in range(2)]
        self.weights = np.tile(np.array([2, 1, 3], np.float32), (lanes * 32, 1))
        self.digits = [np.ones((lanes * contexts, 16), np.uint16) for contexts in (1, 16, 256, LAST)]
        self.before = np.zeros((2, lanes), np.int64)

    def step(self, coder: _Words, ids: np.ndarray | None) -> np.ndarray:
        """Codes one id of each of the coder's blocks, or decodes it."""
        n, lanes = len(coder.lanes), coder.lanes
        old, last = self.before[0, :n], self.before[1, :n]
        slots = [lanes * SLOTS + (last & (SLOTS - 1)), lanes * SLOTS + ((last * 31 + old * 0x9E5 + (old >> 7)) & (SLOTS - 1))]
        held = [self.followed[k].take(slots[k]) for k in range(2)]
        guess1, guess2 = held[0] >> 2, held[1] >> 2
        trust1, trust2 = held[0] & 3, held[1] & 3
        same = guess1 == guess2
        context = lanes * 32 + (trust2 * 4 + trust1 + 16 * same)
        w = self.weights.take(context, axis=0)
        two = np.where(trust2 > 0, w[:, 0], np.float32(0))
        one = np.where((trust1 == 0) | same, np.float32(0), w[:, 1])
        end1 = two + one
        total = (end1 + w[:, 2]).astype(np.uint64)
        coder.renew()
        if coder.reads:
            point = coder.point(total).astype(np.float32)
            kind = (point >= two).astype(np.int64) + (point >= end1)
        else:
            kind = np.where((ids == guess2) & (trust2 > 0), 0, np.where((ids == guess1) & (one > 0), 1, 2))
        first, second = kind == 0, kind == 1
        start = np.where(first, np.float32(0), np.where(second, two, end1))
        size = np.where(first, two, np.where(second, one, w[:, 2]))
        coder.narrow(start.astype(np.uint64), size.astype(np.uint64), total)
        self.weights.reshape(-1)[context * 3 + kind] = size + np.float32(MIX_STEP)
        out = np.where(first, guess2, guess1).astype(np.int64)
        rest = np.flatnonzero(kind == 2)
        if len(rest):
            part = coder.some(rest)
            out[rest] = self._order_zero(part, None if ids is None else ids[rest])
            part.give_back(coder, rest)
        for k, guess, trust in ((0, guess1, trust1), (1, guess2, trust2)):
            trusted = np.where(guess == out, np.minimum(trust + 1, 3), 1)
            self.followed[k][slots[k]] = out * 4 + trusted
        self.before[0, :n], self.before[1, :n] = last, out
        return out

    def _order_zero(self, coder: _Words, ids: np.ndarray | None) -> np.ndarray:
        known, at = np.zeros(len(coder.lanes), np.int64), np.arange(len(coder.lanes))
        for k, table in enumerate(self.digits):
            contexts = (1, 16, 256, LAST)[k]
            row = coder.lanes * contexts + (known & (contexts - 1))
            if k in (1, 3):
                coder.renew()
            counts = np.ascontiguousarray(table.take(row, axis=0).T).astype(np.float32)
            ends = _BELOW @ counts
            total = ends[15].astype(np.uint64)
            if coder.reads:
                digit = (ends <= coder.point(total).astype(np.float32)).view(np.int8).sum(axis=0, dtype=np.int8).astype(np.int64)
            else:
                digit = (ids >> (12 - 4 * k)) & 15
            flat = digit * len(at) + at
            size = counts.reshape(-1).take(flat)
            coder.narrow((ends.reshape(-1).take(flat) - size).astype(np.uint64), size.astype(np.uint64), total)
            table.reshape(-1)[row * 16 + digit] = size + DIGIT_STEP
            known = known * 16 + digit
        return known


def _in_lockstep(sizes: list[int], words: np.ndarray | None, ids: np.ndarray | None) -> tuple[np.ndarray, _Words]:
    """Runs blocks of falling size; ids are (time, blocks)."""
    coder, model = _Words(len(sizes), words), _Mixer(len(sizes))
    active = np.searchsorted(-np.array(sizes), -np.arange(sizes[0]), "left")
    out = np.zeros((sizes[0], len(sizes)), np.int64)
    for t, n in enumerate(active.tolist()):
        part = coder.some(slice(0, n))  # a view
        out[t, :n] = model.step(part, None if ids is None else ids[t, :n])
    return out, coder


def blocks_of(ids: np.ndarray) -> list[np.ndarray]:
    return [ids[i:i + BLOCK] for i in range(0, len(ids), BLOCK)]


def encode(pieces: list[np.ndarray]) -> list[bytes]:
    """One block for each piece of ids below 65,536: magic, number of ids, checksum, words."""
    if any(len(p) and int(p.max()) >= 1 << 16 for p in pieces):
        raise ValueError("ids of 65,536 and more cannot be coded")
    done = [MAGIC + struct.pack("<II", len(p), zlib.crc32(p.astype("<u4").tobytes())) for p in pieces]
    order = sorted((i for i in range(len(pieces)) if len(pieces[i])), key=lambda i: -len(pieces[i]))
    for i in range(0, len(order), LANES):
        some = order[i:i + LANES]
        table = np.zeros((len(some), len(pieces[some[0]])), np.int64)
        for row, k in zip(table, some):
            row[:len(pieces[k])] = pieces[k]
        _, coder = _in_lockstep([len(pieces[k]) for k in some], None, np.ascontiguousarray(table.T))
        for k, words in zip(some, coder.finish()):
            done[k] += words
    return done


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block, checked against its checksum."""
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(blocks)
    heads = []
    for b in blocks:
        if b[:4] != MAGIC:
            raise ValueError("not a block of ids")
        heads.append(struct.unpack_from("<II", b, 4))
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][0])
    for i in range(0, len(order), LANES):
        some = [k for k in order[i:i + LANES] if heads[k][0]]
        if not some:
            continue
        payloads = [np.frombuffer(blocks[k], ">u2", offset=12) for k in some]
        words = np.zeros((len(some), max(map(len, payloads)) + 8), np.uint64)
        for row, p in zip(words, payloads):
            row[:len(p)] = p
        ids, _ = _in_lockstep([heads[k][0] for k in some], words, None)
        for col, k in enumerate(some):
            out[k] = ids[:heads[k][0], col].astype(np.uint32)
            if zlib.crc32(out[k].astype("<u4").tobytes()) != heads[k][1]:
                raise ValueError("a block's checksum does not match")
    return out
