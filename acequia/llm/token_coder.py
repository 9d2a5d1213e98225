"""Blocks of token ids under an adaptive context-mixing range coder.

A block holds whole documents' ids and is decoded on its own: its model starts afresh.
Its ids are dealt to lanes, consecutive stretches that advance side by side, one id a
step, so that numpy codes a whole step at once. All lanes share the model, which learns
from each step once it is coded:

* order 2 and order 1 predict the id that last followed the two ids or the id before,
  each with a confidence that grows when it is right;
* the mixer keeps, for each pair of confidences, how often order 2 was right, else
  order 1, else neither, and gives each its share of the range;
* order 0 codes the other ids by their frequency in the block so far.

Layout (little-endian): magic ``ACM1``; ids, lanes and alphabet as uint32; CRC-32 of the
ids as uint32 each; CRC-32 of what follows; 16-bit words of each lane as uint32; the
lanes' words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"ACM1"
_HEAD = "<4sIIIII"
_HEAD_SIZE = struct.calcsize(_HEAD)
# A word is written when the upper 16 bits of a lane's range are settled, or when the range
# falls below 2**44, which leaves room for both parts of a step (2**16 and up to 2**26).
_TOP, _BOTTOM, _MASK = np.uint64(1 << 48), np.uint64(1 << 44), np.uint64((1 << 44) - 1)
_W, _ONE = np.uint64(16), np.uint64(1)
_LANE, _OF_LANE = np.uint64(13), np.uint64((1 << 13) - 1)  # there are up to 2**13 lanes
_TABLE = 18
_STEP = 16
#: What a confidence of 0 to 7 changes by, if the predicted id did not follow, and if it did.
_STEPS = np.array([-1] * 8 + [1] * 7 + [0], np.int32)
#: Ids in a lane's stretch, and from so many ids of a block on. A step costs much the same for few lanes as for many, so
#: many short stretches take less time; what each lane adds to a block, and its first ids, take more room.
STRETCH, SHORT, LARGE = 256, 64, 1 << 18


class _Model:
    """What coder and decoder both know before a step; ``learn`` takes the step's ids."""

    def __init__(self, lanes: int, alphabet: int):
        self.alphabet = alphabet
        # Values that are used as indices are int64, which numpy takes as they are.
        self.one = np.zeros(lanes, np.int64)
        self.two = np.zeros(lanes, np.int64)
        # The id that followed each context, times eight, plus the confidence in it.
        self.after1, self.after2 = np.zeros(alphabet, np.int32), np.zeros(1 << _TABLE, np.int32)
        # Hits of order 2, of order 1 alone, and of neither, by confidences and agreement.
        self.hits = np.full((128, 3), 2, np.int64)
        self.hits[1::2, 1] = 0
        self.counts = np.ones(alphabet, np.int64)
        self.pending: list[np.ndarray] = []
        self.steps = 0
        self._sum()

    def _sum(self):
        if self.pending:
            self.counts += _STEP * np.bincount(np.concatenate(self.pending), minlength=self.alphabet)
            self.pending = []
        self.cumulative = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.uint64)
        self.total = self.cumulative[-1]

    def predict(self):
        """Predicted ids of order 2 and 1, and the ends of their parts of 0 .. 2**16."""
        self.at2 = ((self.two * 40503 + self.one * 30011) ^ (self.one >> 3)) & ((1 << _TABLE) - 1)
        self.e2, self.e1 = self.after2.take(self.at2), self.after1.take(self.one)
        self.p2, self.p1 = self.e2 >> 3, self.e1 >> 3
        self.sure2, self.sure1 = self.e2 & 7, self.e1 & 7
        self.row = ((self.sure2 << 4) | (self.sure1 << 1) | (self.p1 == self.p2)).astype(np.int64)
        share = self.hits * 32512 // self.hits.sum(axis=1, keepdims=True)  # 256 of 2**15 are left for all that is rare
        end2 = share[:, 0] + 64
        end1 = end2 + share[:, 1] + np.where(self.hits[:, 1] > 0, 64, 0)
        self.ends = np.zeros((128, 4), np.uint64)
        self.ends[:, 1], self.ends[:, 2], self.ends[:, 3] = end2 << 1, end1 << 1, 1 << 16
        return self.p2, self.p1, self.row

    def parts(self, outcome: np.ndarray):
        """Start and size of the part of each outcome (0: order 2, 1: order 1, 2: neither)."""
        at = self.row * 4 + outcome
        ends = self.ends.reshape(-1)
        start = ends.take(at)
        return start, ends.take(at + 1) - start

    def learn(self, ids: np.ndarray, outcome: np.ndarray):
        self.hits += np.bincount(self.row * 3 + outcome, minlength=384).reshape(128, 3)
        full = self.hits.sum(axis=1) > 1 << 20
        if full.any():
            self.hits[full] = (self.hits[full] + 1) >> 1
            self.hits[1::2, 1] = 0
        new = (ids << 3) | 1
        for table, at, entry, sure, right in ((self.after2, self.at2, self.e2, self.sure2, outcome == 0), (self.after1, self.one, self.e1, self.sure1, ids == self.p1)):
            after = entry + _STEPS.take(sure + (right << 3))
            np.copyto(after, new, where=~right & (sure <= 1))
            table[at] = after
        self.pending.append(ids[outcome == 2])
        self.two, self.one = self.one, ids.astype(np.int64)
        self.steps += 1
        if self.steps <= 8 or self.steps % 8 == 0:
            self._sum()


def _settle(low: np.ndarray, wide: np.ndarray, put) -> None:
    """Shift out settled words of all lanes; ``put`` takes the lanes of each round before they shift."""
    lanes, l, r = slice(None), low, wide
    while True:
        settled = (l ^ (l + r)) < _TOP
        narrow = ~settled & (r < _BOTTOM)
        if narrow.any():
            r = np.where(narrow, (~l + _ONE) & _MASK, r)
            wide[lanes] = r
        go = np.flatnonzero(settled | narrow)
        if not len(go):
            return
        lanes = go if isinstance(lanes, slice) else lanes[go]
        put(lanes)
        l, r = l[go] << _W, r[go] << _W
        low[lanes], wide[lanes] = l, r


def _shape(n: int) -> tuple[int, int]:
    lanes = int(min(8192, max(1, n // (STRETCH if n < LARGE else SHORT))))
    return lanes, -(-n // lanes)


def encode_block(ids: np.ndarray, alphabet: int) -> bytes:
    """Code one block of ids below ``alphabet``."""
    n = len(ids)
    lanes, steps = _shape(n)
    padded = np.zeros(lanes * steps, np.int32)
    padded[:n] = ids
    grid = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    model = _Model(lanes, alphabet)
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    words, used = np.zeros((lanes, 4 * steps + 8), np.uint16), np.zeros(lanes, np.int64)

    def put(lane):
        words[lane, used[lane]] = (low[lane] >> np.uint64(48)).astype(np.uint16)
        used[lane] += 1

    for now in grid:
        p2, p1, _ = model.predict()
        missed = now != p2
        outcome = missed + (missed & (now != p1)).astype(np.int64)
        start, size = model.parts(outcome)
        unit = wide >> _W
        low += start * unit
        wide = size * unit
        rest = np.flatnonzero(outcome == 2)
        if len(rest):
            x = now[rest]
            start = model.cumulative[x]
            unit = wide[rest] // model.total
            low[rest] += start * unit
            wide[rest] = (model.cumulative[x + 1] - start) * unit
        _settle(low, wide, put)
        model.learn(now, outcome)
    every = np.arange(lanes)
    for _ in range(4):
        put(every)
        low <<= _W
    mask = np.arange(words.shape[1]) < used[:, None]
    body = used.astype("<u4").tobytes() + words[mask].astype("<u2").tobytes()
    raw = zlib.crc32(np.asarray(ids).astype("<u4").tobytes())
    return struct.pack(_HEAD, MAGIC, n, lanes, alphabet, raw, zlib.crc32(body)) + body


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; raises ValueError if a checksum does not match."""
    magic, n, lanes, alphabet, raw, body = struct.unpack_from(_HEAD, block)
    if magic != MAGIC or lanes != _shape(n)[0] or zlib.crc32(block[_HEAD_SIZE:]) != body:
        raise ValueError("damaged block")
    steps = _shape(n)[1]
    used = np.frombuffer(block, "<u4", lanes, _HEAD_SIZE).astype(np.int64)
    words = np.frombuffer(block, "<u2", int(used.sum()), _HEAD_SIZE + 4 * lanes).astype(np.uint64)
    at = np.cumsum(used) - used
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    code = np.zeros(lanes, np.uint64)

    def take(lane):
        code[lane] = (code[lane] << _W) | words[at[lane]]
        at[lane] += 1

    for _ in range(4):
        take(np.arange(lanes))
    model, grid = _Model(lanes, alphabet), np.empty((steps, lanes), np.int32)
    for now in grid:
        p2, p1, row = model.predict()
        unit = wide >> _W
        value = (code - low) // unit
        outcome = (value >= model.ends[row, 1]).astype(np.int64) + (value >= model.ends[row, 2])
        start, size = model.parts(outcome)
        low += start * unit
        wide = size * unit
        now[:] = np.where(outcome == 0, p2, p1)
        rest = np.flatnonzero(outcome == 2)
        if len(rest):
            unit = wide[rest] // model.total
            value = np.minimum((code[rest] - low[rest]) // unit, model.total - _ONE)
            value = np.sort((value << _LANE) | np.arange(len(rest), dtype=np.uint64))  # a search is quicker in order
            order, x = (value & _OF_LANE).astype(np.int64), np.empty(len(rest), np.int64)
            x[order] = np.searchsorted(model.cumulative, value >> _LANE, "right") - 1
            start = model.cumulative[x]
            low[rest] += start * unit
            wide[rest] = (model.cumulative[x + 1] - start) * unit
            now[rest] = x
        _settle(low, wide, take)
        model.learn(now, outcome)
    ids = grid.T.reshape(-1)[:n].astype(np.int64)
    if zlib.crc32(ids.astype("<u4").tobytes()) != raw:
        raise ValueError("damaged block")
    return ids
