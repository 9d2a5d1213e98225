"""Words, lines and hashes of many texts at once, as numpy arrays over one byte buffer.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. Hashes are polynomial
in the bytes, taken from prefix sums modulo 2**64 and then mixed, so the hash of any
stretch costs two lookups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all of them."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; those that a usual slice needs are kept."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, SLICE + SLICE // 4), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if len(known) <= 2 * SLICE:
            _powers[base] = known
    return known[:n]


def forget_powers() -> None:
    """Drop the powers that are kept; they are quickly made again."""
    _powers.clear()


class Prefix:
    """Prefix sums of ``values`` (uint64), from which stretches are hashed."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(_BASE, n)[:n], out=self.sums[1:])
        self.back = powers(_INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_values(buf: np.ndarray) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64))[buf]


class Slice:
    """Some texts in one buffer: ``at[i]:at[i + 1]`` are the bytes of text ``i``."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, rows: tuple[int, int]):
        self.buf, self.at, self.rows, self.n = buf, at, rows, len(at) - 1

    def lower(self) -> None:
        """Lower-case A-Z in place of the buffer."""
        self.buf = self.buf + (((self.buf >= 65) & (self.buf <= 90)) * np.uint8(32))

    def find_words(self) -> None:
        """Set ``starts``, ``ends`` and ``doc`` of all words, in order."""
        buf, n = self.buf, len(self.buf)
        inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
        first = np.zeros(n + 1, bool)
        first[self.at] = True  # a text begins here, so a word does not go on
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | first[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:n]
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(self.at, self.starts, "right") - 1

    def word_hashes(self) -> np.ndarray:
        return Prefix(byte_values(self.buf)).of(self.starts, self.ends)


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[Slice]:
    """The texts of a string column, null as empty, in slices of about ``limit`` bytes."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield Slice(buf[at[i] : at[j]], at[i : j + 1] - at[i], (i, j))
        i = j


def windows(doc: np.ndarray, n: int) -> np.ndarray:
    """First words of all ``n``-word windows that stay in one text."""
    last = len(doc) - n + 1
    return np.flatnonzero(doc[: max(last, 0)] == doc[n - 1 :]) if last > 0 else np.zeros(0, np.int64)


def per_doc(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Number, or sum of ``weights``, for each text."""
    return np.bincount(doc, weights, n).astype(np.int64)


def lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    """A list column: the first ``counts[0]`` values are the first row's, and so on."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
