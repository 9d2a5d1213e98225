"""SentencePiece encoding as a max-plus scan, and decoding.

A text is cut into pieces of a public vocabulary so that the sum of their scores is
largest; a piece scores by its rank in the vocabulary file (whole numbers, so sums are
exact in any order). A space is written as a low line (U+2581), one is put before each
text, and characters without a piece are written as bytes, so decoding is exact.

A giant document is cut into chunks anywhere. What a chunk must know of its left
neighbour is by how many characters the neighbour's last piece reaches into it, and
this boundary state has as many values as a piece has characters. A chunk's transfer
matrix holds the best score from each state at its start to each at its end. Matrices
combine by max-plus products, which are associative: neighbours are combined in groups, the
products in groups again, and the best scores at each chunk's start follow downwards. With these, a
chunk knows for each state at its end from which state at its start the cut comes. These maps are
composed in the same tree from the right, and then every chunk is traced back on its own.

Of cuts with equal scores, the one with the longest last piece is taken, then that with the longest
before it, and so on. This rule holds across the edges of chunks, so ids do not depend on them.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from acequia.llm.shared import kept, lean, saved
from acequia.llm.words import Prefix, byte_values, mix, slices

#: Characters in a chunk; documents of more than two chunks are cut.
CHUNK = 1 << 14
SPACE = "▁"
#: Stands for a low line of the text itself, which must not turn into a space. No text holds it.
_OWN_LINE = "\udc81"
NEVER = -(1 << 50)
#: Bytes of text whose units are found at once.
AT_ONCE = 1 << 19
#: Units that a task remembers by hash.
REMEMBERED = 500_000
#: Chunks, or products of chunks, that one task combines at a time.
FAN = 64
#: Units up to so many characters are cut together, and so many characters at once.
SHORT, TOGETHER = 48, 200_000
_LINE, _OWN_BYTES = SPACE.encode(), b"\xff\x80\x80"


_SLOT_BITS, _BEGUN_BITS = 18, 20


@dataclass
class Vocabulary:
    scores: dict[str, int]
    ids: dict[str, int]
    longest: int
    byte_ids: list[int]
    byte_score: int
    output: list[bytes]
    #: Lengths of the pieces that have each beginning of three characters.
    lengths: dict[str, tuple[int, ...]]
    #: Pieces by the hash of their bytes: table of places, then hash, score and id of each place.
    slots: np.ndarray
    hashes: np.ndarray
    by_place: np.ndarray
    id_by_place: np.ndarray
    #: Whether a piece may go on after the characters with a hash, by the hash's first bits.
    begun: np.ndarray

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place of the piece with each hash, -1 where there is none."""
        at = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        found = self.slots[at]
        open_ = np.flatnonzero((found >= 0) & (self.hashes[found] != hashes))
        while len(open_):  # slots that another piece took: look in the next one
            at[open_] = (at[open_] + 1) & ((1 << _SLOT_BITS) - 1)
            found[open_] = self.slots[at[open_]]
            open_ = open_[(found[open_] >= 0) & (self.hashes[found[open_]] != hashes[open_])]
        return found


def vocabulary(path: str) -> Vocabulary:
    """Pieces of a SentencePiece model file with scores from their ranks: -1000 * ln(rank + 2)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores, ids, byte_ids, output = {}, {}, [0] * 256, []
    size = model.get_piece_size()
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            output.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            output.append(b"")
        else:
            ids[piece] = i
            scores[piece] = -round(1000 * math.log(min(-model.get_score(i), size) + 2))
            output.append(piece.replace(SPACE, " ").encode())
    lengths: dict[str, set[int]] = {}
    for piece in ids:
        if len(piece) > 2:
            lengths.setdefault(piece[:3], set()).add(len(piece))
    return Vocabulary(
        scores, ids, max(map(len, ids)), byte_ids, -round(1000 * (math.log(size) + 5)), output,
        {k: tuple(sorted(n)) for k, n in lengths.items()}, *(np.zeros(0, np.int64),) * 5)


def with_places(v: Vocabulary) -> Vocabulary:
    """Fill the table of pieces by hash. Only tasks need it, and the driver should not keep the powers
    that hashing takes, which would go along with every function that it sends."""
    pieces = list(v.ids)
    raw = [p.encode() for p in pieces]
    ends = np.cumsum([len(x) for x in raw])
    v.hashes = Prefix(byte_values(np.frombuffer(b"".join(raw), np.uint8))).of(ends - [len(x) for x in raw], ends)
    v.by_place = np.array([v.scores[p] for p in pieces], np.int64)
    v.id_by_place = np.array([v.ids[p] for p in pieces], np.int64)
    v.slots = np.full(1 << _SLOT_BITS, -1, np.int64)
    for place, h in enumerate(v.hashes.tolist()):
        at = h >> (64 - _SLOT_BITS)
        while v.slots[at] >= 0:
            at = (at + 1) & ((1 << _SLOT_BITS) - 1)
        v.slots[at] = place
    begun = [x.encode() for x in sorted({p[:i] for p in pieces for i in range(1, len(p))})]
    ends = np.cumsum([len(x) for x in begun])
    hashes = Prefix(byte_values(np.frombuffer(b"".join(begun), np.uint8))).of(ends - [len(x) for x in begun], ends)
    v.begun = np.zeros(1 << _BEGUN_BITS, bool)
    v.begun[hashes >> np.uint64(64 - _BEGUN_BITS)] = True
    return v


def prepared(text: str | None) -> str:
    """What is cut: nothing of an empty text, else the text with a space in front."""
    return f" {text}" if text else ""


def marked(text: str) -> str:
    """Spaces as low lines, character for character."""
    return text.replace(SPACE, _OWN_LINE).replace(" ", SPACE)


def _plain_bytes(c: str) -> bytes:
    return (SPACE if c == _OWN_LINE else c).encode()


def _single(v: Vocabulary, c: str) -> int:
    found = v.scores.get(c)
    return found if found is not None else v.byte_score * len(_plain_bytes(c))


def _ids(v: Vocabulary, piece: str) -> list[int]:
    found = v.ids.get(piece)
    return [found] if found is not None else [v.byte_ids[b] for b in _plain_bytes(piece)]


def best_cut(v: Vocabulary, text: str) -> tuple[int, list[str]]:
    """Largest score of a cut of ``text`` and its pieces."""
    n, scores, lengths = len(text), v.scores.get, v.lengths.get
    best, back = [NEVER] * (n + 1), [0] * (n + 1)
    best[0] = 0
    for i in range(n):
        base, found = best[i], scores(text[i])
        total = base + (v.byte_score * len(_plain_bytes(text[i])) if found is None else found)
        if total > best[i + 1]:
            best[i + 1], back[i + 1] = total, i
        found = scores(text[i : i + 2]) if i + 2 <= n else None
        if found is not None and base + found > best[i + 2]:
            best[i + 2], back[i + 2] = base + found, i
        for length in lengths(text[i : i + 3], ()):
            j = i + length
            if j > n:
                break
            found = scores(text[i:j])
            if found is not None and base + found > best[j]:
                best[j], back[j] = base + found, i
    pieces, j = [], n
    while j:
        pieces.append(text[back[j] : j])
        j = back[j]
    return best[n], pieces[::-1]


def best_cuts(v: Vocabulary, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, numbers of ids and all ids of units given as marked bytes, cut together: one step of all
    units at a time, with the rule of ``best_cut`` for equal scores."""
    return _cuts(v, np.frombuffer(b"".join(units), np.uint8), np.fromiter(map(len, units), np.int64, len(units)))


def _cuts(v: Vocabulary, buf: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best_cuts`` of units that follow each other in ``buf``, each of so many bytes."""
    m, char_at = len(sizes), np.flatnonzero((buf & 0xC0) != 0x80)
    n = len(char_at)
    bounds = np.append(char_at, len(buf))
    end = np.searchsorted(char_at, np.cumsum(sizes))
    first = np.append(0, end[:-1])
    size = end - first
    unit = np.repeat(np.arange(m), size)
    prefix = Prefix(byte_values(buf))

    # All pieces in the units: where each begins, its length, place and score. A character goes on being
    # looked at only while pieces begin like this.
    begin, length, place = [], [], []
    at = np.arange(n)
    for k in range(1, min(v.longest, int(size.max())) + 1):
        at = at[at + k <= end[unit[at]]]
        hashes = prefix.of(bounds[at], bounds[at + k])
        found = v.places(hashes)
        here = np.flatnonzero((found >= 0) | (k == 1))  # a character alone is a piece, or bytes
        begin.append(at[here])
        length.append(np.full(len(here), k))
        place.append(found[here])
        at = at[v.begun[hashes >> np.uint64(64 - _BEGUN_BITS)]]
    begin, length, place = np.concatenate(begin), np.concatenate(length), np.concatenate(place)
    step = (begin - first[unit[begin]]).astype(np.uint16)
    order = np.argsort(step, kind="stable")
    begin, length, place = begin[order], length[order], place[order]
    edge = np.searchsorted(step[order], np.arange(int(size.max()) + 1))
    score = np.where(place >= 0, v.by_place[place], v.byte_score * (bounds[begin + 1] - bounds[begin]))

    # Places of a unit are its characters and its end, one more than it has characters. One step goes on
    # from the same character of all units; its pieces end at different places.
    base = first + np.arange(m)
    best, back = np.full(n + m, NEVER, np.int64), np.zeros(n + m, np.int64)
    best[base] = 0
    source = begin + unit[begin]
    target = source + length
    for a, b in zip(edge.tolist(), edge[1:].tolist()):
        total, to = best[source[a:b]] + score[a:b], target[a:b]
        better = np.flatnonzero(total > best[to])
        to = to[better]
        best[to], back[to] = total[better], a + better
    scores = best[base + size]

    taken = np.full(n, -1, np.int64)  # the piece of the cut that begins at a character
    at = base + size
    while len(at):
        piece = back[at]
        taken[begin[piece]] = piece
        at = source[piece]
        at = at[begin[piece] > first[unit[begin[piece]]]]
    begins = np.flatnonzero(taken >= 0)
    known = place[taken[begins]]
    wide = np.where(known >= 0, 1, bounds[begins + 1] - bounds[begins])
    where = np.cumsum(wide) - wide
    ids = np.zeros(int(wide.sum()), np.uint32)
    ids[where[known >= 0]] = v.id_by_place[known[known >= 0]]
    for i in np.flatnonzero(known < 0):
        raw = buf[bounds[begins[i]] : bounds[begins[i] + 1]].tobytes()
        ids[where[i] : where[i] + wide[i]] = [v.byte_ids[b] for b in (_LINE if raw == _OWN_BYTES else raw)]
    return scores, np.bincount(unit[begins], wide, m).astype(np.int64), ids


def _gathered(buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of a buffer, one after the other."""
    ends = np.cumsum(size)
    return buf[np.repeat(first - (ends - size), size) + np.arange(int(size.sum()))]


class SliceEncoder:
    """Encodes the texts of a slice together, unit by unit (spaces and what follows up to the next); units
    are found and known by hash, and every one that is not yet known is cut once."""

    def __init__(self, path: str):
        self.v = with_places(vocabulary(path))
        self._forget()

    def _forget(self):
        self.hashes = np.zeros(0, np.uint64)
        self.start, self.size, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, raw: np.ndarray, sizes: np.ndarray) -> None:
        """Cut new units, given as plain bytes one after the other, in ascending order of their hashes."""
        ends = np.cumsum(sizes)
        spaces = np.add.reduceat((raw == 32).astype(np.int64), ends - sizes)
        wide = sizes + (len(_LINE) - 1) * spaces  # bytes of each unit once it is marked
        buf = np.frombuffer(raw.tobytes().replace(_LINE, _OWN_BYTES).replace(b" ", _LINE), np.uint8)
        begins = np.cumsum(wide) - wide
        score, size, start = (np.zeros(len(sizes), np.int64) for _ in range(3))
        flat, used = [self.flat], len(self.flat)
        short = np.flatnonzero(wide <= SHORT)
        lots = (np.cumsum(wide[short]) - 1) // TOGETHER
        for lot in np.split(short, np.flatnonzero(np.diff(lots)) + 1) if len(short) else []:
            score[lot], size[lot], ids = _cuts(self.v, _gathered(buf, begins[lot], wide[lot]), wide[lot])
            start[lot] = used + np.cumsum(size[lot]) - size[lot]
            flat.append(ids)
            used += len(ids)
        for i in np.flatnonzero(wide > SHORT).tolist():
            score[i], pieces = best_cut(self.v, marked(raw[ends[i] - sizes[i] : ends[i]].tobytes().decode()))
            ids = np.array([x for p in pieces for x in _ids(self.v, p)], np.uint32)
            start[i], size[i] = used, len(ids)
            flat.append(ids)
            used += len(ids)
        self.flat = np.concatenate(flat)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.start, self.size, self.score = (np.insert(a, at, b) for a, b in (
            (self.hashes, hashes), (self.start, start), (self.size, size), (self.score, score)))

    def encode_slice(self, s, in_front: bool = True) -> tuple[list[bytes], np.ndarray]:
        """Ids (as bytes) and score of each text, which has a space put in front unless it is the
        middle of one."""
        buf, n = s.buf, len(s.buf)
        begins = np.zeros(n + 1, bool)
        begins[1:n] = (buf[1:] == 32) & (buf[:-1] != 32)
        heads = s.at[:-1][np.diff(s.at) > 0]
        begins[heads] = True
        first = np.flatnonzero(begins[:n])
        last = np.append(first[1:], n) if len(first) else first
        lead = np.zeros(n + 1, bool)
        lead[heads] = in_front
        lead = lead[first]  # a text's first unit has the space that is put before it
        doc = np.searchsorted(s.at, first, "right") - 1
        hashes = Prefix(byte_values(buf)).of(first, last)
        hashes = np.where(lead, mix(hashes + np.uint64(0x2545F4914F6CDD1D)), hashes)
        kinds, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED:
            self._forget()
        known = np.zeros(len(kinds), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(np.searchsorted(self.hashes, kinds), len(self.hashes) - 1)] == kinds
        if not known.all():
            new = one[~known]
            own, sizes = (last - first)[new], (last - first)[new] + lead[new]
            raw = np.full(int(sizes.sum()), 32, np.uint8)  # the space in front, where a unit has one
            inner = np.ones(len(raw), bool)
            inner[(np.cumsum(sizes) - sizes)[lead[new]]] = False
            raw[inner] = _gathered(buf, first[new], own)
            self._learn(kinds[~known], raw, sizes)
        found = np.searchsorted(self.hashes, kinds)[inverse]
        size = self.size[found]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[found] - (ends - size), size) + np.arange(int(size.sum()))].astype("<u4").tobytes()
        stop = np.cumsum(np.bincount(doc, size, s.n)).astype(np.int64) * 4
        texts = [ids[a:b] for a, b in zip(np.append(0, stop[:-1]).tolist(), stop.tolist(), strict=True)]
        return texts, np.bincount(doc, self.score[found], s.n).astype(np.int64)

    def encode(self, text: str) -> tuple[int, np.ndarray]:
        """Score and ids of marked text between two places where a unit begins."""
        if not text:
            return 0, np.zeros(0, np.uint32)
        (s,) = slices(pa.array([text.replace(SPACE, " ").replace(_OWN_LINE, SPACE)]))
        (ids,), (score,) = self.encode_slice(s, in_front=False)
        return int(score), np.frombuffer(ids, "<u4")


@kept
def slice_encoder(path: str) -> SliceEncoder:
    """The worker's encoder, with what it remembers of earlier tasks of this module."""
    return SliceEncoder(path)


def _edges(text: str, size: int) -> tuple[int, int]:
    """Where the first whole unit of a chunk begins and the last one ends; the chunk is the first
    ``size`` characters of ``text``. The same place if there is no such unit."""
    cuts = [m.start() for m in re.finditer(f"(?<=[^{SPACE}]){SPACE}", text[:size])]
    return (cuts[0], cuts[-1]) if cuts else (size, size)


def _forward(v: Vocabulary, text: str, size: int, start: np.ndarray) -> np.ndarray:
    """Best scores at each place up to ``size`` + longest - 1 of ``text``, for each row of ``start``,
    which holds the scores at its first places. Pieces begin before ``size``."""
    best = np.full((size + v.longest, start.shape[1]), NEVER, np.int64)
    best[: len(start)] = start
    for i in range(size):
        base = best[i]
        for j in range(i + 1, min(i + v.longest, len(text)) + 1):
            score = _single(v, text[i]) if j == i + 1 else v.scores.get(text[i:j])
            if score is not None:
                np.maximum(best[j], base + score, out=best[j])
    return best


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of transfer matrices."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NEVER)


def transfer(encoder: SliceEncoder, text: str, size: int) -> np.ndarray:
    """Transfer matrix of a chunk: the first ``size`` characters of ``text``; what follows belongs to
    later chunks but may be in the chunk's last piece."""
    return transfer_and_middle(encoder, text, size)[0]


def transfer_and_middle(encoder: SliceEncoder, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The transfer matrix, and the ids from the first whole unit up to the last one, which are the same
    on every cut."""
    v, k = encoder.v, encoder.v.longest
    first, last = _edges(text, size)
    identity = np.where(np.eye(k, dtype=bool), 0, NEVER).astype(np.int64)
    if first == size:
        return _forward(v, text, size, identity)[size : size + k].T, np.zeros(0, np.uint32)
    # Up to the first whole unit from any state; it begins where a piece must.
    head = _forward(v, text[:first], first, identity)[first]
    middle, ids = encoder.encode(text[first:last])
    zero = np.full((1, 1), 0, np.int64)
    tail = _forward(v, text[last:], size - last, zero)[size - last : size - last + k, 0]
    return np.maximum(head[:, None] + middle + tail[None, :], NEVER), ids


def _traced(v: Vocabulary, text: str, start: np.ndarray, ends: list[int]) -> list[tuple[int, list[str]]]:
    """For each place in ``ends``: the state at the start of ``text`` from which the best cut up to there
    comes, and its pieces. ``start`` holds the best scores at the first places."""
    n, top = len(start), max(ends)
    best, back = [NEVER] * (top + 1), [0] * (top + 1)
    best[: min(n, top + 1)] = [int(x) for x in start[: top + 1]]
    # A place within the reach of the neighbour's last piece is reached by that piece or from before.
    for i in range(top):
        if best[i] <= NEVER // 2:
            continue
        for j in range(i + 1, min(i + v.longest, top) + 1):
            found = _single(v, text[i]) if j == i + 1 else v.scores.get(text[i:j])
            # The neighbour's piece began before the chunk: it is the longer one of equal cuts.
            if found is not None and best[i] + found > best[j]:
                best[j], back[j] = best[i] + found, j - i
    found = []
    for at in ends:
        pieces = []
        while back[at]:
            pieces.append(text[at - back[at] : at])
            at -= back[at]
        found.append((at, pieces[::-1]))
    return found


def back_map(v: Vocabulary, text: str, size: int, start: np.ndarray) -> list[int]:
    """For each state at a chunk's end, the state at its start from which the best cut comes."""
    k = v.longest
    first, _ = _edges(text, size)
    if first < size:  # a piece must begin there, whatever the end
        return [_traced(v, text[:first], start, [first])[0][0]] * k
    ends = [size + s for s in range(k) if size + s <= len(text)]
    return ([at for at, _ in _traced(v, text, start, ends)] + [0] * k)[:k]


def trace(v: Vocabulary, text: str, size: int, start: np.ndarray, leave: int, middle: np.ndarray) -> np.ndarray:
    """Ids of the pieces that begin in a chunk, on the best cut that ends it in state ``leave``; ``middle``
    are those of its whole units."""
    first, last = _edges(text, size)

    def ids(pieces: list[str]) -> np.ndarray:
        return np.array([i for p in pieces for i in _ids(v, p)], np.uint32)
    if first == size:
        return ids(_traced(v, text, start, [size + leave])[0][1])
    head = _traced(v, text[:first], start, [first])[0][1]
    return np.concatenate([ids(head), middle, ids(best_cut(v, text[last : size + leave])[1])])


# -- Scans over the chunks of a document ------------------------------------------------


def _matrix_product(matrices: list[bytes]) -> bytes:
    found = None
    for raw in matrices:
        m = np.frombuffer(raw, np.int64)
        m = m.reshape(math.isqrt(len(m)), -1)
        found = m if found is None else product(found, m)
    return found.tobytes()


def _score_states(start: bytes, matrices: list[bytes]) -> list[bytes]:
    """Best scores at the start of each chunk, from those at the start of the first."""
    found = [start]
    for raw in matrices[:-1]:
        found.append(product(np.frombuffer(found[-1], np.int64)[None, :], np.frombuffer(raw, np.int64).reshape(-1, len(start) // 8))[0].tobytes())
    return found


def _map_product(maps: list[bytes]) -> bytes:
    found = None
    for raw in reversed(maps):
        m = np.frombuffer(raw, np.int64)
        found = m if found is None else m[found]
    return found.tobytes()


def _exit_states(leave: bytes, maps: list[bytes]) -> list[bytes]:
    """State at the end of each chunk, from that at the end of the last."""
    found = [leave]
    for raw in maps[:0:-1]:
        found.append(np.frombuffer(raw, np.int64)[np.frombuffer(found[-1], np.int64)].tobytes())
    return found[::-1]


def scanned(items: DataFrame, outside: bytes, combine, spread) -> DataFrame:
    """``row``, ``chunk`` and ``state`` for a table of (row, chunk, item).

    ``combine`` multiplies neighbouring items, which must be associative; ``spread`` gives the states of
    neighbours from the one outside them. Up to ``FAN`` neighbours meet in a task; their products are
    scanned first, in the same way, and hand the states down.
    """
    dealt = items.withColumn("lot", F.floor(F.col("chunk") / FAN).cast("long"))
    above = items.where(F.col("chunk") >= FAN).limit(1)
    if above.isEmpty():
        dealt = dealt.withColumn("outside", F.lit(outside))
    else:
        def product_of(table: pa.Table) -> pa.Table:
            table = table.sort_by("chunk")
            whole = combine(table.column("item").to_pylist())
            return pa.table({"row": table.column("row")[:1], "chunk": table.column("lot")[:1], "item": pa.array([whole], pa.binary())})
        upper = saved(dealt.groupBy("row", "lot").applyInArrow(product_of, "row long, chunk long, item binary"), "products")
        handed = scanned(upper, outside, combine, spread).select("row", F.col("chunk").alias("lot"), F.col("state").alias("outside"))
        dealt = dealt.join(handed, ["row", "lot"])

    def states(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        found = spread(table.column("outside")[0].as_py(), table.column("item").to_pylist())
        return pa.table({"row": table.column("row"), "chunk": table.column("chunk"), "state": pa.array(found, pa.binary())})
    return dealt.groupBy("row", "lot").applyInArrow(states, "row long, chunk long, state binary")


def _first_pass(path: str, chunk: int):
    def run(batches):
        encoder, row = slice_encoder(path), TaskContext.get().partitionId() << 33
        reach = encoder.v.longest - 1

        def table(names, at, rows, chunks, sizes, parts, ids, scores):
            return pa.RecordBatch.from_arrays([
                names.take(pa.array(at, pa.int64())), pa.array(rows, pa.int64()), pa.array(chunks, pa.int64()),
                pa.array(sizes, pa.int64()), pa.array(parts, pa.string()), pa.array(ids, pa.binary()), pa.array(scores, pa.int64()),
            ], ["doc_id", "row", "chunk", "size", "part", "ids", "score"])

        for batch in batches:
            names, texts = batch.column("doc_id"), batch.column("text")
            whole = np.asarray(pc.fill_null(pc.utf8_length(texts), 0)) + 1 <= 2 * chunk
            rows = row + np.arange(batch.num_rows)
            row += batch.num_rows
            at = np.flatnonzero(whole)
            for s in slices(texts.take(pa.array(at)), AT_ONCE):
                ids, scores = encoder.encode_slice(s)
                own = at[s.rows[0] : s.rows[1]]
                yield table(names, own, rows[own], np.zeros(s.n, np.int64), np.ones(s.n, np.int64), [None] * s.n, ids, scores)
            for i in np.flatnonzero(~whole):
                text = prepared(texts[i].as_py())
                starts = range(0, len(text), chunk)
                n = len(starts)
                yield table(names, [i] * n, [rows[i]] * n, list(range(n)), [min(chunk, len(text) - a) for a in starts],
                            [text[a : a + chunk + reach] for a in starts], [None] * n, [None] * n)
    return run


def encode_pieces(docs: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """Encode every text by the vocabulary of a SentencePiece model file that every executor has.

    Reads ``doc_id`` and ``text``; other columns are ignored. Returns one row per row of ``docs``:
    ``doc_id``, ``ids`` (unsigned 32-bit little-endian), ``score`` (thousandths), ``n_chunks``. A null
    or empty text has no ids and score 0; a very long one is cut in chunks of ``chunk`` characters, which
    does not change its ids. Repeated rows are encoded alike, an empty table gives no rows. Of cuts with
    equal scores the one with the longest last piece is taken, and so on backwards.
    """
    kind = dict(docs.dtypes)["doc_id"]
    first = saved(docs.select("doc_id", "text").mapInArrow(
        lean(_first_pass(model, chunk)), f"doc_id {kind}, row long, chunk long, size long, part string, ids binary, score long"),
        "pieces", "zstd")
    heads = first.where(F.col("chunk") == 0).select("doc_id", "row", "ids", "score")
    small = heads.where(F.col("ids").isNotNull()).select("doc_id", "ids", "score", F.lit(1).cast("long").alias("n_chunks"))
    giant = first.where(F.col("part").isNotNull()).select("row", "chunk", "size", "part")
    whole = _giant_documents(giant, model)
    large = heads.where(F.col("ids").isNull()).select("doc_id", "row").join(whole, "row").select("doc_id", F.col("joined").alias("ids"), "score", "n_chunks")
    return small.unionByName(large)


def _giant_documents(giant: DataFrame, model: str) -> DataFrame:
    """``row``, ``joined`` ids, ``score`` and ``n_chunks`` of documents in chunks (row, chunk, size, part)."""
    giant = giant.repartition("row", "chunk")

    def chunks(batch, *columns):
        """Values of each row, one row at a time: a batch may hold many parts."""
        for row in zip(*(batch.column(c) for c in columns), strict=True):
            yield (marked(x.as_py()) if c == "part" else x.as_py() for c, x in zip(columns, row, strict=True))

    def matrices(batches):
        encoder = slice_encoder(model)
        for batch in batches:
            found = [transfer_and_middle(encoder, t, n) for t, n in chunks(batch, "part", "size")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("chunk"), pa.array([m.tobytes() for m, _ in found], pa.binary()),
                 pa.array([ids.astype("<u4").tobytes() for _, ids in found], pa.binary())], ["row", "chunk", "item", "middle"])

    def maps(batches):
        v = slice_encoder(model).v
        for batch in batches:
            found = [np.array(back_map(v, t, n, np.frombuffer(x, np.int64)), np.int64).tobytes()
                     for t, n, x in chunks(batch, "part", "size", "state")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk"), pa.array(found, pa.binary())], ["row", "chunk", "item"])

    def traced(batches):
        v = slice_encoder(model).v
        for batch in batches:
            found = [trace(v, t, n, np.frombuffer(x, np.int64), int(np.frombuffer(y, np.int64)[0]), np.frombuffer(m, "<u4")).astype("<u4").tobytes()
                     for t, n, x, y, m in chunks(batch, "part", "size", "state", "leave", "middle")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk"), pa.array(found, pa.binary())], ["row", "chunk", "ids"])

    def totals(table: pa.Table) -> pa.Table:
        """Score of a document: that of its last chunk's start, carried to the end."""
        start, last = (table.column(c)[0].as_py() for c in ("state", "item"))
        k = len(start) // 8
        score = product(np.frombuffer(start, np.int64)[None, :], np.frombuffer(last, np.int64).reshape(k, k))[0, 0]
        return pa.table({"row": table.column("row"), "score": pa.array([int(score)], pa.int64()), "n_chunks": pa.array([table.column("chunk")[0].as_py() + 1], pa.int64())})

    def joined(batches):
        for batch in batches:
            ids = [b"".join(p["ids"] for p in sorted(parts, key=lambda p: p["chunk"])) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(ids, pa.large_binary()).cast(pa.binary())], ["row", "joined"])

    k = vocabulary(model).longest
    start = np.where(np.arange(k) == 0, 0, NEVER).astype(np.int64).tobytes()
    first = saved(giant.mapInArrow(lean(matrices), "row long, chunk long, item binary, middle binary"), "matrices", "zstd")
    items, middles = first.drop("middle"), first.drop("item")
    states = saved(scanned(items, start, _matrix_product, _score_states), "states")
    mapped = saved(giant.join(states, ["row", "chunk"]).select("row", "chunk", "part", "size", "state").mapInArrow(
        lean(maps), "row long, chunk long, item binary"), "maps")
    leaves = scanned(mapped, np.zeros(1, np.int64).tobytes(), _map_product, _exit_states).withColumnRenamed("state", "leave")
    parts = giant.join(states, ["row", "chunk"]).join(leaves, ["row", "chunk"]).join(middles, ["row", "chunk"]).select(
        "row", "chunk", "part", "size", "state", "leave", "middle").mapInArrow(lean(traced), "row long, chunk long, ids binary")
    ids = parts.groupBy("row").agg(F.collect_list(F.struct("chunk", "ids")).alias("parts")).mapInArrow(lean(joined), "row long, joined binary")
    last = items.groupBy("row").agg(F.max("chunk").alias("chunk"))
    scores = items.join(last, ["row", "chunk"]).join(states, ["row", "chunk"]).groupBy("row").applyInArrow(
        totals, "row long, score long, n_chunks long")
    return ids.join(scores, "row")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """Adds ``text``, decoded from ``ids``; without ids it is empty. Rows and their other columns stay, repeated
    ones too; an empty table gives no rows. Each text is decoded whole, however long."""

    def run(batches):
        output = np.array(slice_encoder(model).v.output, object)
        for batch in batches:
            texts = []
            for raw in batch.column("ids").to_pylist():
                texts.append(b"".join(output[np.frombuffer(raw or b"", "<u4")].tolist())[1:].decode())
            yield batch.append_column("text", pa.array(texts, pa.string()))

    fields = ", ".join(f"{n} {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(lean(run), f"{fields}, text string")
