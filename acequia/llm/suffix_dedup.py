"""Removal of long repeated strings by suffix arrays.

A byte goes if a string of ``length`` bytes covers it that also starts earlier. Every
string of that length has an anchor, the lowest of its grams' hashes, so equal strings
have equal anchors. Neighbouring strings with one anchor form a stretch. Three steps
decide all strings:

1. Equal stretches: all but the first are repeats as a whole. They are found while the
   stretches of an anchor are sorted side by side, after each task has merged its own.
2. Different stretches that share an anchor may still share strings. They go to shards,
   each small enough for one task. A shard sorts the suffixes of its stretches by
   Larsson and Sadakane's doubling of sorted prefixes, takes common prefixes of
   neighbours as Kasai does, and so finds the first of each group of equal strings.
3. Stretches of an anchor with too many of them are dealt over all shards. Their
   strings, sorted in each shard, are merged across shards by binary search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from acequia.llm.shared import numbered, saved
from acequia.llm.words import Prefix, byte_values, mix, slices

#: Bytes of stretches in a shard.
SHARD = 3 << 20
#: Strings in a group of the merge across shards.
GROUP = 40_000
#: More stretches of one anchor than this are dealt over all shards.
MANY = 5_000
#: An anchor with more stretches than this in one batch is dealt over several tasks at once.
MANY_HERE, SALTS = 200, 64
#: A longer text is taken in pieces of about this many bytes that overlap by a string less one byte.
PIECE = 4 << 20

_MARK = -(1 << 63)
#: A stretch's number of starts, below ``length``, is packed into 14 bits.
LONGEST = 1 << 14
_WHOLE, _OPEN, _SPLIT, _LOCAL = 0, 1, 2, 3


def _pieces(s, length: int):
    if len(s.buf) <= PIECE or s.n > 1:
        yield s.buf, s.at, 0
        return
    for at in range(0, len(s.buf) - length + 1, PIECE):
        part = s.buf[at : at + PIECE + length - 1]
        yield part, np.array([0, len(part)]), at


def stretches(buf: np.ndarray, at: np.ndarray, length: int):
    """Stretches of some texts: (text, first start, number of starts, anchor hash, content hash).
    Starts count from the beginning of the text."""
    n, gram = len(buf), max(1, length // 4)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    prefix = Prefix(byte_values(buf))
    grams = mix((prefix.sums[gram:] - prefix.sums[:-gram]) * prefix.back[: n - gram + 1])
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    wide, window = 1, length - gram + 1
    while 2 * wide <= window:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    if window > wide:
        low = np.minimum(low[: len(low) - (window - wide)], low[window - wide :])
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.arange(len(anchor))
    inside = np.repeat(at[1:], np.diff(at))[: len(anchor)] - starts >= length
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    end = inside.copy()
    end[:-1] &= ~inside[1:] | (anchor[1:] != anchor[:-1])
    p0, p1 = np.flatnonzero(begin), np.flatnonzero(end)
    doc = np.searchsorted(at, p0, "right") - 1
    return doc, p0 - at[doc], p1 - p0 + 1, grams[anchor[p0]], prefix.of(p0, p1 + length)


def _pack(pos, count, kind):
    return (pos.astype(np.int64) << 16) | (count.astype(np.int64) << 2) | kind


def _stretch_rows(length: int):
    def run(batches):
        for batch in batches:
            ids, found = batch.column("own").to_numpy(), []
            for s in slices(batch.column("text")):
                for buf, at, base in _pieces(s, length):
                    doc, pos, count, anchor, content = stretches(buf, at, length)
                    found.append((anchor.view(np.int64), content.view(np.int64), ids[s.rows[0] + doc], pos + base, count))
            if not found:
                continue
            anchor, content, doc, pos, count = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((pos, doc, content, anchor))
            anchor, content, doc, pos, count = (x[order] for x in (anchor, content, doc, pos, count))
            new = np.ones(len(anchor), bool)
            new[1:] = anchor[1:] != anchor[:-1]
            group = np.cumsum(new) - 1
            first = new.copy()
            first[1:] |= content[1:] != content[:-1]
            # Repeats within the batch are settled; they need no company further on.
            own = np.flatnonzero(first)[np.cumsum(first) - 1] if len(first) else np.zeros(0, np.int64)
            repeat = ~first & ((doc != doc[own]) | (pos != pos[own]))
            hot = np.bincount(group[first], minlength=group[-1] + 1 if len(group) else 0) > MANY_HERE
            mine = hot[group] & first
            salt = content.view(np.uint64) % np.uint64(SALTS) + np.uint64(1)
            place = np.where(mine, mix(anchor.view(np.uint64) + mix(salt)).view(np.int64), anchor)
            place = np.where(repeat, mix(doc.view(np.uint64)).view(np.int64), place)
            kind = np.where(repeat, _LOCAL, np.where(mine, _SPLIT, _WHOLE))
            use = first | repeat
            marks = anchor[new & hot[group]]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([place[use], marks])),
                pa.array(np.concatenate([np.where(repeat, _MARK, content)[use], np.full(len(marks), _MARK)])),
                pa.array(np.concatenate([doc[use], np.zeros(len(marks), np.int64)])),
                pa.array(np.concatenate([_pack(pos, count, kind)[use], np.zeros(len(marks), np.int64)])),
            ], ["place", "content", "doc", "packed"])
    return run


def _settle(batches):
    """Rows sorted by place, content, doc and packed. Repeats as a whole, and stretches that share
    their place with others; the first stretch of a place waits until there is another."""
    place = content = doc = start = None  # of the last row, and where its content first was
    shared = split = False
    held = None

    def rows(d, p, where, kind):
        return pa.RecordBatch.from_arrays([
            pa.array(d), pa.array(p >> 16), pa.array((p >> 2) & 0x3FFF), pa.array(where), pa.array(kind)],
            ["doc", "pos", "count", "place", "kind"])

    for batch in batches:
        w, c, d, p = (batch.column(i).to_numpy() for i in range(4))
        if not len(w):
            continue
        local = (p & 3) == _LOCAL
        if local.any():
            yield rows(d[local], p[local], w[local], np.full(local.sum(), _WHOLE, np.int64))
            w, c, d, p = w[~local], c[~local], d[~local], p[~local]
            if not len(w):
                continue
        new_place = np.ones(len(w), bool)
        new_place[1:] = w[1:] != w[:-1]
        new_place[0] = place is None or w[0] != place
        new = new_place.copy()
        new[1:] |= c[1:] != c[:-1]
        new[0] = new_place[0] or c[0] != content
        mark = (c == _MARK) & (p == 0)
        # Repeats: same place and content as the row before, but not the same spot.
        at = np.maximum.accumulate(np.where(new, np.arange(len(w)), -1))
        first_doc = np.where(at >= 0, d[np.maximum(at, 0)], doc if doc is not None else 0)
        first_pos = np.where(at >= 0, p[np.maximum(at, 0)] >> 16, start if start is not None else 0)
        repeat = ~new & ~mark & ((d != first_doc) | ((p >> 16) != first_pos))
        yield rows(d[repeat], p[repeat], w[repeat], np.full(repeat.sum(), _WHOLE, np.int64))
        # Shared places: more than one content, a mark, or a place that is dealt over tasks.
        group = np.cumsum(new_place) - (1 if new_place[0] else 0)  # group 0 goes on from the last batch
        if new_place[0]:
            group, carried = group + 1, False
        else:
            carried = True
        n = group[-1] + 1
        contents = np.bincount(group[new & ~mark], minlength=n)
        salted = np.bincount(group[(p & 3) == _SPLIT], minlength=n) > 0
        marked = np.bincount(group[mark], minlength=n) > 0
        is_split = salted | marked
        is_shared = is_split | (contents > 1)
        if carried:
            is_split[0] |= split
            is_shared[0] |= shared | (held is not None and contents[0] > 0)
        if held is not None:
            if carried and is_shared[0]:
                yield rows(*held[:3], np.array([_SPLIT if is_split[0] else _OPEN]))
                held = None
            elif not carried or n > 1:
                held = None
        out = new & ~mark & is_shared[group]
        yield rows(d[out], p[out], w[out], np.where(is_split[group[out]], _SPLIT, _OPEN).astype(np.int64))
        last = int(group[-1])
        if not is_shared[last] and (k := np.flatnonzero(new & ~mark & (group == last))).size:
            held = (d[k[-1:]], p[k[-1:]], w[k[-1:]])
        place, content, doc, start = w[-1], c[-1], first_doc[-1], first_pos[-1]
        shared, split = bool(is_shared[last]), bool(is_split[last])


def suffix_array(words: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of several strings in one buffer in the order of their first ``depth`` bytes or more.
    ``words``: the eight bytes at each place; ``end``: where its string ends."""
    n = len(words)
    sa = np.argsort(words, kind="stable")
    new = np.ones(n, bool)
    new[1:] = words[sa[1:]] != words[sa[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1]
    step = 8
    while step < depth:
        # Only groups that are still tied take part.
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        at = sa[slots]
        ahead = at + step
        inside = ahead < end[at]
        follow = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | follow.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[slots] = at
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        new[slots] = first
        rank[at] = slots[first][np.cumsum(first) - 1]
        step *= 2
    return sa


def _common(words, x, y, h, most):
    """Length of the common prefix at places x and y, known to be ``h`` at least, up to ``most``."""
    h = np.minimum(h, most)
    todo = np.flatnonzero(h < most)
    while len(todo):
        differ = words[x[todo] + h[todo]] ^ words[y[todo] + h[todo]]
        equal = sum((differ < np.uint64(1 << b)).astype(np.int64) for b in (56, 48, 40, 32, 24, 16, 8)) + (differ == 0)
        h[todo] = np.minimum(h[todo] + equal, most[todo])
        todo = todo[(equal == 8) & (h[todo] < most[todo])]
    return h


def common_prefixes(words, sa, end, string, most: int) -> np.ndarray:
    """Common prefix of each suffix in ``sa`` with the one before it, up to ``most`` bytes. As Kasai
    found, it shrinks by one at most from a place to the next in the same string, so what is known
    at every 16th place is a lower bound for those after it."""
    n = len(sa)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[:1]] = sa[:1]
    place = np.arange(n)
    limit = np.minimum(np.minimum(end - place, end[before] - before), most)
    h = np.zeros(n, np.int64)
    probe = np.flatnonzero(place % 16 == 0)
    h[probe] = _common(words, probe, before[probe], h[probe], limit[probe])
    reach = string * np.int64(n + most + 1)
    bound = np.maximum.accumulate(h + place + reach) - place - reach
    h = _common(words, place, before, np.maximum(bound, 0), limit)
    out = h[sa]
    out[:1] = 0
    return out


def _shard(length: int, groups: int):
    def run(table: pa.Table) -> pa.Table:
        (s,) = slices(table.column("bytes"), 1 << 62)
        buf, at = s.buf, s.at
        doc, pos, count, kind = (table.column(c).to_numpy() for c in ("doc", "pos", "count", "kind"))
        string = np.repeat(np.arange(len(doc)), np.diff(at))
        end = at[1:][string]
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        words = np.zeros(len(buf), np.uint64)
        place = np.arange(len(buf))
        for i in range(8):
            words |= np.where(place + i < end, padded[i : i + len(buf)], 0).astype(np.uint64) << np.uint64(56 - 8 * i)
        sa = suffix_array(words, end, length)
        same = common_prefixes(words, sa, end, string, length) >= length
        owned = place - at[string] < count[string]
        group = np.cumsum(~same)
        keep = owned[sa]
        sa, group = sa[keep], group[keep]
        new = np.ones(len(sa), bool)
        new[1:] = group[1:] != group[:-1]
        own = string[sa]
        rank = np.unique(doc, return_inverse=True)[1]
        spot = (rank[own].astype(np.int64) << 40) | (pos[own] + sa - at[own])
        first = np.minimum.reduceat(spot, np.flatnonzero(new))[np.cumsum(new) - 1]
        flagged = np.zeros(len(buf), bool)
        flagged[sa[spot > first]] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], flagged.astype(np.int8), [0]])))
        lo, hi = edge[::2], edge[1::2]
        # Runs may go on into the next stretch: cut them at its start.
        cut = np.union1d(lo, at[:-1][flagged[np.minimum(at[:-1], max(len(flagged) - 1, 0))]])
        hi = np.minimum(hi[np.searchsorted(hi, cut, "right")], end[cut]) if len(cut) else cut
        owner = string[cut]
        runs = (doc[owner], pos[owner] + cut - at[owner], hi - cut)
        # The first of each group of strings that other shards may hold as well.
        open_ = np.flatnonzero((spot == first) & (kind[own] == _SPLIT))
        open_ = open_[np.unique(spot[open_], return_index=True)[1]] if len(open_) else open_
        open_ = np.sort(open_)
        x = sa[open_]
        strings = [buf[i : i + length].tobytes() for i in x]
        hashes = np.zeros(len(x), np.int64)
        if len(x):
            hashes = (Prefix(byte_values(buf)).of(x, x + length) % np.uint64(groups)).astype(np.int64)
        nothing = pa.nulls(len(cut), pa.binary())
        return pa.table({
            "doc": pa.array(np.concatenate([runs[0], doc[own[open_]]])),
            "pos": pa.array(np.concatenate([runs[1], pos[own[open_]] + x - at[own[open_]]])),
            "count": pa.array(np.concatenate([runs[2], np.ones(len(x), np.int64)])),
            "string": pa.concat_arrays([nothing, pa.array(strings, pa.binary())]),
            "part": pa.array(np.concatenate([np.zeros(len(cut), np.int64), hashes])),
            "shard": pa.array(np.full(len(cut) + len(x), table.column("shard")[0].as_py(), np.int64)),
        })
    return run


def _merge(table: pa.Table) -> pa.Table:
    """Strings of all shards in one part: runs are merged in pairs by binary search, and of equal
    strings the later ones are found."""
    table = table.sort_by([("shard", "ascending"), ("string", "ascending")])
    size = len(table.column("string")[0].as_py())
    keys = np.frombuffer(b"".join(table.column("string").to_pylist()), f"V{size}")
    order = np.array([k.tobytes() for k in keys], dtype=object)
    shard, doc, pos = (table.column(c).to_numpy() for c in ("shard", "doc", "pos"))
    cuts = np.flatnonzero(np.diff(shard)) + 1
    runs = [(order[r], r) for r in np.split(np.arange(len(order)), cuts)]
    later = []
    while len(runs) > 1:
        merged = []
        for (a, ra), (b, rb) in zip(runs[::2], runs[1::2], strict=False):
            at = np.searchsorted(a, b)
            hit = np.flatnonzero(a[np.minimum(at, len(a) - 1)] == b)
            x, y = ra[at[hit]], rb[hit]
            after = (doc[y] > doc[x]) | ((doc[y] == doc[x]) & (pos[y] > pos[x]))
            before = (doc[y] < doc[x]) | ((doc[y] == doc[x]) & (pos[y] < pos[x]))
            later.append(np.where(after, y, x)[after | before])
            ra = ra.copy()
            ra[at[hit[before]]] = y[before]
            rest = np.ones(len(b), bool)
            rest[hit] = False
            merged.append((np.insert(a, at[rest], b[rest]), np.insert(ra, at[rest], rb[rest])))
        runs = merged + runs[len(merged) * 2 :]
    rows = np.concatenate(later) if later else np.zeros(0, np.int64)
    return pa.table({"doc": pa.array(doc[rows]), "pos": pa.array(pos[rows]), "count": pa.array(np.ones(len(rows), np.int64))})


def _cut_out(batches):
    for batch in batches:
        for s in slices(batch.column("bytes")):
            lists_ = [batch.column(c).slice(s.rows[0], s.n).to_pylist() for c in ("pos", "count")]
            open_, length = lists_[0], s.buf
            texts, spans = [], []
            for i, (pos, stop) in enumerate(zip(open_, lists_[1], strict=True)):
                text = length[s.at[i] : s.at[i + 1]]
                if pos:
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, np.array(pos), 1)
                    np.add.at(edge, np.minimum(np.array(stop), len(text)), -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    flips = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(flips[::2], flips[1::2], strict=True)])
                    text = text[~gone]
                else:
                    spans.append([])
                texts.append(text.tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(s.rows[0], s.n),
                pa.array(np.diff(s.at)),
                pa.array(texts, pa.binary()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ], ["doc_id", "n_bytes", "kept", "spans"])


def _numbered_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``own`` and ``text`` of every row; ``own`` orders documents by doc_id, null last.

    It is the doc_id itself, unless some are null or repeated: then pairs of doc_id and text are
    numbered in order, so that different texts are different documents.
    """
    text = F.coalesce("text", F.lit(""))
    plain = docs.select("doc_id", F.col("doc_id").cast("long").alias("own"), text.alias("text"))
    again = plain.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    if again.isEmpty():
        return plain
    known = plain.withColumns({"print": F.xxhash64("text"), "bytes": F.octet_length("text")}).drop("own")
    pairs = saved(known.select("doc_id", "print", "bytes").distinct(), "documents")
    order = [F.col("doc_id").asc_nulls_last(), F.col("bytes"), F.col("print")]
    k, o = known.alias("k"), numbered(pairs, order, "own", "documents").alias("o")
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"o.{c}")) for c in pairs.columns]
    return saved(k.join(o, same).select("k.doc_id", "own", "text"), "documents", "zstd")


def suffix_dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts earlier.

    Earlier is a smaller ``doc_id`` or an earlier start in the same document; strings overlap as
    they like and are judged on the input; none crosses documents. Reads ``doc_id`` (whole numbers)
    and ``text`` as UTF-8 bytes, other columns are ignored. Returns one row per row of ``docs``:
    ``doc_id``, ``n_bytes``, ``kept`` (the remaining bytes), ``spans`` (removed runs, start and end).
    A null text is empty, a null ``doc_id`` comes after all others. Rows that repeat a ``doc_id``, null
    included, with other texts are documents of their own, the shorter text first; equal rows are one
    document, so they are not each other's copies and lose the same bytes. A very long text is taken
    in overlapping pieces, so no string is missed. An empty table gives no rows. ``length`` is
    below ``LONGEST``.
    """
    if not 0 < length < LONGEST:
        raise ValueError(f"length must be between 1 and {LONGEST - 1}")
    docs = _numbered_documents(docs)
    rows = docs.select("own", "text").mapInArrow(
        _stretch_rows(length), "place long, content long, doc long, packed long")
    rows = rows.repartition("place").sortWithinPartitions("place", "content", "doc", "packed")
    settled = saved(rows.mapInArrow(_settle, "doc long, pos long, count long, place long, kind long"), "stretches")
    repeats = settled.where(F.col("kind") == _WHOLE).select("doc", "pos", "count")

    open_ = settled.where(F.col("kind") != _WHOLE)
    n, size = open_.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("count") + length), F.lit(0))).first()
    if n:
        shards, groups = max(1, -(-size // SHARD)), max(1, -(-size // (GROUP * 4)))
        crowded = saved(open_.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY).select(
            "place", F.lit(True).alias("crowded")), "crowded")
        open_ = open_.join(crowded, "place", "left").withColumn(
            "kind", F.when(F.col("crowded"), F.lit(_SPLIT).cast("long")).otherwise(F.col("kind")))
        deal = F.when(F.col("kind") == _SPLIT, F.xxhash64("doc", "pos")).otherwise(F.xxhash64("place"))
        open_ = open_.select("doc", F.struct("pos", "count", "kind", F.pmod(deal, F.lit(shards)).alias("shard")).alias("s"))
        wanted = open_.groupBy("doc").agg(F.collect_list("s").alias("stretches")).hint("shuffle_hash")
        texts = docs.select(F.col("own").alias("doc"), F.col("text").cast("binary").alias("bytes")).join(wanted, "doc")

        def cut(batches):
            for batch in batches:
                texts = batch.column("bytes").to_pylist()
                for i, text in enumerate(texts):
                    s = batch.column("stretches").slice(i, 1).flatten()
                    pos, count, kind, shard = (s.field(k) for k in range(4))
                    parts = [text[p : p + c + length - 1] for p, c in zip(pos.to_pylist(), count.to_pylist(), strict=True)]
                    doc = pa.array(np.full(len(parts), batch.column("doc")[i].as_py(), np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [doc, pos, count, kind, shard, pa.array(parts, pa.binary())],
                        ["doc", "pos", "count", "kind", "shard", "bytes"])

        parts = texts.select("doc", "bytes", "stretches").mapInArrow(
            cut, "doc long, pos long, count long, kind long, shard long, bytes binary")
        sorted_ = saved(parts.groupBy("shard").applyInArrow(
            _shard(length, groups), "doc long, pos long, count long, string binary, part long, shard long"), "suffixes")
        runs = sorted_.where(F.col("string").isNull()).select("doc", "pos", "count")
        later = sorted_.where(F.col("string").isNotNull()).groupBy("part").applyInArrow(_merge, "doc long, pos long, count long")
        repeats = repeats.unionByName(runs).unionByName(later)

    found = repeats.groupBy(F.col("doc").alias("found")).agg(
        F.collect_list("pos").alias("pos"), F.collect_list(F.col("pos") + F.col("count") + (length - 1)).alias("count"))
    joined = docs.select("doc_id", "own", F.col("text").cast("binary").alias("bytes")).join(
        found.hint("shuffle_hash"), F.col("own") == F.col("found"), "left")
    kind = dict(docs.dtypes)["doc_id"]
    return joined.select("doc_id", "bytes", "pos", "count").mapInArrow(
        _cut_out, f"doc_id {kind}, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")
