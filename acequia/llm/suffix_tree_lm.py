"""Scores of texts under a probabilistic suffix tree that is trained on most of them.

Symbols are the words of the training texts. The tree's contexts are strings of up to
``depth`` words that occur ``least`` times or more, at every size of the input, and a
context stays in the tree only if what follows it diverges enough from what follows its
suffix. Next-word distributions are smoothed: each count gives up a discount, which goes
to the distribution of the suffix. A token is scored in the longest context of the tree
that ends before it.

All counts are over all training documents and are held as tables in
``spark.checkpoint.dir``. A string is counted only where both its parts, without its last
and without its first word, are frequent themselves (fixed bit fields rule out most
others). The logarithm of a document's probability is a sum over its words and strings,
so each of these has one value, which does not depend on where it occurs: documents look
values up by a join on strings. Strings that make up a larger share of the tokens than
``word_share`` or ``string_share`` are looked up in memory instead, which keeps hot keys
out of the join and changes no result; they are one of 1/share at most.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from acequia.llm.shared import dropped, lean, lean_groups, parts, saved, tidy
from acequia.llm.words import mix, slices

#: Hash of the token that ends each document.
END = 0x1F83D9ABFB41BD6B
DISCOUNT = 0.75
#: Bits of a field that tells which keys a table cannot hold, as a power of two.
FIELD = 27
#: Tokens for each bucket in which strings are summed and looked up.
BUCKET = 2_000_000
#: Ranges of buckets for which a part's strings are sorted, one range after the other: sorting takes several copies.
RANGES = 4
#: Bytes of text whose words are found at once: what is computed for them stays in a core's cache.
AT_ONCE = 1 << 19
#: Rows whose strings are gathered together; a place among them fits 16 bits.
PART = 3000
#: Answers to so many parts are summed at once.
ANSWERS = 100
#: Bits of the field in a task that tells most strings from those looked up in memory, as a power of two.
NEAR = 22
#: Values of the tree that are packed together before they move.
HELD = 500_000


@dataclass(frozen=True)
class Settings:
    #: Words and strings above these shares of the tokens are looked up in memory, others by a join.
    word_share: float = 2e-6
    string_share: float = 2e-6
    depth: int = 2
    #: Strings are counted from so many occurrences on.
    least: int = 2
    #: A context stays if its counts times the divergence from its suffix reach this (in nats).
    divergence: float = 10.0


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _tokens(batch):
    """Slices of a batch: (slice, text of each token, token hashes, whether each text is held out)."""
    out = np.array([held_out(x) for x in batch.column("doc_id").to_pylist()], bool)
    for s in slices(batch.column("text"), AT_ONCE):
        s.lower()
        s.find_words()
        at = np.searchsorted(s.doc, np.arange(s.n), "right")  # an end after each text's words
        doc = np.insert(s.doc, at, np.arange(s.n))
        yield s, doc, np.insert(s.word_hashes(), at, np.uint64(END)).view(np.int64), out[s.rows[0] : s.rows[1]]


def _count_words(batches):
    for batch in parts(batches, PART):
        found = [h[~out[doc]] for _, doc, h, out in _tokens(batch)]
        word, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n.astype(np.int64))], ["word", "n"])


def _sum_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum("n").alias("n"))


def _columns(df: DataFrame) -> list[np.ndarray]:
    """A small table as arrays on the driver; callers state why it is small."""
    with tidy(df.sparkSession):
        table = df.toArrow()
    return [c.to_numpy() for c in table.columns]


def _joined(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Id of a string from the ids of its parts: without its last word, and without its first."""
    return mix(mix(before + np.uint64(0x9E3779B97F4A7C15)) + after)


def _ending(h: np.ndarray, doc: np.ndarray, length: int):
    """For each length up to this one: ids of the string that ends at each token, whether the
    text has one, and the ids of its part without the last word."""
    ids, there = h.view(np.uint64), np.ones(len(h), bool)
    goes_on = np.concatenate([[False], doc[1:] == doc[:-1]]) if len(h) else there
    before = np.zeros(len(h), np.uint64)
    yield ids, there, before
    for _ in range(length - 1):
        before = np.concatenate([ids[:1], ids[:-1]])
        there = goes_on & np.concatenate([there[:1], there[:-1]])
        ids = _joined(before, ids)
        yield ids, there, before


def _field(keys: DataFrame, key: str) -> np.ndarray:
    """A bit field of fixed size in which the bit of each key is set."""
    bit = f"shiftrightunsigned({key}, {64 - FIELD})"
    filled = keys.selectExpr(f"shiftright({bit}, 6) AS at", f"shiftleft(1L, int({bit} & 63)) AS bits")
    at, bits = _columns(filled.groupBy("at").agg(F.bit_or("bits").alias("bits")))
    out = np.zeros(1 << (FIELD - 6), np.uint64)
    out[at] = bits.view(np.uint64)
    return out


def _may_hold(field: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys >> np.uint64(64 - FIELD)
    return (field[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins and ends in sorted ids; buckets are equal ranges of ids."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def _ranges(buckets: int) -> list[tuple[np.uint64, np.uint64]]:
    """First and last id of a few ranges of whole buckets, which hold all ids."""
    begin = [-((-((i * buckets // RANGES) << 32)) // buckets) << 32 for i in range(RANGES + 1)]
    return [(np.uint64(a), np.uint64(b - 1)) for a, b in zip(begin, begin[1:]) if a < b]


def _in_range(first: np.uint64, last: np.uint64, keys: list[np.ndarray], *others: list[np.ndarray]) -> list[np.ndarray]:
    """Of arrays side by side, what belongs to the ids in a range; one array of each list."""
    inside = [np.flatnonzero((k >= first) & (k <= last)) for k in keys]
    return [np.concatenate([x[i] for x, i in zip(column, inside, strict=True)]) for column in (keys, *others)]


def _buffer(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value of a binary column without nulls begins, and where the last ends; all their bytes."""
    column = pa.concat_arrays([pa.array([], pa.binary()), *column.chunks])
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _bytes(column: pa.ChunkedArray, kind) -> np.ndarray:
    at, data = _buffer(column)
    return data[at[0] : at[-1]].view(kind)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted ids as their differences, byte plane by byte plane: the upper planes are zeros, which compress."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    """Ids of all rows of a column of ``_packed`` ids, one row after the other."""
    at, data = _buffer(column)
    keys = np.zeros((at[-1] - at[0]) // 8, np.uint64)
    for begin, end in zip(at[:-1], at[1:], strict=True):
        planes = data[begin:end].reshape(8, -1)
        own = keys[(begin - at[0]) // 8 : (end - at[0]) // 8]
        np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64, out=own)
    return keys


def _pack_tree(buckets: int):
    """Values of the tree, packed for each bucket of ids."""

    def pack(held):
        table = pa.Table.from_batches(held)
        keys = table["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys, kind="stable")
        keys, value, base = keys[order], table["value"].to_numpy()[order], table["base"].to_numpy()[order]
        edge = _edges(keys, buckets)
        full = np.flatnonzero(np.diff(edge))
        return pa.RecordBatch.from_pydict({
            "bucket": pa.array(full),
            "keys": pa.array([_packed(keys[edge[b] : edge[b + 1]]) for b in full], pa.binary()),
            **{k: pa.array([x[edge[b] : edge[b + 1]].tobytes() for b in full], pa.binary())
               for k, x in (("value", value), ("base", base))}})

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                yield pack(held)
                held, n = [], 0
        if held:
            yield pack(held)
    return run


def _strings(docs: DataFrame, length: int, shorter: np.ndarray, least: int, buckets: int) -> DataFrame:
    """Strings of a length that occur ``least`` times or more: string, before, after (its parts), n.

    Sums are made for each part of a task's rows, then for each bucket of ids.
    """

    def part(batches):
        for batch in parts(batches, PART):
            found = [[np.zeros(0, np.uint64)] for _ in range(3)]
            for _, doc, h, out in _tokens(batch):
                train = ~out[doc]
                h, doc = h[train], doc[train]
                *_, (after, _, _), (ids, there, before) = _ending(h, doc, length)
                there = there & _may_hold(shorter, before) & _may_hold(shorter, after)
                for held, x in zip(found, (ids, before, after), strict=True):
                    held.append(x[there])
            for first, last in _ranges(buckets):
                yield packed_range(*_in_range(first, last, *found))

    def packed_range(ids, before, after):
        order = np.argsort(ids, kind="stable")  # merges sorted stretches, and is the quicker one for repeated ids
        ids = ids[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])[: len(ids)])
        n = np.diff(np.append(first, len(ids))).astype(np.uint32)
        ids, before, after = ids[first], before[order[first]], after[order[first]]
        edge = _edges(ids, buckets)
        full = np.flatnonzero(np.diff(edge))
        return pa.RecordBatch.from_pydict({"bucket": pa.array(full)} | {
            k: pa.array([x[edge[b] : edge[b + 1]].tobytes() for b in full], pa.binary())
            for k, x in (("before", before), ("after", after), ("n", n))})

    def total(table: pa.Table) -> pa.Table:
        before, after, n = _bytes(table["before"], np.uint64), _bytes(table["after"], np.uint64), _bytes(table["n"], np.uint32)
        ids = _joined(before, after)
        order = np.argsort(ids, kind="stable")  # merges sorted stretches, and is the quicker one for repeated ids
        ids = ids[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])[: len(ids)])
        n = np.add.reduceat(n[order].astype(np.int64), first) if len(ids) else n.astype(np.int64)
        ids, at, often = ids[first], order[first], n >= least
        return pa.table({"string": ids[often].view(np.int64), "before": before[at[often]].view(np.int64),
                         "after": after[at[often]].view(np.int64), "n": n[often]})

    packed = docs.select("doc_id", "text").mapInArrow(lean(part), "bucket long, before binary, after binary, n binary")
    return packed.groupBy("bucket").applyInArrow(lean_groups(total), "string long, before long, after long, n long")


def _level(strings: DataFrame, shorter: DataFrame, divergence: float) -> tuple[DataFrame, DataFrame]:
    """(strings with log10 of their last word's probability and what it adds to a text's score,
    contexts of the tree with log10 of the share of their suffix)."""
    before = shorter.select(F.col("string").alias("before"), F.col("n").alias("total"))
    after = shorter.select(F.col("string").alias("after"), F.col("log_p").alias("lower"))
    known = strings.join(after, "after").join(before, "before")
    own = (F.col("n") - DISCOUNT) / F.col("total")
    gain = F.col("n") * (F.log(F.col("n") / F.col("total")) - F.col("lower") * math.log(10))
    # The join by contexts leaves the rows where a context is summed.
    context = Window.partitionBy("before")
    known = known.select("string", "before", "n", "lower", own.alias("own"), F.sum(gain).over(context).alias("gain"),
                         F.sum(own).over(context).alias("share"), F.min("string").over(context).alias("one"))
    known = known.withColumn("back", F.when(F.col("gain") >= divergence, F.log10(F.greatest(1 - F.col("share"), F.lit(1e-12)))))
    in_tree = F.col("back").isNotNull()
    p = F.col("own") + F.pow(F.lit(10.0), F.col("back") + F.col("lower"))
    named = in_tree & (F.col("string") == F.col("one"))  # a context is named by one of its rows
    level = saved(known.select(
        "string", "n", F.when(in_tree, F.log10(p)).otherwise(F.col("lower")).alias("log_p"),
        F.when(in_tree, F.log10(p) - F.col("lower") - F.col("back")).otherwise(0.0).alias("adds"),
        F.when(named, F.col("before")).alias("context"), F.when(named, F.col("back")).alias("back")), "level")
    contexts = level.where("context IS NOT NULL").select(F.col("context").alias("before"), "back")
    return level.drop("context", "back"), contexts


def suffix_tree_values(docs: DataFrame, vocabulary: DataFrame, tokens: int, buckets: int, settings: Settings) -> DataFrame:
    """The trained model: for each word and each string of the tree, ``key`` (its id), ``value`` (what each
    occurrence adds to log10 of a text's probability, over that of an unseen word), ``base`` (log10 of a
    word's add-one count, 0 for longer strings) and ``hot`` (whether it is looked up in memory). Drops
    ``vocabulary``."""
    shorter = vocabulary.select(F.col("word").alias("string"), "n", F.log10(F.col("n") / (tokens + 1.0)).alias("log_p"),
                                F.log10("n").alias("adds"))
    tree, steps = None, [vocabulary]
    for length in range(1, settings.depth + 2):
        base, share = (F.log10(F.col("n") + 1), settings.word_share) if length == 1 else (F.lit(0.0), settings.string_share)
        hot = F.col("n") >= share * tokens
        level = shorter
        if length <= settings.depth:
            field = _field(shorter.where(F.col("n") >= settings.least), "string")
            longer = saved(_strings(docs, length + 1, field, settings.least, buckets), "strings")
            shorter, contexts = _level(longer, shorter, settings.divergence)
            dropped(docs.sparkSession, longer)
            steps.append(shorter)
            level = level.join(contexts.withColumnRenamed("before", "string"), "string", "left").withColumn("adds", F.col("adds") + F.coalesce("back", F.lit(0.0)))
        level = level.select(F.col("string").alias("key"), F.col("adds").alias("value"), base.alias("base"), hot.alias("hot"))
        level = level.where("value <> 0 OR base > 0")
        tree = level if tree is None else tree.unionAll(level)
    tree = saved(tree, "tree")
    dropped(docs.sparkSession, *steps)
    return tree


_SUMS = "known long, base double, value double"


def _sums(index: np.ndarray, n: int, value: np.ndarray, base: np.ndarray, times=1) -> dict[str, np.ndarray]:
    return {"known": np.bincount(index, (base > 0) * times, n).astype(np.int64),
            "base": np.bincount(index, base * times, n).astype(float), "value": np.bincount(index, value * times, n).astype(float)}


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted keys hold the wanted ones, and whether they do."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def suffix_tree_scores(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Train on the documents that are not held out, and score all.

    Reads ``doc_id`` and ``text``; other columns are ignored. Held out are the documents whose
    crc32(doc_id as text) mod 7 is 2. Tokens are the words, A-Z lower-cased, and an end. Returns one
    row per row of ``docs``: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known`` (tokens seen in
    training), ``train_tokens``, ``base_score`` (log10, add-one unigrams) and ``score`` (log10 under
    the tree). A null text is empty: its only token is the end. A null doc_id has the empty text and
    is trained on. Repeated rows count each. An empty table gives no rows; without any training
    document all words are unknown.
    """
    if not 1 <= settings.depth <= 3:
        raise ValueError("contexts have one to three symbols")
    vocabulary = saved(_sum_by(docs.select("doc_id", "text").mapInArrow(lean(_count_words), "word long, n long"), "word"), "vocabulary")
    tokens, kinds = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(1 + tokens // BUCKET, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tree = suffix_tree_values(docs, vocabulary, tokens, buckets, settings)
    key, value, base = _columns(tree.where("hot").select("key", "value", "base"))  # at most 1 / share rows a length
    order = np.argsort(key.view(np.uint64))
    key, value, base = key.view(np.uint64)[order], value[order], base[order]
    others = tree.where("NOT hot")
    field = _field(others, "key")
    held = others.select("key", "value", "base").mapInArrow(lean(_pack_tree(buckets)), "bucket long, keys binary, value binary, base binary")
    held = saved(held, "held")
    dropped(docs.sparkSession, tree)
    kind = dict(docs.dtypes)["doc_id"]

    def ask(batches):
        row = TaskContext.get().partitionId() << 33
        near = np.zeros(1 << NEAR, bool)
        near[key >> np.uint64(64 - NEAR)] = True
        for batch in parts(batches, PART):
            keys, places, start = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], row
            for s, doc, h, out in _tokens(batch):
                sums = _sums(doc[:0], s.n, value[:0], base[:0])
                for ids, there, _ in _ending(h, doc, settings.depth + 1):
                    ids, at_doc = ids[there], doc[there]
                    maybe = np.flatnonzero(near[ids >> np.uint64(64 - NEAR)])
                    at, here = _found(key, ids[maybe])
                    hot = maybe[here]
                    for k, x in _sums(at_doc[hot], s.n, value[at[here]], base[at[here]]).items():
                        sums[k] += x
                    open_ = _may_hold(field, ids)
                    open_[hot] = False
                    keys.append(ids[open_])
                    places.append((at_doc[open_] + (row - start)).astype(np.uint16))
                rows = np.arange(row, row + s.n)
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(rows % buckets), "part": pa.array(np.full(s.n, start)), "row": pa.array(rows),
                    "doc_id": batch.column("doc_id").slice(s.rows[0], s.n), "held_out": pa.array(out),
                    "n_tokens": pa.array(np.bincount(doc, minlength=s.n).astype(np.int64)),
                    **{k: pa.array(x) for k, x in sums.items()},
                    **{k: pa.nulls(s.n, pa.binary()) for k in ("keys", "texts", "places", "times")}})
                row += s.n
            for first, last in _ranges(buckets):
                yield questions(start, batch.column("doc_id").type, *_in_range(first, last, keys, places))

    def questions(start, kind, keys, places):
        """What a part's texts ask from a range of buckets: each key once, with the texts that have it, and how often."""
        order = np.argsort(keys, kind="stable")  # the places of a key stay in order
        keys, places = keys[order], places[order]
        begins = np.ones(len(keys), bool)
        begins[1:] = keys[1:] != keys[:-1]
        new = begins.copy()
        new[1:] |= places[1:] != places[:-1]
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(keys))).astype(np.uint32)
        keys, places, first = keys[begins], places[at], np.flatnonzero(begins[at])
        first = np.append(first, len(at))
        texts = np.diff(first).astype(np.uint16)
        edge = _edges(keys, buckets)
        full = np.flatnonzero(np.diff(edge))
        none = {k: pa.nulls(len(full), t) for k, t in (
            ("doc_id", kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
            ("known", pa.int64()), ("base", pa.float64()), ("value", pa.float64()))}
        return pa.RecordBatch.from_pydict({
            "bucket": pa.array(full), "part": pa.array(np.full(len(full), start)), "row": pa.nulls(len(full), pa.int64()), **none,
            "keys": pa.array([_packed(keys[edge[b] : edge[b + 1]]) for b in full], pa.binary()),
            "texts": pa.array([texts[edge[b] : edge[b + 1]].tobytes() for b in full], pa.binary()),
            **{k: pa.array([x[first[edge[b]] : first[edge[b + 1]]].tobytes() for b in full], pa.binary())
               for k, x in (("places", places), ("times", times))}})

    packs = {"places": np.uint16, "knowns": np.uint32, "bases": np.float64, "values": np.float64}

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        """The rows as they are, and for each part the sums of what its texts ask from this bucket."""
        whole = asked.filter(pa.compute.is_valid(asked["n_tokens"])).drop_columns(["bucket", "keys", "texts", "places", "times"])
        for k in packs:
            whole = whole.append_column(k, pa.nulls(len(whole), pa.binary()))
        asked = asked.filter(pa.compute.is_valid(asked["keys"]))
        keys = _unpacked(held["keys"])
        order = np.argsort(keys, kind="stable")
        at, here = _found(keys[order], _unpacked(asked["keys"]))
        texts = _bytes(asked["texts"], np.uint16)
        at, here = np.repeat(order[at] if len(keys) else at, texts), np.repeat(here, texts)
        value, base = _bytes(held["value"], np.float64), _bytes(held["base"], np.float64)
        place, times, parts = _bytes(asked["places"], np.uint16), _bytes(asked["times"], np.uint32), asked["part"].to_numpy()
        sizes = np.diff(_buffer(asked["places"])[0]) // 2
        ends, out = np.append(0, np.cumsum(sizes)), {"part": [], **{k: [] for k in packs}}
        for i in range(0, len(parts), ANSWERS):
            j = min(i + ANSWERS, len(parts))
            of = slice(ends[i], ends[j])
            got = here[of]
            slot = (np.repeat(np.arange(j - i) * PART, sizes[i:j]) + place[of])[got]
            sums = _sums(slot, (j - i) * PART, value[at[of][got]], base[at[of][got]], times[of][got])
            used = np.flatnonzero(np.bincount(slot, minlength=(j - i) * PART))
            found = dict(zip(packs, (used % PART, *(x[used] for x in sums.values())), strict=True))
            edge = np.searchsorted(used, np.arange(j - i + 1) * PART)
            full = np.flatnonzero(np.diff(edge))
            out["part"] += parts[i + full].tolist()
            for k, x in found.items():
                x = x.astype(packs[k])
                out[k] += [x[edge[b] : edge[b + 1]].tobytes() for b in full]
        none = {k: pa.nulls(len(out["part"]), whole.schema.field(k).type) for k in whole.column_names if k not in out}
        packed = pa.table({"part": pa.array(out["part"], pa.int64()), **none, **{k: pa.array(out[k], pa.binary()) for k in packs}})
        return pa.concat_tables([whole, packed.select(whole.column_names)])

    def total(table: pa.Table) -> pa.Table:
        """The rows of a part, with the sums from all buckets."""
        whole = table.filter(pa.compute.is_valid(table["n_tokens"])).sort_by("row")
        packed = table.filter(pa.compute.is_valid(table["places"]))
        place, times, base, value = (_bytes(packed[k], t) for k, t in packs.items())
        names = ("known", "base", "value")
        added = [whole[k].to_numpy() + np.bincount(place, x, len(whole)).astype(float) for k, x in zip(names, (times, base, value), strict=True)]
        return pa.table({k: whole[k] for k in ("doc_id", "held_out", "n_tokens")} | dict(zip(names, added, strict=True)))

    fields = f"part long, row long, doc_id {kind}, held_out boolean, n_tokens long, {_SUMS}"
    asked = docs.select("doc_id", "text").mapInArrow(lean(ask), f"bucket long, {fields}, keys binary, texts binary, places binary, times binary")
    rows = asked.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(
        lean_groups(answer), f"{fields}, places binary, knowns binary, bases binary, values binary")
    rows = rows.groupBy("part").applyInArrow(lean_groups(total), f"doc_id {kind}, held_out boolean, n_tokens long, known double, base double, value double")
    return rows.select(
        "doc_id", "held_out", "n_tokens", F.col("known").cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(tokens + kinds + 1)).alias("base_score"),
        (F.col("value") - F.col("n_tokens") * math.log10(tokens + 1)).alias("score"))
