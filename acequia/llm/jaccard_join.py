"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct word shingles. Every shingle toggles one bit of a
sketch, so two sketches differ in at most as many bits as the sets differ in shingles.
From the threshold and the sizes follows how many shingles two linked sets may differ
in, d. The wide sketch is cut into bands, d + 1 and some to spare: two linked sets agree
on at least one band (pigeonhole), and the bands are joined by equality, once for each
band of sizes. A narrow sketch of 1024 bits then discards pairs whose Hamming distance
is above d, and exact intersections decide the rest.

Equal sets are one node. In each group that shares a band, nodes are compared with a
representative, first within a task and then among tasks, so large groups of near copies
cost one comparison a member. Groups whose nodes are still in different components are cut into
small lots anew in each of a few rounds; the nodes of a lot meet, and links that are found merge
components. What is then left outside a group's largest component is compared with the whole
group, so no link between components is missed. There are more bands than the pigeonhole needs, so that each
node may leave the largest of its groups: those of a common passage would be compared pair by pair.

Before sets are compared, sketches with bits in proportion to the set discard most pairs that
the narrow one lets through; only the sets of the rest are read again.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from acequia.llm.components import components, relabelled
from acequia.llm.shared import lean, saved
from acequia.llm.words import Prefix, lists, mix, slices, windows

#: Bytes of text whose shingles are made at once.
AT_ONCE = 1 << 19
#: Bits of the narrow sketch.
BITS = 1024
#: Nodes of a group that meet in one round, and the number of rounds.
LOT, ROUNDS = 16, 3
#: Nodes of a group's largest component that one task compares with the rest.
SHARE = 4096
#: Sizes of one level are within this ratio; a level's number fits so many bits.
RATIO, LEVEL_BITS = 1.35, 8
#: Of so many differences that a link allows, one more band may be left out because its key is common.
COMMON = 8


def shingles(s, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a slice, by text and then by value: (texts, hashes)."""
    s.lower()
    s.find_words()
    prefix = Prefix(s.word_hashes())
    at = windows(s.doc, n)
    doc, hashes = s.doc[at], prefix.of(at, at + n)
    firsts = np.searchsorted(s.doc, np.arange(s.n + 1))
    words = np.diff(firsts)
    short = np.flatnonzero((words > 0) & (words < n))  # the whole sequence is one shingle
    doc = np.concatenate([doc, short])
    hashes = np.concatenate([hashes, prefix.of(firsts[short], firsts[short] + words[short])])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def nodes(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and fingerprint of each text's set; both 0 for an empty one."""
    sizes = np.bincount(doc, minlength=n)
    prints = np.zeros(n, np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        at = (np.cumsum(sizes) - sizes)[full]
        mixed = mix(hashes + np.uint64(0xA0761D6478BD642F))
        both = np.add.reduceat(mixed, at) + mix(np.bitwise_xor.reduceat(hashes, at))
        prints[full] = mix(both + sizes[full].astype(np.uint64))
    return sizes, prints


class Levels:
    """Bands of sizes: ``start[k]`` is the smallest size of level k, ``bands[k]`` the number of
    sketch bands for pairs whose smaller set is in level k, ``spare[k]`` how many bands of a set may be
    left out: ``empty[k]`` empty ones, and ``common[k]`` whose keys many others have. With d + 1 + 2 * spare
    bands, two linked sets agree on at least 2 * spare + 1, of which each side leaves out at most ``spare``."""

    def __init__(self, percent: int, largest: int):
        start, self.bands, self.spare, self.empty, self.common = [1], [], [], [], []
        while start[-1] <= largest:
            # The next level starts high enough for every partner to be in this or the next level.
            start.append(max(start[-1] + 1, int(start[-1] * RATIO), -(-100 * start[-1] // percent)))
            differ = (start[-1] - 1) * (100 - percent) // percent
            spare, common = 0, differ // COMMON
            while True:
                bands = differ + 1 + 2 * (spare + common)
                rate = bands * math.exp(-start[-2] / bands)
                tail = 1 - sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(spare + 1))
                if tail < 0.02 or spare >= 12 or differ == 0:
                    break
                spare += 1
            self.bands.append(bands if differ else 0)  # no two sets that differ can be linked
            self.empty.append(spare)
            self.common.append(common)
            self.spare.append(spare + common)
        self.start = np.array(start)


def _of_level(keys: np.ndarray, level) -> np.ndarray:
    """Keys whose last bits tell their level."""
    return (keys & ~np.uint64((1 << LEVEL_BITS) - 1)) | np.asarray(level).astype(np.uint64)


def band_keys(doc, hashes, sizes, levels: Levels, percent: int, wanted: np.ndarray):
    """Keys of all bands of the wanted texts: (texts, keys), grouped by text."""
    out_doc, out_key = [], []
    level = np.searchsorted(levels.start, sizes, "right") - 1
    bands, spare = np.array(levels.bands + [0]), np.array(levels.empty + [0])
    for back in (0, 1):
        own = level - back
        # In the level below only as the larger set of a pair.
        use = wanted & (sizes > 0) & (own >= 0)
        if back:
            use &= percent * sizes <= 100 * (levels.start[level] - 1)
        use &= bands[own] > 0
        if not use.any():
            continue
        pick = use[doc]
        d, h = doc[pick], hashes[pick]
        b = bands[own[d]].astype(np.uint64)
        band = ((h >> np.uint64(32)) * b) >> np.uint64(32)
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (band[1:] != band[:-1])
        at = np.flatnonzero(new)
        odd = np.bitwise_xor.reduceat(mix(h ^ np.uint64(0x8EBC6AF09C88C6E3)), at)
        d, band = d[at], band[at]
        place = mix((own[d].astype(np.uint64) << np.uint64(32)) + band)
        out_doc.append(d)
        out_key.append(_of_level(mix(odd + place), own[d]))
        filled = np.bincount(d, minlength=len(sizes))
        for i in np.flatnonzero(use & (bands[own] - filled > spare[own])):
            empty = np.setdiff1d(np.arange(bands[own[i]]), band[d == i])[spare[own[i]] :].astype(np.uint64)
            out_doc.append(np.full(len(empty), i))
            out_key.append(_of_level(mix(mix((np.uint64(own[i]) << np.uint64(32)) + empty)), own[i]))
    if not out_doc:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    d, k = np.concatenate(out_doc), np.concatenate(out_key)
    order = np.argsort(d, kind="stable")
    return d[order], k[order]


def _sketch(doc, hashes, n):
    count = np.bincount(doc * BITS + (hashes & np.uint64(BITS - 1)).astype(np.int64), minlength=n * BITS)
    return np.packbits((count & 1).astype(np.uint8).reshape(n, BITS), axis=1) if n else np.zeros((0, BITS // 8), np.uint8)


def wide_sketches(doc: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of two to four bits for each shingle, a power of two: 64-bit words of each text, and
    all words. A sketch folds into one of half its bits."""
    words = np.where(sizes > 0, 2 ** np.ceil(np.log2(np.maximum(2 * sizes, 64) / 64)).astype(np.int64), 0)
    first = np.cumsum(words) - words
    bit = (mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)) & (words[doc] * 64 - 1).astype(np.uint64)).astype(np.int64)
    count = np.bincount(first[doc] * 64 + bit, minlength=int(words.sum()) * 64)
    return words, np.packbits((count & 1).astype(np.uint8)).view(np.int64)


def _apart(a: np.ndarray, b: np.ndarray) -> int:
    """Hamming distance of two wide sketches; the longer one is folded."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


def sketched(docs: DataFrame, n: int) -> DataFrame:
    """One row per document: ``doc_id``, ``size`` and ``node`` of its set, narrow ``sketch``."""

    def run(batches):
        for batch in batches:
            for s in slices(batch.column("text"), AT_ONCE):
                doc, hashes = shingles(s, n)
                sizes, prints = nodes(doc, hashes, s.n)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(s.rows[0], s.n),
                    "size": pa.array(sizes.astype(np.int64)),
                    "node": pa.array(prints.view(np.int64)),
                    "sketch": lists(np.full(s.n, BITS // 64), pa.array(_sketch(doc, hashes, s.n).reshape(-1).view(np.int64))),
                })

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, size long, node long, sketch array<long>")


def banded(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``node`` and the ``keys`` of its bands, once for equal sets that lie near each other. The keys take
    more room than the texts' hashes, so they are made anew where they are read instead of stored."""

    def run(batches):
        levels = Levels(percent, 1 << 12)
        for batch in batches:
            for s in slices(batch.column("text"), AT_ONCE):
                doc, hashes = shingles(s, n)
                sizes, prints = nodes(doc, hashes, s.n)
                if s.n and sizes.max() >= levels.start[-1]:
                    levels = Levels(percent, int(sizes.max()) * 2)
                first = np.zeros(s.n, bool)
                first[np.unique(prints, return_index=True)[1]] = True
                d, keys = band_keys(doc, hashes, sizes, levels, percent, first)
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array(prints.view(np.int64)),
                    "keys": lists(np.bincount(d, minlength=s.n), pa.array(keys.view(np.int64))),
                })

    return docs.select("text").mapInArrow(lean(run), "node long, keys array<long>")


def _by_key(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, nodes and first node of each key in a batch, sorted, without repeated rows."""
    keys = batch.column("keys")
    key = keys.flatten().to_numpy(zero_copy_only=False)
    node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), np.diff(keys.offsets.to_numpy()))
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[new], node[new]
    start = np.ones(len(key), bool)
    start[1:] = key[1:] != key[:-1]
    return key, node, start


def _leaders(batches):
    for batch in batches:
        key, node, start = _by_key(batch)
        yield pa.RecordBatch.from_arrays([pa.array(key[start]), pa.array(node[start])], ["key", "node"])


def _near(batches):
    for batch in batches:
        key, node, start = _by_key(batch)
        lead = node[np.flatnonzero(start)][np.cumsum(start) - 1] if len(key) else node
        yield pa.RecordBatch.from_arrays([pa.array(x[~start]) for x in (key, lead, node)], ["key", "a", "b"])


def _far(batches):
    """Rows come sorted by key and node; pairs of the first node of a key with the others."""
    last, lead = None, None
    for batch in batches:
        key, node = (batch.column(i).to_numpy() for i in range(2))
        if not len(key):
            continue
        start = np.ones(len(key), bool)
        start[1:] = key[1:] != key[:-1]
        start[0] = last is None or key[0] != last
        firsts = np.where(start, node, 0)
        at = np.maximum.accumulate(np.where(start, np.arange(len(key)), -1))
        leads = np.where(at >= 0, firsts[np.maximum(at, 0)], lead if lead is not None else 0)
        last, lead = key[-1], leads[-1]
        use = ~start & (leads != node)
        yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (key, leads, node)], ["key", "a", "b"])


def shared_bands(keyed: DataFrame) -> DataFrame:
    """(key, a, b): nodes that share a band, each with a representative of its group. A group's rows
    are first joined within each task, which sends on one row a key, so no group floods a task."""
    near = keyed.mapInArrow(_near, "key long, a long, b long")
    lead = keyed.mapInArrow(_leaders, "key long, node long").repartition("key").sortWithinPartitions("key", "node")
    return saved(near.unionByName(lead.mapInArrow(_far, "key long, a long, b long")), "bands")


def _may_link(percent: int, a: str, b: str) -> Column:
    """Whether the sizes and narrow sketches of two aliased rows allow a link."""
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    apart = reduce(add, (F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(BITS // 64)))
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (apart * (100 + percent) <= (100 - percent) * (x + y))


class _Verifier:
    """Exact comparison of pairs of nodes; texts are read again for the wanted nodes only."""

    def __init__(self, docs: DataFrame, rows: DataFrame, members: DataFrame, n: int, percent: int):
        self.docs, self.n, self.percent = docs, n, percent
        ends = members.select("a").union(members.select("b")).distinct()
        first = rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("sketch").alias("sketch"), F.min("size").alias("size"))
        self.known = saved(ends.join(first, F.col("a") == F.col("node")).select("node", "first_id", "sketch", "size"), "nodes")

        def run(batches):
            for batch in batches:
                for s in slices(batch.column("text"), AT_ONCE):
                    doc, hashes = shingles(s, n)
                    sizes, prints = nodes(doc, hashes, s.n)
                    words, wide = wide_sketches(doc, hashes, sizes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(prints.view(np.int64)), pa.array(sizes.astype(np.int64)), lists(words, pa.array(wide))],
                        ["node", "size", "wide"])

        wide = self._texts(self.known).mapInArrow(lean(run), "node long, size long, wide array<long>")
        self.wide = saved(self._of(wide, self.known), "wide")

    def _texts(self, wanted: DataFrame) -> DataFrame:
        ids = wanted.select("first_id").distinct().hint("shuffle_hash")
        texts = self.docs.select("doc_id", "text")
        return texts.join(ids, F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi").select("text")

    def _of(self, read: DataFrame, wanted: DataFrame) -> DataFrame:
        """Rows that were read for wanted nodes, once each: rows that repeat a doc_id may have other texts."""
        return read.dropDuplicates(["node"]).join(wanted.select("node"), "node", "left_semi")

    def near(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and narrow sketches allow a link."""
        x, y = self.known.alias("x"), self.known.alias("y")
        joined = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
        return joined.where(_may_link(self.percent, "x", "y")).select("a", "b")

    def close(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose wide sketches allow a link."""
        percent = self.percent

        def run(batches):
            for batch in batches:
                size = batch.column("xs").to_numpy() + batch.column("ys").to_numpy()
                sketches = [(c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (batch.column("xw"), batch.column("yw"))]
                (x, xo), (y, yo) = sketches
                apart = np.array([_apart(x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]]) for i in range(batch.num_rows)], np.int64)
                fits = pa.array(apart * (100 + percent) <= (100 - percent) * size)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(fits) for c in ("a", "b")], ["a", "b"])

        x, y = (self.wide.select(F.col("node").alias(c), F.col("size").alias(f"{d}s"), F.col("wide").alias(f"{d}w"))
                for c, d in (("a", "x"), ("b", "y")))
        return pairs.join(x, "a").join(y, "b").mapInArrow(run, "a long, b long")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are linked."""
        n = self.n
        pairs = saved(self.close(pairs), "close")
        if pairs.isEmpty():
            return pairs
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = saved(self.known.join(ends, "node", "left_semi").select("node", "first_id"), "wanted")

        def run(batches):
            for batch in batches:
                for s in slices(batch.column("text"), AT_ONCE):
                    doc, hashes = shingles(s, n)
                    sizes, prints = nodes(doc, hashes, s.n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(prints.view(np.int64)), lists(sizes, pa.array(hashes.view(np.int64)))], ["node", "items"])

        sets = saved(self._of(self._texts(wanted).mapInArrow(lean(run), "node long, items array<long>"), wanted), "sets")
        x = sets.select(F.col("node").alias("a"), F.col("items").alias("xa"))
        y = sets.select(F.col("node").alias("b"), F.col("items").alias("xb"))
        both = F.size(F.array_intersect("xa", "xb"))
        union = F.size("xa") + F.size("xb") - both
        return saved(pairs.join(x, "a").join(y, "b").where(100 * both >= self.percent * union).select("a", "b"), "pairs")


def _labelled(rows: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        own = labels.select(F.col("node").alias("labelled"), F.col("label").alias("found"))
        rows = rows.join(own, F.col(c) == F.col("labelled"), "left").withColumn(
            f"{c}_label", F.coalesce("found", c)).drop("labelled", "found")
    return rows


def _meetings(ends: DataFrame, round_: int) -> tuple[Column, DataFrame, DataFrame]:
    """Condition and two sides of a join in which nodes (``x``, ``label``) of a group (``key`` of ``n``
    members) meet. In the first rounds they meet in lots, a small group in one lot; then all nodes meet
    those outside their group's largest component, dealt over tasks."""
    if round_ < ROUNDS:
        lots = F.ceil(F.col("n") / LOT).cast("long")
        lot = F.when(lots > 1, F.pmod(F.xxhash64("x", "key", F.lit(round_)), lots)).otherwise(F.lit(0).cast("long"))
        dealt = ends.withColumn("lot", lot)
        return F.col("l.label") < F.col("r.label"), dealt.alias("l"), dealt.alias("r")
    counts = ends.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    largest = counts.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("most"))
    known = ends.join(largest, "key")
    parts = F.ceil(F.col("n") / SHARE).cast("long")
    outside = known.where("label <> most").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    every = known.withColumn("lot", F.pmod(F.xxhash64("x", "key"), parts))
    once = (F.col("r.label") == F.col("r.most")) | (F.col("l.label") < F.col("r.label"))
    return once & (F.col("l.label") != F.col("r.label")), outside.alias("l"), every.alias("r")


def rarer(ends: DataFrame, percent: int) -> DataFrame:
    """Rows (key, x) of groups without the most common keys of each node. Linked nodes agree on one more band
    than both may leave out, so they still meet; a key that many texts have, such as a passage that is alone
    in its band, then groups only the few that have too many of those."""
    levels = Levels(percent, 1 << 40)
    common = F.array(*(F.lit(c) for c in levels.common))
    counted = ends.join(ends.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    level = F.col("key").bitwiseAND((1 << LEVEL_BITS) - 1).cast("int")
    order = Window.partitionBy("x", level).orderBy(F.desc("n"), "key")
    ranked = counted.withColumn("at", F.row_number().over(order))
    return ranked.where((F.col("at") > F.element_at(common, level + 1)) | (F.col("n") <= LOT)).select("key", "x")


def linked_nodes(docs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """``node`` and ``label`` of all nodes that have links."""
    members = shared_bands(banded(docs, n, percent))
    verify = _Verifier(docs, rows, members, n, percent)
    # Each node with its smallest representative.
    first = saved(members.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    labels = components(verify.links(verify.near(first)))
    # The other representatives, where that leaves two components.
    stars = _labelled(members.select("a", "b").distinct(), labels, ["a", "b"]).where(F.col("a_label") != F.col("b_label"))
    stars = saved(verify.near(stars.select("a", "b").join(first, ["a", "b"], "left_anti")), "pairs")
    labels = relabelled(labels, verify.links(stars))
    # Groups whose nodes are still in different components.
    tested = first.unionByName(stars)
    ends = members.select("key", F.col("a").alias("x")).union(members.select("key", F.col("b").alias("x"))).distinct()
    ends = rarer(ends, percent)
    looks = verify.known.select(F.col("node").alias("x"), "size", "sketch")
    round_ = 0
    while round_ <= ROUNDS:
        ends = saved(_labelled(ends, labels, ["x"]).select("key", "x", F.col("x_label").alias("label")), "ends")
        groups = ends.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
        ends = saved(ends.join(groups.where("low < high").select("key", "n"), "key"), "mixed-ends")
        if ends.isEmpty():
            break
        apart, l, r = _meetings(ends.join(looks, "x"), round_)
        met = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.lot") == F.col("r.lot")) & apart & _may_link(percent, "l", "r"))
        pairs = met.select(F.least("l.x", "r.x").alias("a"), F.greatest("l.x", "r.x").alias("b")).distinct()
        pairs = saved(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
        links = verify.links(pairs)
        labels = relabelled(labels, links)
        ends = ends.where(F.col("n") > LOT).select("key", "x")  # in smaller groups, all have met
        # A round without links means that lots find little: all that is left meets.
        round_ = round_ + 1 if round_ >= ROUNDS or not links.isEmpty() else ROUNDS
    return labels


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents linked by the Jaccard similarity of their word shingles.

    Two documents are linked when 100 * intersection >= ``percent`` * union of their sets of
    distinct ``n``-word shingles (A-Z lower-cased; fewer words are one shingle). Reads ``doc_id``
    and ``text``, other columns are ignored. Returns one row per row of ``docs``: ``doc_id``,
    ``n_shingles``, ``component_id`` (smallest doc_id that links reach, its own included; null only
    where all of these are null). A null, empty or wordless text has no shingles and is linked with
    nothing. Repeated rows are all returned. An empty table gives no rows. There is no cap on
    partners, candidates or group sizes.
    """
    rows = saved(sketched(docs, n), "sketches")
    labels = linked_nodes(docs, rows, n, percent)
    firsts = rows.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    firsts = _labelled(firsts, labels, ["node"])
    least = firsts.groupBy("node_label").agg(F.min("first_id").alias("component_id"))
    found = saved(firsts.join(least, "node_label").select("node", "component_id"), "components")
    return rows.alias("r").join(found.alias("f"), F.col("r.node") == F.col("f.node"), "left").select(
        "doc_id", F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_distinct(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest doc_id."""
    kept = jaccard_join(docs, n, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("acequia_kept")).distinct().hint("shuffle_hash")
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("acequia_kept")), "left_semi")
