"""A quality classifier: gradient-boosted trees on histograms of document statistics.

One pass over the texts measures every document. Some labelled rows, at most about a stated number,
train the trees on the driver: statistics are cut into bins at their quantiles, and every level of a
tree is grown from the sums of gradients by node, statistic and bin. The trees are then flattened into
arrays in which node ``i`` has the children ``2 i + 1`` and ``2 i + 2``, and tasks walk all rows through
all trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from acequia.llm.shared import saved
from acequia.llm.words import Prefix, byte_values, mix, per_doc, slices, windows

#: Kinds of bytes whose shares of a text are statistics.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\v\f\r",
    "newline": b"\n",
    "stop": b".,;:!?",
    "quote": b"'\"()[]-",
    "mark": b"#*$%&|<>@^~_=+/\\{}`",
    "beyond": bytes(range(128, 256)),
}

#: What is measured of a document, in the order of its array.
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "word_bytes", "word_spread", "longest_word", "words_per_line",
    "distinct_words", "commonest_word", "word_collisions", "repeated_pairs", "repeated_triples", "repeated_lines",
    "lines_with_stop", "capital_words", "shouted_words", "digit_words", "marked_words", "letterless_words",
    "short_words", "long_words", *(f"share_{k}" for k in KINDS),
)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _repeated(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: how many of its keys are distinct, how often its commonest occurs, and the sum of
    squared counts."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    counts, of = np.diff(np.append(at, len(k))), d[at]
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, counts)
    return per_doc(of, n), most, np.bincount(of, counts.astype(float) ** 2, n)


def statistics(s) -> np.ndarray:
    """One row of ``STATISTICS`` for each text of a slice."""
    s.find_words()
    buf, n, doc = s.buf, s.n, s.doc
    size = np.diff(s.at)
    words = per_doc(doc, n)
    lengths = s.ends - s.starts
    prefix = Prefix(byte_values(buf))
    hashes = prefix.of(s.starts, s.ends)

    kind = np.zeros(256, np.int64)  # 0: none of the kinds
    for i, members in enumerate(KINDS.values(), 1):
        kind[np.frombuffer(members, np.uint8)] = i
    of_byte = kind[buf]
    place = {name: i for i, name in enumerate(KINDS, 1)}

    def upto(*names: str) -> np.ndarray:
        """How many bytes of these kinds lie before each place."""
        return np.concatenate([[0], np.cumsum(np.isin(of_byte, [place[x] for x in names]))])

    def within(sums: np.ndarray) -> np.ndarray:
        return sums[s.ends] - sums[s.starts]

    shares = {}
    for name in KINDS:
        sums = upto(name)
        shares[f"share_{name}"] = _share(sums[s.at[1:]] - sums[s.at[:-1]], size)
    uppers, letters = within(upto("upper")), within(upto("upper", "lower", "beyond"))

    def words_where(condition: np.ndarray) -> np.ndarray:
        return _share(per_doc(doc, n, condition), words)

    distinct, most, squares = _repeated(hashes, doc, n)
    repeats = {}
    for name, k in (("repeated_pairs", 2), ("repeated_triples", 3)):
        at = windows(doc, k)
        different, _, _ = _repeated(Prefix(hashes).of(at, at + k), doc[at], n)
        repeats[name] = 1 - _share(different, per_doc(doc[at], n))
        repeats[name][words < k] = 0

    # Lines that are not empty: from a text's start or a newline to the next.
    breaks = np.flatnonzero(buf == 10)
    starts = np.union1d(breaks + 1, s.at[:-1])
    starts = starts[starts < len(buf)]
    stops = np.append(breaks, len(buf))
    ends = np.minimum(stops[np.searchsorted(stops, starts)], s.at[np.searchsorted(s.at, starts, "right")])
    starts, ends = starts[ends > starts], ends[ends > starts]
    line_doc = np.searchsorted(s.at, starts, "right") - 1
    lines = per_doc(line_doc, n)
    different, _, _ = _repeated(prefix.of(starts, ends), line_doc, n)
    ended = of_byte[ends - 1] == place["stop"] if len(ends) else np.zeros(0, bool)

    mean = _share(np.bincount(doc, lengths, n), words)
    spread = np.sqrt(np.maximum(_share(np.bincount(doc, lengths.astype(float) ** 2, n), words) - mean**2, 0))
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, lengths)
    found = {
        "log_bytes": np.log1p(size), "log_words": np.log1p(words), "log_lines": np.log1p(lines),
        "word_bytes": mean, "word_spread": spread, "longest_word": np.log1p(longest),
        "words_per_line": np.log1p(_share(words, lines)),
        "distinct_words": _share(distinct, words), "commonest_word": _share(most, words),
        "word_collisions": _share(squares, words.astype(float) ** 2), **repeats,
        "repeated_lines": 1 - _share(different, lines), "lines_with_stop": _share(per_doc(line_doc, n, ended), lines),
        "capital_words": words_where(of_byte[s.starts] == place["upper"]),
        "shouted_words": words_where((uppers == letters) & (letters > 1)),
        "digit_words": words_where(within(upto("digit")) > 0),
        "marked_words": words_where(within(upto("mark")) > 0),
        "letterless_words": words_where(letters == 0),
        "short_words": words_where(lengths <= 3), "long_words": words_where(lengths > 12), **shares,
    }
    found["repeated_lines"][lines == 0] = 0
    return np.stack([found[name] for name in STATISTICS], axis=1).astype(np.float32)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``stats`` (in the order of ``STATISTICS``) of every row."""
    def run(batches):
        for batch in batches:
            for s in slices(batch.column("text")):
                i, j = s.rows
                values = statistics(s)
                offsets = np.arange(s.n + 1, dtype=np.int32) * len(STATISTICS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))], ["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, stats array<float>")


@dataclass(frozen=True)
class Boosting:
    """Size of the trees and how they learn."""

    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    smoothing: float = 1.0
    least_weight: float = 3.0
    #: About so many labelled rows train; a seeded hash of doc_id picks them where there are more.
    rows: int = 50_000


@dataclass(frozen=True)
class Forest:
    """Flattened trees: row t holds tree t, node i has the children 2 i + 1 (up to the cut) and 2 i + 2."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        trees, inner = self.feature.shape
        total = np.full(len(x), self.base)
        if trees:
            tree = np.arange(trees)
            for at in range(0, len(x), 4096):
                part = x[at : at + 4096]
                row, node = np.arange(len(part))[:, None], np.zeros((len(part), trees), np.int64)
                while node[0, 0] < inner:
                    right = part[row, self.feature[tree, node]] > self.cut[tree, node]
                    node = 2 * node + 1 + right
                total[at : at + 4096] += self.value[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each statistic, the ascending values that end its bins but the last."""
    found = []
    for column in x.T:
        cuts = np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower")) if len(column) else column
        found.append(cuts[cuts < column.max()] if len(column) else cuts)
    return found


def train(x: np.ndarray, y: np.ndarray, settings: Boosting = Boosting()) -> Forest:
    """Trees that lower the logistic loss of labels ``y`` (0 or 1), one after the other."""
    n, width = x.shape
    inner, bins = 2**settings.depth - 1, settings.bins
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    trees = settings.trees if n and 0 < y.sum() < n else 0
    feature = np.zeros((trees, inner), np.int64)
    cut = np.full((trees, inner), np.inf)
    value = np.zeros((trees, inner + 1))
    ends = edges(x, bins)
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(ends, x.T, strict=True)], axis=1) if trees else x
    slots = binned + np.arange(width) * bins  # place of each value in a histogram of one node
    usable = np.zeros((width, bins), bool)
    for f, e in enumerate(ends):
        usable[f, : len(e)] = True  # a cut after this bin leaves something on both sides
    total = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(settings.depth):
            first, count = 2**level - 1, 2**level
            at = (node - first)[:, None] * (width * bins) + slots
            size = count * width * bins
            gs, hs = (np.bincount(at.ravel(), np.repeat(w, width), size).reshape(count, width, bins).cumsum(axis=2)
                      for w in (g, h))
            g_all, h_all = gs[:, :1, -1:], hs[:, :1, -1:]
            left, right = settings.smoothing + hs, settings.smoothing + h_all - hs
            gain = gs**2 / left + (g_all - gs) ** 2 / right - g_all**2 / (settings.smoothing + h_all)
            fits = usable & (hs >= settings.least_weight) & (h_all - hs >= settings.least_weight)
            gain = np.where(fits, gain, -np.inf).reshape(count, -1)
            best = gain.argmax(axis=1)
            f, b = best // bins, best % bins
            split = gain[np.arange(count), best] > 1e-9
            for i in np.flatnonzero(split):
                feature[t, first + i], cut[t, first + i] = f[i], ends[f[i]][b[i]]
            i = node - first
            node = 2 * node + 1 + (split[i] & (binned[np.arange(n), f[i]] > b[i]))
        leaf = node - inner
        value[t] = settings.rate * np.bincount(leaf, g, inner + 1) / (settings.smoothing + np.bincount(leaf, h, inner + 1))
        total += value[t, leaf]
    return Forest(base, feature, cut, value)


def training_rows(stats: DataFrame, labels: DataFrame, learnable: Column, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of about ``rows`` labelled documents at most, by a seeded hash of doc_id.

    A document with several labels has the lowest of them. The order is that of hash and statistics,
    so a run trains the same trees again.
    """
    known = labels.where(learnable & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = known.groupBy(F.col("doc_id").alias("labelled")).agg(F.min("quality").alias("quality"))
    share = min(1.0, rows / max(known.count(), 1))
    place = F.xxhash64(F.lit(seed), "labelled").bitwiseAND((1 << 53) - 1)
    known = known.withColumn("place", place).where(F.col("place") < int(share * (1 << 53)))
    # One row per label: a repeated doc_id trains once.
    found = stats.join(known, F.col("doc_id") == F.col("labelled")).groupBy("labelled").agg(
        F.min("stats").alias("stats"), F.first("quality").alias("quality"), F.first("place").alias("place"))
    table = found.select("place", "labelled", "stats", "quality").toArrow().sort_by([("place", "ascending"), ("labelled", "ascending")])
    x = table.column("stats").combine_chunks().flatten().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0)
    return x.reshape(-1, len(STATISTICS)).astype(np.float64), table.column("quality").to_numpy().astype(np.float64)


def quality_scores(docs: DataFrame, labels: DataFrame, learnable: Column, threshold: float = 0.3,
                   settings: Boosting = Boosting(), seed: int = 12) -> DataFrame:
    """Probability that each document has quality 1.

    Reads ``doc_id`` and ``text`` of ``docs``, and ``doc_id`` and ``quality`` of ``labels``, of which rows
    where ``learnable`` (a condition on doc_id) holds may train; other columns are ignored. Returns one row
    per row of ``docs``: ``doc_id``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on). Only
    statistics of the text decide a score. About ``settings.rows`` labelled rows train at most; every
    document is measured whole and scored.

    A null text is an empty one, whose statistics are all 0; it is scored like any other. A very long
    text is measured in one piece. Equal texts have equal scores, and rows that repeat a doc_id are scored
    each by its own text. Labels other than 0 and 1, without doc_id or without a document train
    nothing; the lowest of several labels counts. With labels of one kind only, or none, all scores
    are their smoothed share (0.5 for none). An empty ``docs`` gives no rows.
    """
    stats = saved(measured(docs), "statistics")
    forest = train(*training_rows(stats, labels, learnable, settings.rows, seed), settings)

    def run(batches):
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(forest.scores(x.astype(np.float64)))], ["doc_id", "score"])

    scored = stats.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
