"""Resampling documents towards a target distribution by hashed n-gram importance weights.

A table of 256 bytes lower-cases A-Z and blanks every ASCII separator of a text's UTF-8, so that
``bytes.split`` yields its words. The CRC of a run of words goes on from that of the run without its
last word. Runs fall into buckets; how much likelier the target is to use a bucket than the documents
are is its gain, and a document's weight is the sum of its runs' gains. Seeded Gumbel noise turns the
highest sums of weight and noise into a draw without replacement in proportion to importance.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from acequia.llm.shared import numbered, saved

#: Lower-cases A-Z, keeps digits, a-z and all bytes above ASCII, blanks the rest.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Bytes of a text that are split at once; a longer text is cut between words.
PIECE = 1 << 20
#: Rows whose texts are Python objects at once.
ROWS = 256

MEASURES = "n_features long, n_words long, weight long"


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``PIECE`` bytes."""
    at, size = 0, len(text)
    while at < size:
        cut = SEPARATOR.search(text, at + PIECE)
        end = cut.start() if cut else size
        yield text[at:end].translate(TABLE).split()
        at = end


def run_hashes(words: list[bytes], n: int, open_: deque[int]) -> Iterator[int]:
    """CRC of every run of 1 to ``n`` words by its last word. ``open_`` holds the CRCs of the runs
    that end with the word before, shortest first, and is left so for the next list."""
    for word in words:
        longer = [crc32(b" " + word, before) for before in open_]
        open_.clear()
        open_.append(crc32(word))
        open_.extend(longer[: n - 2])
        yield open_[0]
        yield from longer


def features(text: bytes | None, n: int) -> Iterator[tuple[Counter, int]]:
    """Counts of the runs by CRC, and the number of words, for each piece of a text."""
    open_: deque[int] = deque()
    for words in word_lists(text or b""):
        if n == 1:  # each distinct word is hashed once
            by_hash: Counter = Counter()
            for word, count in Counter(words).items():
                by_hash[crc32(word)] += count
        else:
            by_hash = Counter(run_hashes(words, n, open_))
        yield by_hash, len(words)


def _columns(counts: Counter, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.fromiter(counts.keys(), np.int64, len(counts)) % buckets
    return keys, np.fromiter(counts.values(), np.int64, len(counts))


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    for at in range(0, len(column), ROWS):
        yield from column.slice(at, ROWS).cast(pa.large_binary()).to_pylist()


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Runs in each bucket over all texts. A task sends one row for each bucket that it has seen."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch.column(0)):
                for counts, _ in features(text, n):
                    keys, values = _columns(counts, buckets)
                    np.add.at(total, keys, values)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "runs"])

    sums = texts.select("text").mapInArrow(run, "bucket long, runs long").groupBy("bucket").agg(F.sum("runs").alias("runs"))
    counts = np.zeros(buckets, np.int64)
    for row in sums.collect():  # one row a bucket at most
        counts[row.bucket] = row.runs
    return counts


def gains(documents: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of the target's share of each bucket by the documents' share), each count
    raised by one."""
    buckets, of_documents, of_target = len(documents), int(documents.sum()), int(target.sum())
    return np.array([
        math.floor(scale * math.log(((t + 1) * (of_documents + buckets)) / ((s + 1) * (of_target + buckets))))
        for s, t in zip(documents.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(rows: DataFrame, by_bucket: np.ndarray, n: int) -> DataFrame:
    """All columns of ``rows``, of which one is ``text``, without it but with ``n_features``,
    ``n_words`` and ``weight``, the sum of the gains of the text's runs."""
    others = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches):
        for batch in batches:
            found = []
            for text in _texts(batch.column("text")):
                n_features = n_words = weight = 0
                for counts, words in features(text, n):
                    keys, values = _columns(counts, len(by_bucket))
                    n_features += int(values.sum())
                    n_words += words
                    weight += int(by_bucket[keys] @ values)
                found.append((n_features, n_words, weight))
            measured = np.array(found, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in others] + [pa.array(x) for x in measured],
                [f.name for f in others] + ["n_features", "n_words", "weight"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [MEASURES])
    return rows.mapInArrow(run, schema)


def _gumbel(seed: int, scale: int) -> Column:
    """floor(scale * Gumbel noise) from the seed and the doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def target_gains(docs: DataFrame, target: DataFrame, n: int, buckets: int, scale: int) -> np.ndarray:
    return gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets), scale)


def _draw(docs: DataFrame, by_bucket: np.ndarray, n: int, percent: int, min_words: int, seed: int, scale: int) -> DataFrame:
    rows = weighed(docs.select("doc_id", "text"), by_bucket, n)
    rows = saved(rows.withColumn("score", F.col("weight") + _gumbel(seed, scale)), "weighed")
    long_enough = rows.where(F.col("n_words") >= min_words)
    drawn = long_enough.count() * percent // 100
    # Ties go to the smaller doc_id, those of equal ids (nulls last) by what else is known.
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    places = numbered(long_enough, order, "place", "by-score")
    ranks = places.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place")
    return ranks.unionByName(rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def importance_ranks(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, percent: int = 10,
                     min_words: int = 20, seed: int = 2024, scale: int = 1000) -> DataFrame:
    """How strongly each document resembles the target, and the draw.

    Reads ``doc_id`` and ``text`` of ``docs`` and ``text`` of ``target``; other columns are ignored.
    Words are runs of digits, letters and all characters above ASCII after lower-casing A-Z; features
    are all runs of 1 to ``n`` words joined by a space, repeats counted. Returns one row per row of
    ``docs``: ``doc_id``, ``n_features``, ``n_words``, ``weight``, ``score`` (weight and seeded noise)
    and ``rank``: 1, 2, 3... by descending score for the drawn ``percent`` of the documents with at
    least ``min_words`` words, null for all others.

    A null or empty text has no features and weight 0; a very long one is cut between words and read
    whole. Ties go to the smaller doc_id; a null doc_id comes last and takes the noise of an empty id.
    Rows that repeat a doc_id are documents of their own. An empty ``target`` counts 0 in every bucket,
    an empty ``docs`` gives no rows.
    """
    by_bucket = target_gains(docs, target, n, buckets, scale)
    return _draw(docs, by_bucket, n, percent, min_words, seed, scale)


def resampled_documents(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, percent: int = 10,
                        min_words: int = 20, seed: int = 2024, scale: int = 1000) -> DataFrame:
    """The drawn documents with all their columns, chosen as ``importance_ranks`` does; nulls, ties,
    long texts and empty tables as there.

    Only the last drawn row reaches the driver. Rows up to it in the order of the draw are kept, so
    rows that repeat its doc_id, features, weight and score are kept with it.
    """
    by_bucket = target_gains(docs, target, n, buckets, scale)
    ranks = _draw(docs, by_bucket, n, percent, min_words, seed, scale)
    last = ranks.where("rank IS NOT NULL").agg(
        F.max_by(F.struct("score", "doc_id", "n_features", "weight"), "rank")).first()[0]
    if last is None:
        return docs.limit(0)
    rows = weighed(docs.select(F.struct(*docs.columns).alias("acequia_row"), "doc_id", "text"), by_bucket, n)
    rows = rows.withColumn("score", F.col("weight") + _gumbel(seed, scale)).where(F.col("n_words") >= min_words)
    later_id = F.lit(False) if last.doc_id is None else F.col("doc_id").isNull() | (F.col("doc_id") > last.doc_id)
    more = (F.col("n_features") > last.n_features) | (
        (F.col("n_features") == last.n_features) & (F.col("weight") > last.weight))
    beyond = (F.col("score") < last.score) | ((F.col("score") == last.score) & (
        later_id | (F.col("doc_id").eqNullSafe(F.lit(last.doc_id)) & more)))
    return rows.where(~beyond).select("acequia_row.*")
