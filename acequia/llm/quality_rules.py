"""Quality rules: measures of each text, and lines that too many documents of a host share.

Lines are hashed after normalisation (words only, A-Z lower-cased). For each host the
distinct documents that hold a line are counted; exact copies of a text count as one
document, so a page is not boilerplate merely because it was collected twice. A line
above the limit is removed, and a document that keeps too little is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from acequia.llm.shared import lean, parts, saved
from acequia.llm.words import Prefix, byte_values, lists, mix, per_doc, slices, windows


@dataclass(frozen=True)
class Limits:
    """A line is removed in a host where more than ``documents`` distinct documents, and more
    than ``share`` of all of them, hold it. A document is depleted when it keeps fewer than
    ``words`` words or less than ``part`` of them."""

    documents: int = 50
    share: float = 0.02
    words: int = 10
    part: float = 0.2


#: Bytes of text that are measured at once.
AT_ONCE = 1 << 19
#: Rows that a task returns at once: a whole batch of texts is held several times, here and by Spark.
ROWS = 2000
_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_hash long"
_LINES = "lines array<long>, line_words array<long>"


def _measured(s) -> dict[str, np.ndarray]:
    """Measures and distinct normalised lines of each text of a slice."""
    s.find_words()
    buf, n = s.buf, s.n
    prefix = Prefix(byte_values(buf))
    out = {"n_words": per_doc(s.doc, n), "text_hash": prefix.of(s.at[:-1], s.at[1:]).view(np.int64)}
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    out["word_chars"] = per_doc(s.doc, n, points[s.ends] - points[s.starts])
    symbol = np.zeros(256, bool)
    symbol[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
    seen = np.concatenate([[0], np.cumsum(symbol[buf])])
    out["n_symbols"] = seen[s.at[1:]] - seen[s.at[:-1]]

    # Words in five-word windows that the text holds twice or more.
    hashes = prefix.of(s.starts, s.ends)
    at = windows(s.doc, 5)
    window = mix(Prefix(hashes).of(at, at + 5) + mix(s.doc[at].astype(np.uint64)))
    order = np.argsort(window)
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    out["n_repeat_words"] = per_doc(s.doc, n, np.cumsum(cover)[:-1] > 0)

    # Lines with a word: from each text's start or a newline to the next.
    breaks = np.flatnonzero(buf == 10)
    starts = np.union1d(breaks + 1, s.at[:-1])
    starts = starts[starts < len(buf)]
    stops = np.append(breaks, len(buf))
    ends = np.minimum(stops[np.searchsorted(stops, starts)], s.at[np.searchsorted(s.at, starts, "right")])
    w0, w1 = np.searchsorted(s.starts, starts), np.searchsorted(s.starts, ends)
    full = w1 > w0
    starts, ends, w0, w1 = starts[full], ends[full], w0[full], w1[full]
    doc = s.doc[w0]
    exact = mix(prefix.of(starts, ends) + mix(doc.astype(np.uint64)))
    out["n_dup_lines"] = per_doc(doc, n) - per_doc(doc[np.unique(exact, return_index=True)[1]], n)

    plain = s.buf
    s.lower()
    prefix = Prefix(byte_values(s.buf))
    s.buf = plain
    line = Prefix(prefix.of(s.starts, s.ends)).of(w0, w1)
    _, first, inverse = np.unique(mix(line + mix(doc.astype(np.uint64))), return_index=True, return_inverse=True)
    words = np.bincount(inverse, w1 - w0, len(first)).astype(np.int64)
    order = np.argsort(first, kind="stable")
    out["line_doc"], out["line"], out["line_count"] = doc[first[order]], line[first[order]].view(np.int64), words[order]
    return out


def _measure(batches):
    for batch in batches:
        for s in slices(batch.column("text"), AT_ONCE):
            i, j = s.rows
            m = _measured(s)
            counts = per_doc(m["line_doc"], s.n)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").slice(i, j - i),
                "host": batch.column("host").slice(i, j - i),
                **{k: pa.array(m[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_hash")},
                "lines": lists(counts, pa.array(m["line"])),
                "line_words": lists(counts, pa.array(m["line_count"])),
            })


def measure(docs: DataFrame) -> DataFrame:
    """One row per document: its measures, the hash of its text, and its distinct normalised lines."""
    return docs.select("doc_id", F.col("source").alias("host"), "text").mapInArrow(
        lean(_measure), f"doc_id {dict(docs.dtypes)['doc_id']}, host {dict(docs.dtypes)['source']}, {_MEASURES}, {_LINES}")


def frequent_lines(measured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(host, line) of the lines above the limit. Distinct texts are counted; partial sums before
    each shuffle keep a line or host with many documents from weighing on one task."""
    line = measured.select("host", "text_hash", F.explode("lines").alias("line")).distinct()
    held = line.groupBy("host", "line").agg(F.count(F.lit(1)).alias("held"))
    hosts = measured.select("host", "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    often = held.where(F.col("held") > limits.documents).alias("l")
    return often.join(hosts.alias("h"), F.col("l.host").eqNullSafe(F.col("h.host"))).where(
        F.col("held") > F.col("all") * limits.share).select("l.host", "line")


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Judge every document by its measures and by the lines it shares with others of its source.

    Returns one row per row of ``docs`` (columns ``doc_id``, ``text``, ``source`` are read, others
    ignored): ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``removed_words`` (words in lines above the limit),
    ``removed_lines`` (their hashes), ``text_hash``, ``host``, ``kept``.
    A null text counts as empty and fails; a null source is a host of its own; repeated rows are
    judged alike and all returned; an empty table gives no rows. Ties cannot arise: a line is
    above the limit or not.
    """
    measured = saved(measure(docs).withColumn("row", F.monotonically_increasing_id()), "measured")
    often = saved(frequent_lines(measured, limits), "frequent-lines")
    lines = measured.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select(
        "row", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words")).alias("a")
    cut = lines.join(often.alias("o"), (F.col("a.line") == F.col("o.line")) & F.col("a.host").eqNullSafe(F.col("o.host")))
    cut = cut.groupBy("a.row").agg(F.sum("words").alias("removed_words"), F.collect_set("a.line").alias("removed_lines"))
    judged = measured.drop("lines", "line_words").join(cut, "row", "left").withColumn(
        "removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (left < limits.words) | (left < limits.part * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "removed_words", "removed_lines", "text_hash", "host",
        (~failed & ~depleted).alias("kept"))


def _drop_lines(batches):
    for batch in parts(batches, ROWS):
        column, cuts, pieces = batch.column("text"), batch.column("acequia_cut").to_pylist(), []
        for s in slices(column, AT_ONCE):
            i, j = s.rows
            if not any(cuts[i:j]):
                pieces.append(column.slice(i, j - i))
                continue
            texts = column.slice(i, j - i).to_pylist()
            s.lower()
            s.find_words()
            prefix = Prefix(s.word_hashes())
            for k, cut in enumerate(cuts[i:j]):
                if cut:
                    own, at, keep = set(cut), int(s.at[k]), []
                    for line in texts[k].encode().split(b"\n"):
                        w = np.searchsorted(s.starts, [at, at + len(line)])
                        if w[0] == w[1] or int(prefix.of(w[:1], w[1:]).view(np.int64)[0]) not in own:
                            keep.append(line)
                        at += len(line) + 1
                    texts[k] = b"\n".join(keep).decode()
            pieces.append(pa.array(texts, column.type))
        text = pa.concat_arrays(pieces) if pieces else column
        yield pa.RecordBatch.from_arrays(
            [text if n == "text" else batch.column(n) for n in batch.schema.names], batch.schema.names)


def clean(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that ``quality_rules`` keeps, without their lines above the limit.

    All columns stay as they are, but for ``text`` and, where there is one, ``n_chars``. Null and empty texts
    fail and go; a null doc_id or source is a value like any other; repeated rows stay if one does; a very
    long text is cut line by line; an empty table gives no rows.
    """
    judged = quality_rules(docs, limits).where("kept").groupBy("doc_id", "host", "text_hash").agg(
        F.first("removed_lines").alias("acequia_cut"))
    hashed = docs.mapInArrow(
        lean(_with_hash), T.StructType([*docs.schema.fields, T.StructField("acequia_hash", T.LongType())])).alias("d")
    joined = hashed.join(judged.alias("j"), (F.col("d.acequia_hash") == F.col("j.text_hash"))
                         & F.col("d.doc_id").eqNullSafe(F.col("j.doc_id")) & F.col("d.source").eqNullSafe(F.col("j.host")))
    out = joined.select(*(F.col(f"d.{c}") for c in docs.columns), "j.acequia_cut")
    out = out.mapInArrow(lean(_drop_lines), out.schema).drop("acequia_cut")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def _with_hash(batches):
    for batch in parts(batches, ROWS):
        hashes = [Prefix(byte_values(s.buf)).of(s.at[:-1], s.at[1:]).view(np.int64) for s in slices(batch.column("text"), AT_ONCE)]
        yield batch.append_column("acequia_hash", pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64)))
