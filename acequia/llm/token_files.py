"""Token-id files: documents encoded by a public tokenizer, in the order of their ids.

A file is a Parquet file whose rows are blocks: ``part`` and ``block`` (its place),
``doc_ids`` and ``sizes`` (whose ids it holds, and how many each), ``first`` (ids before
it in its file), ``n_ids``, and ``payload``, the block as ``token_coder`` writes it. Spark's committer publishes the
files, so a task that is lost or repeated leaves no trace.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from acequia.llm.shared import kept, lean, new_path
from acequia.llm.token_coder import decode_block, encode_block
from acequia.llm.words import Prefix, byte_values, mix, slices

#: What may follow the letters of a plain word: the tokenizer takes such a run as one part. An apostrophe may begin others.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Ids after which a block is closed; documents are never cut.
BLOCK = 1 << 19
#: Parts of words whose ids a worker remembers.
REMEMBERED = 1_500_000
#: New parts that are kept apart before they are merged with the others, which costs as much as there are others.
YOUNG = 60_000
#: Bytes of text that are encoded at once.
AT_ONCE = 1 << 19


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable bytes are their own, the
    others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space, so that a text's ids are its words' ids.

    A plain word has letters, then perhaps marks; the tokenizer lower-cases and splits it
    just there, so both parts go straight to its model. Letters are those of ASCII and of U+00C0 to
    U+00FF, which are the same in composed text and have one lower-case form. Any other word goes
    through the whole tokenizer. Every distinct part is encoded once; parts are known by hash.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.alphabet = self.tokenizer.get_vocab_size()
        self.plain = Tokenizer(self.tokenizer.model)  # the model alone: no letter that writes a byte is white space
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        (self.digit,) = self.plain.encode("0", add_special_tokens=False).ids  # stands between plain parts, which have no digits
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items() if b != 32})
        self._clear()

    def _clear(self):
        """Parts are known in two tables of hashes, starts and sizes, the second one of new parts."""
        self.tables = [self._table() for _ in range(2)]
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    @staticmethod
    def _table():
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and sizes of the parts with these hashes, and whether they are known."""
        start, size, known = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        for held, starts, sizes in self.tables:
            if len(held):
                at = np.minimum(np.searchsorted(held, hashes), len(held) - 1)
                here = held[at] == hashes
                start[here], size[here] = starts[at[here]], sizes[at[here]]
                known |= here
        return start, size, known

    def _learn(self, hashes: np.ndarray, parts: list[bytes], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Add parts whose hashes, in ascending order, are new; their starts and sizes."""
        size, start, found = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), []
        plain, strange = np.flatnonzero(~odd), np.flatnonzero(odd)
        if len(plain):
            text = b" 0 ".join([*(parts[i] for i in plain.tolist()), b""]).decode("latin-1")
            if not text.isascii():
                text = text.translate(self.letters)
            (e,) = self._fast(self.plain)([text], add_special_tokens=False)
            own = np.array(e.ids, np.int32)
            ends = np.flatnonzero(own == self.digit)
            found.append(own)
            start[plain] = np.append(0, ends[:-1] + 1)
            size[plain] = ends - start[plain]
        if len(strange):
            ids = [e.ids for e in self._fast(self.tokenizer)([parts[i].decode() for i in strange], add_special_tokens=False)]
            size[strange] = np.fromiter(map(len, ids), np.int64, len(ids))
            start[strange] = np.cumsum(size[strange]) - size[strange] + sum(map(len, found))
            found.append(np.fromiter(chain.from_iterable(ids), np.int32, int(size[strange].sum())))
        start, before = start + self.used, self.used
        self.used += sum(map(len, found))
        if self.used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(self.used - len(self.flat), len(self.flat) // 2), np.int32)])
        self.flat[before : self.used] = np.concatenate(found)
        self.tables[1] = self._merged(self.tables[1], (hashes, start, size))
        if len(self.tables[1][0]) > YOUNG:
            self.tables = [self._merged(*self.tables), self._table()]
        return start, size

    @staticmethod
    def _fast(tokenizer):
        return getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)

    @staticmethod
    def _merged(table, new):
        at = np.searchsorted(table[0], new[0])
        return tuple(np.insert(a, at, b.astype(a.dtype)) for a, b in zip(table, new, strict=True))

    def encode(self, s) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a slice, and how many each has."""
        s.find_words()
        raw = s.buf
        s.lower()
        low, n = s.buf, len(raw)
        before = np.zeros(n, np.uint8)
        before[1:] = low[:-1]
        accent = (before == 0xC3) & (low >= 0x80) & (low < 0xC0) & (low != 0x97) & (low != 0xB7)
        low = low + ((accent & (low < 0x9F)) * np.uint8(32))
        letter = ((low >= 97) & (low <= 122)) | accent
        letter[:-1] |= (low[:-1] == 0xC3) & accent[1:]
        mark = np.zeros(256, bool)
        mark[np.frombuffer(MARKS, np.uint8)] = True
        letters = np.concatenate([[0], np.cumsum(letter)])
        marks = np.concatenate([[0], np.cumsum(mark[low])])
        begin, end = s.starts, s.ends
        cut = begin + letters[end] - letters[begin]  # where the letters end, if all of them come first
        plain = (cut > begin) & (letters[cut] - letters[begin] == cut - begin) & (marks[end] - marks[cut] == end - cut)
        two = plain & (cut < end)

        # One or two parts for each word, in order.
        at = np.arange(len(begin)) + np.cumsum(two) - two
        first, last = np.empty(len(begin) + int(two.sum()), np.int64), np.empty(len(begin) + int(two.sum()), np.int64)
        first[at], last[at] = begin, np.where(two, cut, end)
        first[at[two] + 1], last[at[two] + 1] = cut[two], end[two]
        odd = np.zeros(len(first), bool)
        odd[at] = ~plain
        hashes = Prefix(byte_values(low)).of(first, last)
        if odd.any():
            size = (last - first)[odd]
            ends = np.cumsum(size)
            own = raw[np.repeat(first[odd] - (ends - size), size) + np.arange(ends[-1])]
            hashes[odd] = mix(Prefix(byte_values(own)).of(ends - size, ends) + np.uint64(0x5851F42D4C957F2D))
        kinds, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if sum(len(table[0]) for table in self.tables) > REMEMBERED:
            self._clear()
        start, size, known = self._look(kinds)
        new = one[~known]
        if len(new):
            text, plain_text = raw.tobytes(), low.tobytes()
            parts = [(text if o else plain_text)[a:b] for a, b, o in zip(
                first[new].tolist(), last[new].tolist(), odd[new].tolist(), strict=True)]
            start[~known], size[~known] = self._learn(kinds[~known], parts, odd[new])
        start, size = start[inverse], size[inverse]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(start - (ends - size), size) + np.arange(int(size.sum()))]
        return ids, np.bincount(np.repeat(s.doc, 1 + two), size, s.n).astype(np.int64)


@kept
def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder, with what it remembers of earlier tasks of this module."""
    return WordEncoder(path)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode ``text`` and append ``end_id``; write all ids in ascending order of ``doc_id``.

    ``tokenizer`` is the path of a tokenizer file that every executor has.
    """

    def run(batches):
        encoder, part, block = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, sizes, doc_ids, total, first = [], [], [], 0, 0

        def closed():
            flat = np.concatenate(ids)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()),
                "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "first": pa.array([first], pa.int64()), "n_ids": pa.array([len(flat)], pa.int64()),
                "payload": pa.array([encode_block(flat, max(encoder.alphabet, end_id + 1))], pa.binary()),
            })

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for s in slices(batch.column("text"), AT_ONCE):
                own, counts = encoder.encode(s)
                ends = np.cumsum(counts + 1)
                own = np.insert(own, np.cumsum(counts), end_id)
                ids.append(own)
                sizes += (counts + 1).tolist()
                doc_ids += names[s.rows[0] : s.rows[1]]
                total += int(ends[-1])
                if total >= BLOCK:
                    yield closed()
                    ids, sizes, doc_ids, total, first, block = [], [], [], 0, first + total, block + 1
        if ids:
            yield closed()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(lean(run), _SCHEMA).write.option("compression", "none").parquet(path)


_SCHEMA = "part int, block int, doc_ids array<long>, sizes array<long>, first long, n_ids long, payload binary"


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The documents of token files: ``doc_id``, ``start`` (ids of all documents before it), ``ids``."""
    blocks = spark.read.schema(_SCHEMA).parquet(path)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select(  # one row per file
        "part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before"))
    placed = blocks.join(parts, "part").select("doc_ids", "sizes", (F.col("before") + F.col("first")).alias("first"), "payload")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = decode_block(batch.column("payload")[i].as_py()).astype("<u4")
                sizes = batch.column("sizes").slice(i, 1).flatten().to_numpy()
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_ids").slice(i, 1).flatten(),
                    pa.array(batch.column("first")[i].as_py() + ends - sizes),
                    pa.array([raw[a:b].tobytes() for a, b in zip(ends - sizes, ends, strict=True)], pa.binary()),
                ], ["doc_id", "start", "ids"])

    return placed.mapInArrow(lean(run), "doc_id long, start long, ids binary")


def token_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write token-id files of ``docs`` to the shared folder and read them back.

    Reads ``doc_id`` (whole numbers) and ``text``; other columns are ignored. Returns one row per
    row of ``docs``: ``doc_id``, ``start``, ``ids`` (unsigned 32-bit little-endian, the end id last).
    A null text is empty and gives the end id alone; a very long one makes a block of its own length, for
    documents are never cut. A null doc_id comes first; rows with one doc_id
    follow each other in no set order. An empty table gives no rows.
    """
    path = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
