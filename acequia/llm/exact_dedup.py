"""Exact dedup by an extendible-hash index on shared files.

A text's key is a 64-bit hash whose leading bits name a slot of the directory. A bucket
that holds more keys than it may is split, which doubles the directory whenever the
bucket had used all its bits. Texts then go to owner tasks by ranges of slots and keys.
An owner walks the texts of each key in the order of their bytes and compares each with
the one before it: a text that differs is a further link of the key's chain, an equal
one joins the link. The hash only finds the place; the bytes decide.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from acequia.llm.shared import saved

#: Bits of a key that the directory can use at most, which bounds it at 2**20 slots.
#: A bucket that is overfull even then keeps its entries as a longer chain.
MAX_DEPTH = 20


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _keyed(docs: DataFrame, key_bits: int) -> DataFrame:
    norm = normalised(F.col("text"))
    key = F.xxhash64(norm)
    if key_bits < 64:
        key = F.shiftleft(key, 64 - key_bits)
    return docs.withColumn("acequia_text", norm).withColumn("acequia_key", key)


def _prefix(key: Column, bits: int) -> Column:
    """Leading ``bits`` of a 64-bit key as a whole number."""
    return F.shiftright(F.shiftrightunsigned(key, 1), 63 - bits)


def directory(entries: DataFrame, capacity: int, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, int]:
    """The directory of an index and its depth: ``slot``, ``bucket`` (the first slot that shares
    it), ``local_depth``. Starts with one bucket and doubles while a bucket is overfull."""
    counts = saved(entries.groupBy(_prefix(F.col("key"), max_depth).alias("fine")).agg(F.count(F.lit(1)).alias("n")), "slots")

    def filled(depth: int) -> DataFrame:
        at = F.shiftright("fine", max_depth - depth).alias("slot")
        return counts.groupBy(at).agg(F.sum("n").alias("n"))

    depth = 0
    slots = filled(0).select("slot", F.lit(0).alias("local_depth"), "n")
    while depth < max_depth and slots.where(F.col("n") > capacity).limit(1).count():
        depth += 1
        doubled = slots.withColumn("split", F.col("n") > capacity).select(
            F.explode(F.array(F.col("slot") * 2, F.col("slot") * 2 + 1)).alias("slot"), "local_depth", "n", "split")
        halves = filled(depth).withColumnRenamed("n", "own")
        slots = saved(doubled.join(halves, "slot", "left").select(
            "slot",
            F.when(F.col("split"), depth).otherwise(F.col("local_depth")).alias("local_depth"),
            F.when(F.col("split"), F.coalesce("own", F.lit(0).cast("long"))).otherwise(F.col("n")).alias("n")), "directory")
    first = F.expr(f"shiftleft(shiftright(slot, {depth} - local_depth), {depth} - local_depth)")
    return slots.select("slot", first.alias("bucket"), "local_depth"), depth


def build_index(docs: DataFrame, capacity: int = 4096, key_bits: int = 64) -> DataFrame:
    """The index of all distinct texts, written to the shared folder.

    One row per entry: ``bucket``, ``local_depth``, ``key``, ``link`` (its place in the chain of
    entries with the same key, 1 for most), ``sha256``, ``newest`` (largest doc_id), ``copies``.
    Copies within a task are merged before they move, so a group that holds a third of all rows
    reaches its owner as one row per task. A null text equals an empty one, a null doc_id is smaller
    than all others, and a very long text moves whole, once per task that holds it.
    """
    rows = _keyed(docs.select("doc_id", "text"), key_bits).withColumn("acequia_task", F.spark_partition_id())
    slots, depth = directory(rows.select(F.col("acequia_key").alias("key")).distinct(), capacity)
    merged = rows.groupBy("acequia_task", F.col("acequia_key").alias("key"), F.col("acequia_text").alias("text")).agg(
        F.max("doc_id").alias("newest"), F.count(F.lit(1)).alias("copies"))
    # Ranges of keys are ranges of slots, and so of buckets.
    owned = merged.withColumn("sha256", F.unhex(F.sha2("text", 256))).repartitionByRange("key")
    chain = Window.partitionBy("key").orderBy("text")
    differs = ~F.col("text").eqNullSafe(F.lag("text").over(chain))
    walked = owned.withColumn("differs", differs.cast("int")).select(
        "key", F.sum("differs").over(chain.rowsBetween(Window.unboundedPreceding, 0)).alias("link"), "sha256", "newest", "copies")
    entries = walked.groupBy("key", "link").agg(
        F.max("sha256").alias("sha256"), F.max("newest").alias("newest"), F.sum("copies").alias("copies"))
    return saved(entries.withColumn("slot", _prefix(F.col("key"), depth)).join(slots, "slot").select(
        "bucket", "local_depth", "key", F.col("link").cast("int").alias("link"), "sha256", "newest", "copies"), "index")


def exact_dedup(docs: DataFrame, capacity: int = 4096, key_bits: int = 64) -> DataFrame:
    """Group equal texts; the row with the largest ``doc_id`` of a group stays.

    Reads ``doc_id`` and ``text``; other columns are ignored. Returns one row per row of ``docs``:
    ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``bucket``, ``link``. A null
    text equals an empty one. A null ``doc_id`` is smaller than all others. Repeated rows are all
    returned, and all those with the largest ``doc_id`` count as kept (``distinct_documents`` returns
    one of them). An empty table gives no rows. ``key_bits`` shortens the hash, for tests of chains.
    """
    index = build_index(docs, capacity, key_bits)
    rows = _keyed(docs.select("doc_id", "text"), key_bits).select(
        "doc_id", F.col("acequia_key").alias("key"), F.unhex(F.sha2("acequia_text", 256)).alias("sha256"))
    return rows.join(index, ["key", "sha256"]).select(
        "doc_id",
        F.col("newest").alias("keep_id"),
        F.col("copies").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("newest")).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
        "bucket", "link")


def distinct_documents(docs: DataFrame, capacity: int = 4096) -> DataFrame:
    """The documents that ``exact_dedup`` keeps, one for each text, with all their columns.

    Reads ``doc_id`` and ``text``; null and empty texts are one text, of repeated rows one stays, very
    long texts are compared whole, and an empty table gives no rows. Names of other columns may clash.
    """
    index = build_index(docs, capacity).alias("i")
    rows = _keyed(docs, 64).drop("acequia_text").withColumn(
        "acequia_sha", F.unhex(F.sha2(normalised(F.col("text")), 256))).alias("d")
    match = (F.col("d.acequia_key") == F.col("i.key")) & (F.col("d.acequia_sha") == F.col("i.sha256"))
    kept = rows.join(index, match & F.col("d.doc_id").eqNullSafe(F.col("i.newest")), "left_semi")
    return kept.dropDuplicates(["acequia_key", "acequia_sha"]).select(*docs.columns)
