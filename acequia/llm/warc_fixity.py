"""Merkle fixity audit of WARC replicas.

Every record of a replica's files is hashed; so are, in order of their offsets, ranges
of up to ``FANOUT`` neighbours, again and again up to one hash for each file, for each
part (a task's files), and for the replica. Two replicas with one root are the same.
Otherwise only children of nodes that differ are compared, down to the records.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from acequia.llm.shared import new_path, saved

FANOUT = 16
#: Records in one file, which is read by one task.
RECORDS = 1000


def warc_record(page_id: Column, url: Column, html: Column, date: str) -> Column:
    """A WARC resource record without the blank lines that end it."""
    body = F.coalesce(html, F.lit(""))
    digest = F.md5(F.concat_ws(" ", page_id.cast("string"), url).cast("binary"))
    uuid = F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    lines = [
        F.lit("WARC/1.1"), F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(url, r"[\r\n]", "")),
        F.lit(f"WARC-Date: {date}"), F.lit("Content-Type: text/html"),
        F.concat(F.lit("Page-ID: "), page_id.cast("string")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.sha2(body, 256)),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), body)  # lines that are null fall away


def write_warc(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", html: Column | None = None) -> None:
    """Write ``page_id``, ``url`` and ``html`` (or another column in its place) as gzipped WARC files. Spark's
    text writer ends each row with the blank lines that end a record, and its committer publishes
    whole files only. Pages of one id are in order of url and html, so that every replica has them alike."""
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html") if html is None else html, date)
    ordered = pages.sortWithinPartitions("page_id", "url", F.xxhash64("html"), F.octet_length("html"))
    ordered.select(record.alias("value")).write.options(
        lineSep="\r\n\r\n", compression="gzip", maxRecordsPerFile=RECORDS).text(path)


_NAME = re.compile(r"part-(\d+)-.*-c(\d+)")


def _inflate(data: bytes) -> tuple[bytes, int]:
    """What can be read of the members of a gzip file, up to where it is damaged, and the number of bytes
    that are not part of a whole member: 0 for a sound file. Checksums and lengths are compared."""
    out, at = [], 0
    while at < len(data):
        member, start = zlib.decompressobj(31), at
        try:
            while not member.eof and at < len(data):
                before, step = member.copy(), data[at : at + (1 << 14)]
                out.append(member.decompress(step))
                at += len(step)
        except zlib.error:
            member = before
            try:  # byte by byte up to the damage
                for i in range(len(step)):
                    out.append(member.decompress(step[i : i + 1]))
            except zlib.error:
                pass
            return b"".join(out), len(data) - start
        if not member.eof:
            return b"".join(out), len(data) - start
        at -= len(member.unused_data)
    return b"".join(out), 0


def _records(data: bytes):
    """(offset, length, page id) of each record; what follows damage is one record without an id."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        size = re.search(rb"\r\nContent-Length: (\d+)", data[at:head]) if head > 0 and data.startswith(b"WARC/", at) else None
        end = head + 8 + int(size[1]) if size else 0
        if not size or end > len(data) or data[end - 4 : end] != b"\r\n\r\n":
            yield at, len(data) - at, None
            return
        page = re.search(rb"\r\nPage-ID: (-?\d+)", data[at:head])
        yield at, end - at, int(page[1]) if page else None
        at = end


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a replica: ``part``, ``file``, ``idx`` (place in the file), ``page_id``, ``offset``,
    ``length``, ``hash`` (SHA-256 of the record's bytes)."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                part, file = map(int, _NAME.search(name).groups())
                raw = content.as_py()
                data, unsound = _inflate(raw)
                found = [(part, file, i, page, at, n, hashlib.sha256(data[at : at + n]).hexdigest())
                         for i, (at, n, page) in enumerate(_records(data))]
                if unsound:  # one more record, so that the file differs from its sound replica
                    found.append((part, file, len(found), None, len(data), 0, hashlib.sha256(raw[-unsound:]).hexdigest()))
                rows += found
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 6 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["part", "file", "idx", "page_id", "offset", "length", "hash"])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(
        run, "part long, file long, idx long, page_id long, offset long, length long, hash string")


def _climb(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """One level up: ranges of ``FANOUT`` neighbours of one group, at most so many rows each."""
    up = F.floor(F.col("idx") / FANOUT)
    children = F.array_sort(F.collect_list(F.struct("idx", "begin", "end", "hash")))
    rows = nodes.groupBy(*keys, up.alias("up")).agg(children.alias("c"))
    text = F.concat_ws(";", F.transform("c", lambda x: F.concat_ws(":", x.begin.cast("string"), x.end.cast("string"), x.hash)))
    return rows.select(
        *(F.col(k) for k in keys), F.col("up").alias("idx"), F.expr("c[0].begin").alias("begin"),
        F.expr("element_at(c, -1).end").alias("end"), F.sha2(text, 256).alias("hash"))


def merkle_tree(records: DataFrame) -> list[DataFrame]:
    """Levels of the tree from the records to the root. Each has ``part``, ``file`` and ``idx`` (-1 where
    a node spans several), ``hash``, and ``up``: the three of its parent as text."""
    none = F.lit(-1).cast("long")
    nodes = records.select("part", "file", "idx", F.col("offset").alias("begin"), (F.col("offset") + F.col("length")).alias("end"), "hash")
    levels = []

    def keep(nodes: DataFrame, part, file, up_part, up_file, up_idx) -> None:
        levels.append(nodes.select(
            part.alias("part"), file.alias("file"), "idx", "hash",
            F.concat_ws("/", *(c.cast("string") for c in (up_part, up_file, up_idx))).alias("up")))

    part, file, idx = F.col("part"), F.col("file"), F.col("idx")
    for keys, up in ((["part", "file"], (part, none, file)), (["part"], (none, none, part))):
        most = nodes.agg(F.max("idx")).first()[0] or 0
        f = file if "file" in keys else none
        while most >= FANOUT:
            keep(nodes, part, f, part, f, F.floor(idx / FANOUT))
            nodes, most = saved(_climb(nodes, keys), "merkle"), most // FANOUT
        # The only node of a group is a leaf of the next kind of group.
        keep(nodes, part, f, *up)
        nodes = saved(_climb(nodes, keys), "merkle")
        nodes = nodes.select(*keys[:-1], F.col(keys[-1]).alias("idx"), "begin", "end", "hash")
    most = nodes.agg(F.max("idx")).first()[0] or 0
    while most:
        keep(nodes, none, none, none, none, F.floor(idx / FANOUT))
        nodes, most = saved(_climb(nodes, []), "merkle"), most // FANOUT
    keep(nodes, none, none, none, none, none)
    return levels


def differing(one: list[DataFrame], two: list[DataFrame]) -> DataFrame | None:
    """``part``, ``file`` and ``idx`` of the records that differ or are missing in one of two trees with
    equally many levels; None if the roots agree."""
    wrong = None
    for a, b in zip(reversed(one), reversed(two), strict=True):
        if wrong is not None:
            a, b = (x.join(wrong.select(F.concat_ws("/", "part", "file", "idx").alias("up")), "up", "left_semi") for x in (a, b))
        other = b.select("part", "file", "idx", F.col("hash").alias("other"))
        wrong = saved(a.drop("up").join(other, ["part", "file", "idx"], "full").where(
            ~F.col("hash").eqNullSafe(F.col("other"))).select("part", "file", "idx"), "differing")
        if not wrong.limit(1).count():
            return None
    return wrong


def audit(spark: SparkSession, one: str, two: str) -> DataFrame:
    """Compare two replicas of WARC files.

    Returns one row per record of the first replica: ``page_id``, ``part``, ``file``, ``offset``,
    ``length``, ``sha256``, ``intact`` (the second replica has the same bytes there). Records that only
    the second holds follow with ``intact`` false and null length and hash. Files are read as far as they
    go, all gzip members of them; one whose end, checksum or length is wrong has one more record without
    page_id and bytes, which is never intact. An empty replica has no records.
    """
    a, b = (saved(read_records(spark, path), "records") for path in (one, two))
    if not a.limit(1).count() or not b.limit(1).count():
        wrong = a.select("part", "file", "idx").union(b.select("part", "file", "idx"))
    else:
        trees = [merkle_tree(x) for x in (a, b)]
        if len(trees[0]) == len(trees[1]):
            wrong = differing(*trees)
        else:  # one replica lacks files or records: no node lines up but those of the records
            wrong = differing(trees[0][:1], trees[1][:1])
    if wrong is None:  # also where both replicas are damaged alike
        return a.select("page_id", "part", "file", "offset", "length", F.col("hash").alias("sha256"), F.lit(True).alias("intact"))
    marked = a.join(wrong.withColumn("wrong", F.lit(True)), ["part", "file", "idx"], "full")
    return marked.select("page_id", "part", "file", "offset", "length", F.col("hash").alias("sha256"), F.col("wrong").isNull().alias("intact"))


def warc_fixity(pages: DataFrame, damaged: Column | None = None) -> DataFrame:
    """Write two replicas of ``pages`` (``page_id``, ``url``, ``html``; other columns are ignored) as WARC
    files in the shared folder and audit one against the other, as ``audit`` returns it.

    ``damaged`` is the html of the second replica where it is to differ. A null html is an empty body; a null
    url or page_id leaves its header line out. Repeated pages are records of their own, in order of url
    and html. A very long html is one record; a file holds ``RECORDS`` of them. An empty table gives no rows.
    """
    spark = pages.sparkSession
    paths = [new_path(spark, "warc") for _ in range(2)]
    for path, html in zip(paths, (None, damaged), strict=True):
        write_warc(pages, path, html=html)
    return audit(spark, *paths)
