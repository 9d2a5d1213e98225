"""A Merkle manifest of a dataset, with a witness for every row.

Rows are leaves, in order within their source; runs of ``fanout`` nodes become one, and the roots of
the sources are the leaves of the tree above. Tasks append the leaves of one aligned block after the
other. A node that is appended to an open subtree brings a partial witness, the nodes before it; each
later sibling extends the witnesses of those that came earlier; a finished subtree becomes a node of
the level above and passes what its members still lack down to them. The roots of the blocks, and then
those of the sources, are appended in the same way, which extends the witnesses of all rows below.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from acequia.llm.shared import numbered, saved

#: Bytes of a digest.
SIZE = 32

_COLUMNS = "source string, first long, nodes long, digests binary, witness binary, root binary"


def digest(nodes: bytes) -> bytes:
    """SHA-256 of the concatenated digests as lowercase hex text."""
    return sha256(nodes.hex().encode()).digest()


def levels(nodes: int, fanout: int) -> int:
    """Levels above so many nodes until one is left."""
    found = 0
    while nodes > 1:
        nodes, found = -(-nodes // fanout), found + 1
    return found


def text_part(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """Digest of a document's row whose text is ``text``."""
    parts = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    return F.unhex(F.sha2(F.concat(*map(text_part, parts)), 256))


class Run:
    """Nodes of the lowest level that share a parent, with what lies beside their ancestors."""

    def __init__(self, digests: list[bytes]):
        self.digests = digests
        self.witness = bytearray()


class _Node:
    def __init__(self, value: bytes, runs: list[Run], before: list[_Node]):
        self.value, self.runs = value, runs
        self.beside = bytearray(b"".join(n.value for n in before))


class Appender:
    """Nodes of one block of ``fanout ** height`` at most, appended in order."""

    def __init__(self, fanout: int, height: int):
        self.fanout, self.height = fanout, height
        self.lowest: list[bytes] = []
        self.open: list[list[_Node]] = [[] for _ in range(height)]
        self.runs: list[Run] = []
        self.root: bytes | None = None

    def append(self, value: bytes) -> None:
        self.lowest.append(value)
        if len(self.lowest) == self.fanout:
            self._run_ends()

    def _run_ends(self) -> None:
        run, self.lowest = Run(self.lowest), []
        self.runs.append(run)
        value = digest(b"".join(run.digests)) if self.height else run.digests[0]
        self._attach(value, [run], 1)

    def _attach(self, value: bytes, runs: list[Run], level: int) -> None:
        """Append a finished subtree of ``level`` to the open one above it."""
        if level >= self.height:
            self.root = value
            return
        siblings = self.open[level]
        for earlier in siblings:
            earlier.beside += value
        siblings.append(_Node(value, runs, siblings))
        if len(siblings) == self.fanout:
            self._subtree_ends(level)

    def _subtree_ends(self, level: int) -> None:
        siblings, self.open[level] = self.open[level], []
        for node in siblings:
            for run in node.runs:
                run.witness += node.beside
        self._attach(digest(b"".join(n.value for n in siblings)), [r for n in siblings for r in n.runs], level + 1)

    def finish(self) -> bytes:
        """Close what is open, the lowest level first; return the block's root."""
        if self.lowest:
            self._run_ends()
        for level in range(1, self.height):
            if self.open[level]:
                self._subtree_ends(level)
        return self.root


def _grown_block(fanout: int, depth: int):
    """One block of a source to the rows of its runs."""
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("position").combine_chunks()
        nodes, first = block.column("nodes")[0].as_py(), block.column("position")[0].as_py()
        grown = Appender(fanout, min(depth, levels(nodes, fanout)))
        for value in block.column("digest").to_pylist():
            grown.append(value)
        root = grown.finish()
        sizes = [len(r.digests) for r in grown.runs]
        starts = [0]
        for n in sizes:
            starts.append(starts[-1] + n)
        rows = block.column("row").chunk(0)
        return pa.table({
            "source": pa.array([block.column("source")[0].as_py()] * len(sizes), pa.string()),
            "first": pa.array([first + s for s in starts[:-1]], pa.int64()),
            "nodes": pa.array([nodes] * len(sizes), pa.int64()),
            "digests": pa.array([b"".join(r.digests) for r in grown.runs], pa.binary()),
            "witness": pa.array([bytes(r.witness) for r in grown.runs], pa.binary()),
            "root": pa.array([root] * len(sizes), pa.binary()),
            "rows": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), rows),
        })
    return run


def grown(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """Runs of nodes with their whole witness and the root of their tree.

    ``nodes`` has ``source`` (a tree each), ``position`` from 0, ``nodes`` (how many the tree has),
    ``digest`` and ``row``, a struct that goes along. A task grows one block of ``fanout ** depth``
    nodes at a time; the block roots are grown by the next call, whose witnesses extend these.
    """
    block = fanout**depth
    row = nodes.schema["row"].dataType.simpleString()
    runs = nodes.withColumn("block", F.col("position") - F.col("position") % block)
    runs = saved(runs.groupBy("source", "block").applyInArrow(
        _grown_block(fanout, depth), f"{_COLUMNS}, rows array<{row}>"), "runs")
    if (runs.agg(F.max("nodes")).first()[0] or 0) <= block:
        return runs
    above = runs.where(F.col("first") % block == 0).select(
        "source", F.floor(F.col("first") / block).cast("long").alias("position"),
        F.ceil(F.col("nodes") / block).cast("long").alias("nodes"), F.col("root").alias("digest"),
        F.struct(F.lit(None).cast("int").alias("none")).alias("row"))
    upper = members(grown(above, fanout, depth)).alias("u")
    lower = runs.alias("l")
    return saved(lower.join(upper, F.col("l.source").eqNullSafe(F.col("u.source"))
                      & (F.floor(F.col("l.first") / block).cast("long") == F.col("u.position"))).select(
        "l.source", "l.first", "l.nodes", "l.digests",
        F.concat("l.witness", "u.proof").alias("witness"), "u.root", "l.rows"), "grown")


def members(runs: DataFrame) -> DataFrame:
    """One row per node: ``source``, ``position``, ``nodes``, ``digest``, ``proof`` (the siblings of the
    node and of its ancestors, lowest level first, left to right), ``root`` and ``row``."""
    place, row = F.col("place"), F.col("member")
    after = F.octet_length("digests") - (place + 1) * SIZE
    return runs.select("*", F.posexplode("rows").alias("place", "member")).select(
        "source", (F.col("first") + place).alias("position"), "nodes",
        F.substring("digests", place * SIZE + 1, F.lit(SIZE)).alias("digest"),
        F.concat(F.substring("digests", F.lit(1), place * SIZE),
                 F.substring("digests", (place + 1) * SIZE + 1, after), "witness").alias("proof"),
        "root", row.alias("row"))


def manifest(docs: DataFrame, fanout: int = 16, depth: int = 3, carried: Sequence[Column] = ()) -> DataFrame:
    """A Merkle leaf, its proof and the roots for every document.

    Reads ``doc_id``, ``source``, ``lang``, ``n_chars`` and ``text``; other columns are ignored. A leaf is
    the SHA-256 of these, each ``-`` where null and otherwise its byte count, a colon and its value.
    Returns one row per row of ``docs``: ``doc_id``, the ``carried`` columns, ``leaf``, ``proof`` (digests of
    all siblings from the leaf up to the root, concatenated), ``subroot`` (of its source), ``root``, and
    the places that ``folded`` needs: ``position`` among ``nodes`` of the source, ``source_position``
    among ``sources``. Digests are binary.

    Leaves of a source ascend by doc_id, null last; rows that repeat a doc_id by their digest, so equal
    rows are leaves of their own. A null source is a source like any other and comes first. A lone leaf
    is its source's root, a lone source's root is the root. An empty text is hashed as 0 bytes, a very
    long one whole. An empty table gives no rows. No source, however large, is held by one task: a
    task grows ``fanout ** depth`` nodes at a time.
    """
    found = saved(docs.select("doc_id", "source", leaf(F.col("text")).alias("digest"), *carried), "leaves")
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_last(), F.col("digest")]
    found = numbered(found, order, "place", "leaves")
    sizes = saved(found.groupBy("source").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("nodes")), "sources")
    names = found.columns[3:-1]
    f, s = found.alias("f"), sizes.alias("s")
    nodes = f.join(s, F.col("f.source").eqNullSafe(F.col("s.source"))).select(
        "f.source", (F.col("place") - F.col("start")).alias("position"), "nodes", "digest",
        F.struct("doc_id", *names).alias("row"))
    runs = grown(nodes, fanout, depth)

    subroots = numbered(runs.where("first = 0").select("source", F.col("root").alias("digest")),
                        [F.col("source").asc_nulls_first()], "position", "subroots")
    sources = sizes.count()
    above = subroots.select(
        F.lit("").alias("source"), "position", F.lit(sources).cast("long").alias("nodes"), "digest",
        F.struct("source").alias("row"))
    upper = members(grown(above, fanout, depth)).select(
        F.col("row.source").alias("of"), "proof", "root", F.col("position").alias("source_position"))
    whole = runs.alias("r").join(saved(upper, "upper").alias("u"), F.col("r.source").eqNullSafe(F.col("u.of"))).select(
        "source", "first", "nodes", "digests", F.concat("witness", "proof").alias("witness"),
        F.struct(F.col("r.root").alias("subroot"), "u.root", "source_position").alias("root"), "rows")
    return members(whole).select(
        "row.*", F.col("digest").alias("leaf"), "proof", "root.subroot", "root.root", "position", "nodes",
        "root.source_position", F.lit(sources).cast("long").alias("sources"))


def folded(value: bytes, proof: bytes, places: Sequence[tuple[int, int]], fanout: int = 16) -> bytes:
    """Root that a leaf and the proof of its place lead to. ``places`` are (position, nodes) of the
    leaf in its source and of the source among the sources."""
    at = 0
    for position, nodes in places:
        while nodes > 1:
            own = position % fanout
            left = at + own * SIZE
            at, before = at + (min(fanout, nodes - position + own) - 1) * SIZE, at
            value = digest(proof[before:left] + value + proof[left:at])
            position, nodes = position // fanout, -(-nodes // fanout)
    return value


def audited(proofs: DataFrame, value: str, fanout: int = 16) -> DataFrame:
    """Rows of ``manifest`` with ``folded_root``, the root that the digest in column ``value`` leads to.
    A row's own leaf leads to ``root``; that of a changed document does not."""
    places = ["position", "nodes", "source_position", "sources"]

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (value, "proof", *places)]
            roots = [folded(v, p, ((i, n), (j, m)), fanout) for v, p, i, n, j, m in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(roots, pa.binary())], [*batch.schema.names, "folded_root"])

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema.fields]
    return proofs.mapInArrow(run, ", ".join([*names, "folded_root binary"]))
