"""Mixing sources to target weights by capped water-filling.

Every source gets words in proportion to its weight until it would be repeated more
often than allowed. Such a source is clamped and its excess goes to the others, again
by weight, until no source is above its cap. Whole repetitions take all documents of a
source; the rest takes documents in a seeded order up to the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from acequia.llm.shared import saved

#: A source's documents are dealt to so many ranges of the seeded order; only the range
#: in which its target falls is ordered document by document.
RANGES = 12


def _order(seed: int, of: str = "") -> Column:
    """Place of a document in its source's seeded order, 0 to 2**63 - 1."""
    return F.xxhash64(F.lit(seed), F.col(f"{of}doc_id"), F.col(f"{of}source")).bitwiseAND((1 << 63) - 1)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Sources with ``rank`` from 0 by code point, null last; each task numbers a range of names."""
    split = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    split = saved(split.withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    sizes = split.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("start"))  # one row per task
    return split.join(starts, part == F.col("part")).select(
        *sources.columns, (F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank"))


def water_level(sources: DataFrame, budget: float, max_epochs: float) -> float:
    """Words for each unit of weight, once every source above its cap is clamped to it.

    Only sums reach the driver. The level rises with every round, so the clamped sources of a
    round stay clamped; there are as many rounds as times that a reshare lifts a source too far.
    """
    cap, level, clamped = F.col("source_size") * max_epochs, 0.0, -1
    while True:
        above = cap < level * F.col("weight")
        row = sources.agg(
            F.sum(F.when(~above, F.col("weight"))).alias("weight"),
            F.sum(F.when(above, cap)).alias("words"),
            F.count(F.when(above, 1)).alias("n")).first()
        if row.n == clamped or not row.weight:
            return level
        level, clamped = (budget - (row.words or 0.0)) / row.weight, row.n


def plan(measured: DataFrame, weights: Sequence[float], share: float, max_epochs: float, seed: int) -> DataFrame:
    """One row per source: ``source_size``, ``weight``, ``target``, ``whole`` repetitions, and
    ``cutoff``: documents up to it in the seeded order are taken once more."""
    sized = ranked(measured.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = saved(sized.withColumn("weight", weight), "weighted")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, total * share, max_epochs)
    target = F.least(F.col("source_size") * max_epochs, F.col("weight") * level)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = sources.withColumn("target", target).withColumn("whole", whole.cast("long")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = saved(targets, "targets")

    range_ = F.shiftright("place", 63 - RANGES).alias("range")
    sums = measured.groupBy("source", range_).agg(F.sum("size").alias("words"))
    along = Window.partitionBy("source").orderBy("range")
    sums = sums.withColumn("before", F.sum("words").over(along) - F.col("words"))
    reached = sums.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).where(
        (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    last = saved(reached.select("r.source", "range", (F.col("rest") - F.col("before")).alias("left")), "last-ranges")
    inside = measured.alias("m").join(
        last.alias("l"), F.col("m.source").eqNullSafe(F.col("l.source")) & (F.shiftright("m.place", 63 - RANGES) == F.col("l.range")))
    order = Window.partitionBy("l.source").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.sum("size").over(order))
    # A document is taken if that brings the sum nearer to the target.
    near = F.col("upto") - F.col("size") / 2 <= F.col("left")
    cut = inside.groupBy("l.source", "range").agg(F.max(F.when(near, F.col("place"))).alias("taken"))
    cutoff = F.coalesce(F.col("taken"), F.shiftleft(F.col("range"), 63 - RANGES) - 1)
    none_left = F.when(F.col("t.rest") > 0, (1 << 63) - 1).otherwise(-1)
    return saved(targets.alias("t").join(cut.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").select(
        "t.source", "source_size", "weight", "target", "whole",
        F.coalesce(F.when(F.col("c.range").isNotNull(), cutoff), none_left).alias("cutoff")), "mix-plan")


def _with_times(rows: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """Rows as ``d`` with the plan of their source as ``p`` and how often each is taken as ``acequia_times``."""
    place = _order(seed, "d.")
    times = F.col("p.whole") + F.when(place <= F.col("p.cutoff"), 1).otherwise(0)
    joined = rows.alias("d").join(planned.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    return joined.withColumn("acequia_times", times)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
        max_epochs: float = 2, seed: int = 20) -> DataFrame:
    """How many words of each document a mix takes.

    Reads ``doc_id``, ``source`` and ``text``. Returns one row per row of ``docs``: ``doc_id``,
    ``size`` (words), ``source_size``, ``target`` (words of its source), ``taken`` (words taken,
    repeats counted). Sources in order of code points, null last and a source like any other, get
    the ``weights`` in turn; all targets add up to ``share`` of all words; a source stops at
    ``max_epochs`` times its words. A null or empty text has size 0. Rows with one ``doc_id`` and
    source are taken alike, the seed fixes all choices, and an empty table gives no rows.
    """
    measured = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _order(seed).alias("place")), "sizes")
    rows = _with_times(measured, plan(measured, weights, share, max_epochs, seed), seed)
    return rows.select("d.doc_id", "d.size", "p.source_size", "p.target", (F.col("d.size") * F.col("acequia_times")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
                    max_epochs: float = 2, seed: int = 20) -> DataFrame:
    """The documents of the mix with all their columns, each as often as ``mix`` takes it."""
    measured = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _order(seed).alias("place")), "sizes")
    rows = _with_times(docs, plan(measured, weights, share, max_epochs, seed), seed)
    own = [F.col(f"d.{c}").alias(c) for c in docs.columns]
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("acequia_times"))).alias("acequia_time")
    return rows.where(F.col("acequia_times") > 0).select(*own, again).drop("acequia_time")
