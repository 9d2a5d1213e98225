"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from acequia.llm.shared import saved


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (its component's smallest node) for all ends of ``links`` (a, b).

    In each round every label takes the smallest of its neighbours above it, then that one's own, so
    chains shorten fast; then links are renamed to the new labels, and those within one label or
    equal to another go. So the links of a round are a fraction of those before. Every round is a
    table in the shared folder; the driver only learns whether links are left. Minima are taken before
    each shuffle, so a node with very many links does not weigh on one task.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    edges = saved(both, "links")
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    while not edges.isEmpty():
        up = edges.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("up"))
        for _ in range(2):
            up = saved(up, "up")
            further = up.select(F.col("a").alias("via"), F.col("up").alias("further"))
            up = up.join(further, F.col("up") == F.col("via")).select("a", F.col("further").alias("up"))
        up = saved(up, "up")
        labels = labels.join(up, F.col("label") == F.col("a"), "left").select(
            "node", F.coalesce("up", "label").alias("label"))
        labels = saved(labels, "labels")
        ends = up.select(F.col("a").alias("b"), F.col("up").alias("b_up"))
        edges = edges.join(up, "a").join(ends, "b").select(F.col("up").alias("a"), F.col("b_up").alias("b"))
        edges = saved(edges.where("a <> b").distinct(), "links")
    return labels


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links between nodes, which may or may not have one yet."""
    own = labels.select(F.col("node").alias("n"), F.col("label").alias("l"))
    ends = links
    for c in ("a", "b"):
        ends = ends.join(own, F.col(c) == F.col("n"), "left").withColumn(c, F.coalesce("l", c)).drop("n", "l")
    merged = components(ends.where("a <> b")).select(F.col("node").alias("old"), F.col("label").alias("new"))
    known = labels.join(merged, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
    fresh = merged.select(F.col("old").alias("node"), F.col("new").alias("label")).join(labels.select("node"), "node", "left_anti")
    return saved(known.unionByName(fresh), "labels")
