"""Connected components by contraction of the graph, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm._store import stage


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (src, dst: long), component the smallest node reachable.

    Each round hooks every node to the smallest of its neighbours, follows that
    pointer once more and contracts the links; the number of links between
    different nodes shrinks to none in a number of rounds that grows with the
    logarithm of the longest path. Minima are pre-aggregated before their
    shuffle, so a node with very many links is no single task's work. An empty
    input gives an empty result; self-links and repeated links change nothing.
    """
    links = links.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null")
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    edges = stage(links.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    labels = nodes.select("node", F.col("node").alias("component"))
    while not edges.isEmpty():
        both = edges.union(edges.select("dst", "src"))
        hook = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("up"))
        hook = stage(hook, "hook")
        twice = hook.join(hook.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", "top")
        twice = stage(twice, "twice")
        low = twice.select(F.col("node").alias("component"), "top")
        labels = stage(labels.join(low, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "labels")
        a, b = twice.toDF("src", "s"), twice.toDF("dst", "d")
        moved = edges.join(a, "src").join(b, "dst").where("s <> d")
        edges = stage(moved.select(F.greatest("s", "d").alias("src"), F.least("s", "d").alias("dst")).distinct(), "edges")
    return labels
