"""Connected components of a graph of 64-bit nodes, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowsift.session import materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame, far_end: Column, stay: Column) -> DataFrame:
    """Link the neighbours of each node to the smallest of them and itself.

    ``links`` holds (a: centre, b: neighbour). The minimum is combined per task before it is shuffled, and a node with a
    third of all links is a plain join key, which Spark splits when its rows weigh too much.
    """
    least = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    pulled = links.join(least, "a").filter(far_end).select("low", "b")
    centres = least.filter(stay).select("low", F.col("a").alias("b"))
    return pulled.union(centres).filter("low != b").select(F.col("low").alias("a"), "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the root is the smallest node that can be reached.

    Each round hangs the larger neighbours of every node to its smallest neighbour (large star), then the smaller ones and
    itself (small star). Rounds end when the links no longer change; a chain of n nodes takes about log n of
    them. Every round is stored in the shared folder, so a lost executor costs a part of one round. Loops and repeated
    links do no harm; no link at all gives no row.
    """
    links = materialise(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        large = _star(_both_ways(links), F.col("b") > F.col("a"), F.lit(False))
        downward = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        links = materialise(_star(downward, F.lit(True), F.lit(True)), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = links.select("a").distinct()
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots.select(F.col("a").alias("node"), F.col("a").alias("root")))
