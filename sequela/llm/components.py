"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequela.sources.stages import stage


def components(links: DataFrame) -> DataFrame:
    """A row per linked node: node, label, the smallest node of its component.

    ``links``: a, b (whole numbers). Large-star and small-star steps in turn: each node's larger
    neighbours, then its smaller ones, are linked to the smallest node next to it, until nothing
    changes. No step needs a component, or a node's neighbours, in one task: minima are combined
    before the shuffle and the links meet them in a join. Each step is written out, which cuts the
    lineage. Links of a node with itself make it a component of its own.
    """
    both = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    nodes = stage(links.select(F.col("a").alias("node")).union(links.select("b")).distinct(), "nodes")
    edges = stage(both.filter("u > v"), "edges")
    before = None
    while True:
        edges = stage(_small_star(_large_star(edges)), "edges")
        # u is linked to one smaller node, a root, once nothing changes
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == before:
            break
        before = now
    labels = edges.groupBy("u").agg(F.min("v").alias("label"))
    return nodes.join(labels, nodes["node"] == labels["u"], "left").select("node", F.coalesce("label", "node").alias("label"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to its smallest neighbour, or to itself if it is smaller."""
    ways = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = ways.join(least, "u").filter("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return moved.filter("u > v").distinct()
