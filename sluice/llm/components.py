"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node it can reach.

    Each round replaces a node's edges by edges to its smallest neighbour, so no
    node's neighbours are ever gathered in one place: minima are aggregated with
    map-side partial sums, and the joins that follow can be split when skewed.
    Rounds end when the edges stop changing; every round is a written table.
    Self loops and repeated edges are allowed; null ends are ignored.
    """
    edges = edges.toDF("a", "b").where("a is not null and b is not null")
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = scratch.keep(ordered, "edges"), None
    nodes = scratch.keep(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.toDF("a", "b")).distinct()
        after = scratch.keep(small, "edges")
        seen = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        scratch.drop(now)
        now = after
        if seen == mark:
            break
        mark = seen
    return nodes.join(now.toDF("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
