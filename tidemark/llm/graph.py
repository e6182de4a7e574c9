"""Connected components of links, by alternating large-star and small-star steps on tables.

Each step lets every node point its neighbours to the smallest one; stars remain in a number of rounds that
grows with the logarithm of the longest path. Nothing is collected; each round is a written table, so a
lost executor costs one round at most. Hubs with many neighbours are spread over tasks (``common.attach``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (a, b), a > b. Links each node's greater (or smaller) neighbours to its smallest one."""
    if large:  # over all neighbours
        arcs = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        arcs = edges.select("a", "b")
    least = arcs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    spread = F.concat(F.encode(F.lit("node "), "UTF-8"), F.col("b"))
    out = attach(arcs, least, "a", "n", spread)
    if large:
        out = out.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of the links ``a, b`` (binary) but the roots; the root is the smallest of its component."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links", light=True)
    before = None
    while True:  # links that change make components' roots smaller, so this ends
        now = written(_star(written(_star(now, True), "large-star", light=True), False), "small-star", light=True)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
