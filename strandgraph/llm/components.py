"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.store import discard, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: every larger neighbour of a node is linked with the node's least neighbour; else every
    smaller one is, and the node itself."""
    ways = _both_ways(edges)
    if not large:
        ways = ways.filter(F.col("b") < F.col("a"))
    least = ways.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    linked = ways.join(least, "a")
    if large:
        out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From edges(a, b) to labels(node, component), component being the least node that is reachable.

    Each round turns trees into flatter ones (large star, then small star) and is written to the shared
    folder; rounds grow with the logarithm of the longest chain. No node's neighbours are ever gathered
    in one row. Nodes without an edge have no row. Loops and repeated edges don't matter.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        before, now = now, written(_star(_star(now, True), False), "edges")
        discard(before)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    labels = now.groupBy("a").agg(F.min("b").alias("component"))
    roots = labels.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    return labels.select(F.col("a").alias("node"), "component").union(roots)
