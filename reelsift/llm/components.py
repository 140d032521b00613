"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    edges: a, b. Each round joins nodes to the minimum of their neighbours,
    first those above a node, then those below. It ends when a round changes
    nothing. Minima are aggregated before they are joined, so no neighbour list
    is ever collected; each round is a written table.
    """
    a, b = F.col("a"), F.col("b")
    pairs = edges.where("a <> b").select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct()
    seen = None
    while True:
        pairs = written(pairs, "edges")
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return pairs.select(F.col("v").alias("node"), F.col("u").alias("component"))
        seen = state
        both = pairs.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(pairs.select(F.col("u").alias("x"), F.col("v").alias("y")))
        lowest = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(lowest, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
        pairs = small.unionByName(least.select("v", F.col("m").alias("u"))).distinct()
