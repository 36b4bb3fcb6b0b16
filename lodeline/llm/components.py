"""Connected components of an edge table by alternating large-star and small-star contraction.

Each round is two joins on the node and removes nothing from the result; rounds end when the edges no longer change. All
edges stay on the executors: the driver sees one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm._batches import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.join(least, both.u == least.w).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # edges are (a, b) with a < b: the smaller neighbours of b are its a's
    least = edges.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("w"), "m")
    joined = edges.join(least, edges.b == least.w)
    return joined.select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), F.col("w").alias("b"))).where("a < b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the ends of `edges(a, b)`, a < b; component is the smallest node that can be reached.

    No edges: no rows. Raises if `rounds` do not suffice (each round at least contracts every star, so that takes
    chains far beyond 2**rounds nodes).
    """
    last = None
    for _ in range(rounds):
        edges = cut(_small_star(_large_star(edges)))
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last or not state[0]:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
