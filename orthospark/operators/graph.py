"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthospark.sources.scratch import written


# Edges are (u, v) with u > v throughout. Both sides of a join grow with the graph, so they are merged at every size.
def _to_smallest_neighbour(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    return e.join(least.hint("merge"), F.col("v") == F.col("n")).select("u", F.col("m").alias("v")).distinct()


def _to_smallest_below(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
    return e.join(least.hint("merge"), "u").select(moved.alias("e")).select("e.*").where("u != v").distinct()


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """``(node, root)`` after a single contraction: nodes with one root are in one component, but a component
    may still have several roots."""
    return _to_smallest_below(_to_smallest_neighbour(_oriented(edges))).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for the nodes of ``edges(u, v)`` that aren't the smallest of their component. Rounds grow with
    the logarithm of the longest path, and two numbers a round come to the driver."""
    e, seen = written(_to_smallest_below(_to_smallest_neighbour(_oriented(edges))), "edges"), None
    while True:
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        e = written(_to_smallest_below(_to_smallest_neighbour(e)), "edges")
