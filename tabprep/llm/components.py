"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import attach
from .scratch import Scratch


def star(edges: DataFrame, scratch: Scratch, large: bool) -> DataFrame:
    """Links the neighbours of each node that are larger (or else smaller, and the node) to the least of them all."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    sides = scratch.keep(down.union(down.select("v", "u")) if large else down)
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    met = attach(sides, scratch.keep(least), "u", "n", F.col("v"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (node, root) for the nodes of edges (a, b, long integers) other than roots; a root is its component's least node."""
    first = scratch.made
    now, before = scratch.keep(edges.where("a <> b").distinct()), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(state) == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(state)
        now = scratch.keep(star(scratch.keep(star(now, scratch, True)), scratch, False))
        scratch.forget(*range(first, scratch.made - 1))
        first = scratch.made - 1
