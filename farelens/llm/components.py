"""Connected components by alternating stars.

A node that many others hang on is no key of a large task: what its neighbours must be told is one row,
which ``left_lookup`` broadcasts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farelens.llm.common import store
from farelens.operators.joins import left_lookup


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to its least neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    return left_lookup(both, least, "a", F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    others = left_lookup(down, least, "a", F.col("n")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node has one larger-to-smaller edge at most, and none that leads on."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b: long); the component is its least node.

    Every round writes the remaining edges to the shared scratch folder; the last leaves stars. A
    graph that is not stars after ``rounds`` rounds, far more than its size can ask for, is an error.
    """
    state = store(edges.filter("a <> b").select("a", "b"), "edges")
    for _ in range(rounds):
        state = store(_small_star(_large_star(state)), "stars")
        if _only_stars(state):
            roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    raise RuntimeError(f"components are not settled after {rounds} rounds")
