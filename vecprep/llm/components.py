"""Connected components of a distributed edge list, by alternating stars (Kiveris et al., 2014).

Every round links each node's larger neighbours to its smallest neighbour (large star), then its smaller neighbours and
itself to the smallest of them (small star), until the edges are stars around each component's least node. Each round
is a table in the shared folder; no edge reaches the driver. Minima are aggregated before the shuffle and joined back,
so a node with very many neighbours can be split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, materialise


def _with_least(edges: DataFrame, least: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with ``m``, what ``least`` has for their node u; and that table, which is written so that a node with very many
    edges can be split over tasks in the join."""
    least = materialise(least.select(F.col("u").alias("k"), "m"), "least")
    return edges.join(least, F.col("u") == F.col("k")), least


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined, least = _with_least(both.filter("v > u"), both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` lead from a node to a smaller one."""
    joined, least = _with_least(edges, edges.groupBy("u").agg(F.min("v").alias("m")))
    return joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")), least


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (least node of the component) for every node with an edge to another one."""
    rows = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u > v").distinct()
    current, before = materialise(rows, "edges"), None
    while not current.isEmpty():
        large, one = _large_star(current)
        large = materialise(large.filter("u > v").distinct(), "edges")
        small, other = _small_star(large)
        following = materialise(small.filter("u > v").distinct(), "edges")
        for done in (current, one, large, other):
            drop(done)
        current = following
        mark = tuple(current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).collect()[0])
        if mark == before:
            break
        before = mark
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
