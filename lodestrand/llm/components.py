"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _small_star(edges: DataFrame) -> DataFrame:
    """edges (u, v), v < u: every neighbour below u, and u, hang on the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(moved).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """edges (u, v), v < u: every neighbour above a node hangs on the smallest in its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges`` but the roots themselves; root is the smallest node reachable.

    Rounds alternate a large-star and a small-star step until the edge table stays the same; each round is one written
    table, and only its row count and checksum reach the driver. Self loops and null ends are ignored; no edges give an
    empty result.
    """
    state = written(
        edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    sign = None
    while True:
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == sign or now[0] == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        sign, state = tuple(now), written(_small_star(_large_star(state)), "edges")
