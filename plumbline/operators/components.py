"""Connected components of an edge list by alternating large and small stars.

Every round is two shuffled aggregations and two equi-joins over the edge
list; nothing is collected, and each round's edges are written to the shared
scratch folder so that lineage stays flat.  The minimum per node is combined
map-side, so a hub with many neighbours is no hot reducer; the joins are plain
equi-joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.scratch import materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100, shuffled: bool = False) -> DataFrame:
    """``(node, component)`` for every node that has an edge; the component is
    its smallest node.  Self-loops, repeats, either direction and nulls are
    allowed: null ends are ignored, a node with nothing but self-loops is left
    out, an empty input gives an empty table.  If ``shuffled``, no round sends a
    small side to the driver to broadcast it: for those who call this in rounds."""
    a, b = F.col(src), F.col(dst)
    stars = materialise(
        edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(),
        "edges",
    )
    seen = _mark(stars)
    for _ in range(max_rounds):
        stars = materialise(_small_star(_large_star(stars, shuffled), shuffled), "stars")
        mark = _mark(stars)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = stars.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def _mark(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def _joinable(least: DataFrame, shuffled: bool) -> DataFrame:
    return least.hint("merge") if shuffled else least


def _large_star(stars: DataFrame, shuffled: bool) -> DataFrame:
    both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(_joinable(least, shuffled), "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(stars: DataFrame, shuffled: bool) -> DataFrame:
    least = stars.groupBy("hi").agg(F.min("lo").alias("m"))
    joined = stars.join(_joinable(least, shuffled), "hi")
    moved = joined.filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
