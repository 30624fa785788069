"""Connected components by alternating large-star and small-star contraction.

Each step is a grouped minimum (map-side combined) and an equi-join with it; the number of steps grows
with the logarithm of the longest chain. The minima of hubs are broadcast, so the edges of a hub are
never brought together: a hub has more than 2 * edges / ``HUBS`` edges, so there are at most ``HUBS`` of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgraph.plans.tables import Scratch

HUBS, LEAST_HUB = 50_000, 256


def _star(edges: DataFrame, large: bool, hub: int) -> DataFrame:
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # The smallest of each node and its neighbours.
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    hubs = least.where(F.col("n") > hub).select(F.col("u").alias("h"), F.col("m").alias("hm"))
    met = both.join(F.broadcast(hubs), F.col("u") == F.col("h"), "left")
    cold = met.where("h is null").select("u", "v").join(least.where(F.col("n") <= hub).select("u", "m"), "u")
    joined = cold.unionAll(met.where("h is not null").select("u", "v", F.col("hm").alias("m")))
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and that one none."""
    below = edges.groupBy("u").agg(F.count("*").alias("n"))
    centres = edges.select(F.col("v").alias("w")).distinct()
    passed = below.join(centres, F.col("u") == F.col("w"), "left_semi")
    return below.where("n > 1").select("u").unionAll(passed.select("u")).isEmpty()


def connected_components(
    edges: DataFrame, scratch: Scratch, src: Column | str = "a", dst: Column | str = "b", max_steps: int = 100
) -> DataFrame:
    """(id, component) for every end of an edge; ``component`` is the smallest id reachable.

    Edges are undirected; loops, repeats and nulls are allowed (a null end drops the edge, a
    loop gives its node a component of its own). Ids may be of any orderable type.
    """
    src, dst = (F.col(c) if isinstance(c, str) else c for c in (src, dst))
    first = edges.select(src.alias("u"), dst.alias("v")).where("u is not null and v is not null")
    first, first_at = scratch.keep_at(first, "edges")
    nodes = first.select("u").unionAll(first.select("v")).distinct()
    current = first.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, at = scratch.keep_at(current, "star")
    # No step makes more edges than it gets.
    hub = max(LEAST_HUB, 2 * current.count() // HUBS)
    for _ in range(max_steps):
        if _is_stars(current):
            break
        step, step_at = scratch.keep_at(_star(_star(current, True, hub), False, hub), "star")
        scratch.drop(at)
        current, at = step, step_at
    else:
        raise RuntimeError(f"components did not settle in {max_steps} steps")
    return nodes.join(current, "u", "left").select(F.col("u").alias("id"), F.coalesce("v", "u").alias("component"))
