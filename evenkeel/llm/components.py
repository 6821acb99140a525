"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.session import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of ``edges`` (two long columns, no nulls); root is the least node.

    Each round links every neighbour to the least one it knows of, first
    among larger neighbours, then among smaller ones; the number of edges
    never grows, minima are taken by partial aggregation, and every round
    is a written table. The minima are written before they are joined back,
    so that the join has exchanges of its own and AQE can split the edges
    of a hub. Ends when a round changes nothing.
    """
    def fingerprint(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())

    forward = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    state = written(forward.distinct(), "edges")
    before = fingerprint(state)
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("w"), F.least("u", "m").alias("m")), "minima")
        large = (both.join(least, F.col("u") == F.col("w")).where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = written(large, "large")
        small = written(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        moved = (large.join(small.select(F.col("u").alias("w"), "m"), F.col("u") == F.col("w"))
                 .where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")))
        state = written(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = fingerprint(state)
        if after == before:
            break
        before = after
    roots = state.select("v").distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def spanning_forest(link: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (x, y) of positions: a spanning forest of a symmetric boolean matrix."""
    forest, seen = [], np.zeros(len(link), bool)
    for start in np.flatnonzero(link.any(axis=1)).tolist():
        if seen[start]:
            continue
        seen[start] = True
        todo = [start]
        while todo:
            x = todo.pop()
            more = np.flatnonzero(link[x] & ~seen).tolist()
            seen[more] = True
            forest += [(x, y) for y in more]
            todo += more
    return forest
