"""Connected components of a link table, on the cluster and within one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Rounds beyond which something must be wrong; the method needs about log(n) of them.
MAX_ROUNDS = 60


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with the given links: the smallest node of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            return root
        root = new


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for all nodes with a link but the roots themselves; root is the smallest node of the component.

    edges: columns (a, b), in any direction, repeats and self-links allowed; null ends are dropped. Alternates the large
    star (each larger neighbour moves to the least neighbour) and the small star (each smaller one does) until nothing
    changes. Minima are pre-aggregated; each round is checkpointed.
    """
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    ends = checkpoint(ends)
    before = _digest(ends)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        ends = checkpoint(small.select("e.u", "e.v").filter("u > v").distinct())
        after = _digest(ends)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return ends.select(F.col("u").alias("node"), F.col("v").alias("root"))
