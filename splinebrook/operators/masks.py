"""Brain masks from mean images: a threshold in the widest gap of values, opening, the largest component, holes filled.

Voxels are rows (x, y, z) of what is set. Cells touch along faces (six neighbours). Components are found block by block, in a
task for each block of the grid; only the different pairs of components that meet at the faces between blocks are joined, in
rounds that contract each to its least neighbour.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import voxel_index
from .permutation import numbered
from .scratch import Steps

BLOCK = 16
AXES = "xyz"
#: Rounds of contraction beyond which something must be wrong; about log(components) are needed.
ROUNDS = 60

Shape = tuple[int, int, int]


def gap_threshold(values: DataFrame, value: str = "m", lower: float = 0.2, upper: float = 0.85) -> float:
    """The middle of the widest gap between neighbouring values, between two shares of the sorted values; the first on ties."""
    steps = Steps(values.sparkSession, "sorted")
    placed = steps.save(numbered(values.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(value), [value], "place", steps))
    n = placed.count()
    first, last = int(np.floor(lower * n)), min(int(np.floor(upper * n)), n - 1)
    inside = placed.filter(F.col("place").between(first, last))
    after = inside.select((F.col("place") - 1).alias("place"), F.col(value).alias("next"))
    gap = inside.join(after, "place").agg(F.max_by(F.struct(value, "next"), F.struct(F.col("next") - F.col(value), -F.col("place"))).alias("g")).first()["g"]
    steps.forget(0)
    if gap is None:
        raise ValueError(f"{n} values have no gap between the shares {lower} and {upper}")
    return 0.5 * (gap[0] + gap[1])


def neighbours(with_itself: bool) -> Column:
    """The six cells that touch a cell, and perhaps the cell."""
    steps = [tuple(s if k == axis else 0 for k in range(3)) for axis in range(3) for s in (-1, 1)] + [(0, 0, 0)] * with_itself
    return F.explode(F.array(*[F.struct(*[(F.col(a) + s).alias(a) for a, s in zip(AXES, by, strict=True)]) for by in steps])).alias("c")


def inside(shape: Shape) -> Column:
    return (F.col("x").between(0, shape[0] - 1)) & (F.col("y").between(0, shape[1] - 1)) & (F.col("z").between(0, shape[2] - 1))


def dilated(mask: DataFrame, shape: Shape, times: int = 1) -> DataFrame:
    for _ in range(times):
        mask = mask.select(neighbours(True)).select("c.*").filter(inside(shape)).distinct()
    return mask


def eroded(mask: DataFrame, times: int = 1) -> DataFrame:
    """What all six neighbours of which are set; beyond the volume nothing is."""
    for _ in range(times):
        mask = mask.select(neighbours(True)).select("c.*").groupBy(*AXES).count().filter("count = 7").select(*AXES)
    return mask


def complement(mask: DataFrame, shape: Shape) -> DataFrame:
    nx, ny, nz = shape
    cells = mask.sparkSession.range(nx * ny * nz).select(F.floor(F.col("id") / (ny * nz)).cast("int").alias("x"), (F.floor(F.col("id") / nz) % ny).cast("int").alias("y"), (F.col("id") % nz).cast("int").alias("z"))
    return cells.join(mask, list(AXES), "left_anti")


def local_components(frame: pd.DataFrame, shape: Shape) -> np.ndarray:
    """For the voxels of one block the least index of each one's component within the block."""
    low = [int(frame[a].min()) for a in AXES]
    at = tuple(frame[a].to_numpy() - b for a, b in zip(AXES, low, strict=True))
    index = (frame["x"].to_numpy().astype(np.int64) * shape[1] + frame["y"].to_numpy()) * shape[2] + frame["z"].to_numpy()
    none = np.iinfo(np.int64).max
    grid = np.full([int(v.max()) + 3 for v in at], none)
    here = tuple(v + 1 for v in at)
    grid[here] = index
    while True:
        low_of = grid[here]
        for axis in range(3):
            for step in (-1, 1):
                low_of = np.minimum(low_of, grid[tuple(v + step * (k == axis) for k, v in enumerate(here))])
        if (low_of == grid[here]).all():
            return low_of
        grid[here] = low_of


def contracted(pairs: DataFrame, steps: Steps) -> DataFrame:
    """Rows (node, root) of all nodes of the links (a, b) that are not the least of their component."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = steps.save(both.filter("a <> b").distinct())
    roots = steps.save(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    for _ in range(ROUNDS):
        if links.isEmpty():
            return roots.filter("node <> root")
        parent = steps.save(links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("r"), F.least("a", "b").alias("p")))
        above = parent.select(F.col("r").alias("p"), F.col("p").alias("q"))
        parent = steps.save(parent.join(above, "p").select("r", F.col("q").alias("p")))  # a parent is never greater, so two steps are safe
        roots = steps.save(roots.join(parent, F.col("root") == F.col("r"), "left").select("node", F.coalesce("p", "root").alias("root")))
        a, b = (parent.select(F.col("r").alias(c), F.col("p").alias(f"{c}_root")) for c in "ab")
        links = steps.save(links.join(a, "a").join(b, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).filter("a <> b").distinct())
    raise RuntimeError("components did not settle")


def components(mask: DataFrame, shape: Shape) -> DataFrame:
    """mask's voxels with root, the least C-order index of each one's component."""
    steps = Steps(mask.sparkSession, "components")
    blocks = [F.floor(F.col(a) / BLOCK).alias(f"block_{a}") for a in AXES]
    dealt = mask.select(*[F.col(a).cast("int").alias(a) for a in AXES]).select(*AXES, *blocks)

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        return frame[list(AXES)].assign(root=local_components(frame, shape))

    placed = steps.save(dealt.groupBy(*[f"block_{a}" for a in AXES]).applyInPandas(label, "x int, y int, z int, root long"))
    faces = [placed.filter(F.col(a) % BLOCK == BLOCK - 1).select(*[(F.col(c) + int(c == a)).alias(c) for c in AXES], F.col("root").alias("a")) for a in AXES]
    touching = faces[0].unionByName(faces[1]).unionByName(faces[2]).join(placed.withColumnRenamed("root", "b"), list(AXES)).select("a", "b").distinct()
    joined = contracted(touching, steps)
    known = joined.select(F.col("node").alias("root"), F.col("root").alias("whole"))
    out = placed.join(known, "root", "left").select(*AXES, F.coalesce("whole", "root").alias("root"))
    found = steps.save(out)
    steps.forget()
    return found


def largest_component(mask: DataFrame, shape: Shape) -> DataFrame:
    """The component of most voxels; that with the least index on ties."""
    found = components(mask, shape)
    best = found.groupBy("root").count().agg(F.max_by("root", F.struct("count", -F.col("root"))).alias("root"))
    return found.join(F.broadcast(best), "root", "left_semi").select(*AXES)


def filled(mask: DataFrame, shape: Shape) -> DataFrame:
    """The mask with its holes: components of what is not set that do not reach the edge of the volume."""
    empty = components(complement(mask, shape), shape)
    edge = F.col("x").isin(0, shape[0] - 1) | F.col("y").isin(0, shape[1] - 1) | F.col("z").isin(0, shape[2] - 1)
    holes = empty.join(empty.filter(edge).select("root").distinct(), "root", "left_anti")
    return mask.select(*AXES).unionByName(holes.select(*AXES))


def epi_mask(means: DataFrame, shape: Shape, opening: int = 2, lower: float = 0.2, upper: float = 0.85, connected: bool = True, fill: bool = True) -> DataFrame:
    """means (x, y, z, m) of every cell -> the voxels (x, y, z) of the brain.

    Set is what is at least the gap's middle; it is eroded `opening` times, its largest component is kept, dilated twice as
    often and eroded again, and its holes are filled.
    """
    mask = means.filter(F.col("m") >= gap_threshold(means, "m", lower, upper)).select(*[F.col(a).cast("int").alias(a) for a in AXES])
    mask = eroded(mask, opening)
    if connected:
        mask = largest_component(mask, shape)
    mask = eroded(dilated(mask, shape, 2 * opening), opening)
    return filled(mask, shape) if fill else mask


def voxel_ids(mask: DataFrame, shape: Shape) -> DataFrame:
    return mask.select(*AXES, voxel_index(F.col("x"), F.col("y"), F.col("z"), shape[1], shape[2]).cast("long").alias("index"))
