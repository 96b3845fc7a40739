"""Preprocessing of images whose voxels are rows: Gaussian smoothing, confounds from a table, standard scores.

Smoothing cuts the grid into blocks. A voxel is sent to its own block and, as a halo, to those whose cells it reaches, so one
shuffle is enough whatever the kernel; a task smooths one block at a time, axis by axis, all volumes at once. Beyond the
volume its cells are mirrored, the edge cell included. Cells without a row count as zeros.

Confounds are regressed out image by image: an image's voxels are dealt into parts, and each part meets the image's confound
rows, so that nothing of the size of voxels times confounds is stored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timeseries import band_pass, clean

#: Cells along each axis of a block, and parts of an image's voxels.
BLOCK, PARTS = 16, 32
FWHM_OF_SIGMA = 2.0 * np.sqrt(2.0 * np.log(2.0))
#: Deviations after which a kernel ends.
TRUNCATE = 4.0
AXES = "xyz"


def voxel_sizes(affine: np.ndarray) -> np.ndarray:
    """Lengths of the axes' steps."""
    return np.sqrt((np.asarray(affine, dtype=float)[:3, :3] ** 2).sum(axis=0))


def kernel(sigma: float) -> np.ndarray:
    """Weights of a Gaussian, 4 deviations to either side, adding up to 1."""
    radius = int(TRUNCATE * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2) if sigma > 0 else np.ones(1)
    return w / w.sum()


def mirrored(at: np.ndarray, n: int) -> np.ndarray:
    """Cells of a volume for cells beyond it: d c b a | a b c d | d c b a."""
    at = np.mod(at, 2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


def gaussian_smooth(voxels: DataFrame, shape: tuple[int, int, int], affine: np.ndarray, fwhm: float = 6.0, keys: Sequence[str] = (), column: str = "values") -> DataFrame:
    """voxels (*keys, x, y, z, column array<double>), at most a row for each cell -> the same rows, smoothed.

    The kernel's width in mm follows each axis' voxel size. Series of one image are equally long.
    """
    kernels = [kernel(fwhm / FWHM_OF_SIGMA / s) for s in voxel_sizes(affine)]
    radii = [len(k) // 2 for k in kernels]
    sent = voxels.select(*keys, *AXES, F.col(column).alias("series"))
    for axis, n, r in zip(AXES, shape, radii, strict=True):
        # mirrored cells lie within a kernel's width of the edge, so a block never needs more than this halo
        first, last = F.greatest(F.col(axis) - r, F.lit(0)), F.least(F.col(axis) + r, F.lit(n - 1))
        blocks = F.sequence(F.floor(first / BLOCK).cast("int"), F.floor(last / BLOCK).cast("int"))
        sent = sent.withColumn(f"block_{axis}", F.explode(blocks))
    own = [F.floor(F.col(a) / BLOCK) == F.col(f"block_{a}") for a in AXES]
    sent = sent.withColumn("own", own[0] & own[1] & own[2])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in voxels.select(*keys, *AXES).schema)

    def smooth(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame["own"].to_numpy()
        if not own.any():
            return frame[[*keys, *AXES]].iloc[:0].assign(series=pd.Series([], dtype=object))
        low = [int(frame[f"block_{a}"].iloc[0]) * BLOCK for a in AXES]
        high = [min(b + BLOCK, n) for b, n in zip(low, shape, strict=True)]
        begin = [max(b - r, 0) for b, r in zip(low, radii, strict=True)]
        end = [min(b + r, n) for b, r, n in zip(high, radii, shape, strict=True)]
        values = np.array(frame["series"].tolist())
        at = [frame[a].to_numpy() - b for a, b in zip(AXES, begin, strict=True)]
        grid = np.zeros((*(e - b for b, e in zip(begin, end, strict=True)), values.shape[1]))
        grid[tuple(at)] = values
        for axis in range(3):
            cells = mirrored(np.arange(low[axis] - radii[axis], high[axis] + radii[axis]), shape[axis]) - begin[axis]
            wide = np.take(grid, cells, axis=axis)
            n = high[axis] - low[axis]
            grid = sum(w * np.take(wide, np.arange(k, k + n), axis=axis) for k, w in enumerate(kernels[axis]))
        places = [frame[a].to_numpy()[own] - b for a, b in zip(AXES, low, strict=True)]
        return frame.loc[own, [*keys, *AXES]].assign(series=list(grid[tuple(places)]))

    by = [*keys, *[f"block_{a}" for a in AXES]]
    return sent.groupBy(*by).applyInPandas(smooth, f"{fields}, series array<double>").withColumnRenamed("series", column)


def cleaned(voxels: DataFrame, confounds: DataFrame, keys: Sequence[str], tr: float, band: tuple[float, float] | None = None, order: int = 5, standardise: bool = True, column: str = "y") -> DataFrame:
    """voxels (*keys, ..., column) without what their image's confounds (*keys, t, values array<double>) explain, standardised by
    the sample deviation. With a band, series and confounds are filtered first, so that nothing filtered out comes back.

    Images without confounds are only centred (and filtered); a null or missing value of a confound counts as its mean.
    """
    salted = voxels.withColumn("part", F.pmod(F.xxhash64(*[c for c in voxels.columns if c != column]), F.lit(PARTS)).cast("int"))
    every = confounds.select(*keys, "t", "values", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))

    def step(frame: pd.DataFrame, design: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return frame.drop(columns="part")
        x, c = np.array(frame[column].tolist()), None
        if len(design):
            c = np.array(design.sort_values("t")["values"].tolist(), dtype=float)
            c = np.where(np.isnan(c), np.nanmean(c, axis=0), c)
        if band is not None:
            x = band_pass(x, *band, tr, order)
            c = band_pass(c.T, *band, tr, order).T if c is not None else None
        return frame.drop(columns="part").assign(**{column: list(clean(x, c, standardise))})

    by = [*keys, "part"]
    return salted.groupBy(*by).cogroup(every.groupBy(*by)).applyInPandas(step, voxels.schema)
