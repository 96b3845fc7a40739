"""Time-series operators: smoothing, filters, regressors, lag search, combination of components, peaks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import pearson, sparse_peak, voxel_index
from .fpca import as_lists, map_series


#: Samples of a series at most whose runs are all looked at in one pass, and series that are multiplied with them together.
SHORT, SERIES = 64, 2048


def box_smooth(voxels: DataFrame, shape: tuple[int, int, int], size: int = 3) -> DataFrame:
    """voxels: x, y, z, t, value on a full grid -> the mean over a cube of `size`, edges repeated (nearest).

    Each value is sent to the cells that see it, with the number of times they do; no self-join.
    """
    half = size // 2
    up = size - 1 - half
    out = voxels
    for axis, n in zip("xyz", shape, strict=True):
        spread = out.withColumn("cell", F.explode(seeing_cells(F.col(axis), n, half, up))).drop(axis).withColumnRenamed("cell", axis)
        out = spread.groupBy("x", "y", "z", "t").agg((F.sum("value") / size).alias("value"))
    return out


def seeing_cells(cell: Column, n: int, half: int, up: int) -> Column:
    """The cells along an axis whose window [-half, up] has `cell` in it, an edge cell as often as it is repeated."""
    inside = F.filter(F.sequence(cell - up, cell + half), lambda c: (c >= 0) & (c < n))
    low = [c for k in range(1, half + 1) for c in range(half - k + 1) if c < n]
    high = [n - 1 - c for k in range(1, up + 1) for c in range(up - k + 1) if c < n]
    none = F.array().cast("array<int>")
    listed = lambda cells: F.array(*[F.lit(c) for c in cells]) if cells else none
    return F.concat(inside.cast("array<int>"), F.when(cell == 0, listed(low)).otherwise(none), F.when(cell == n - 1, listed(high)).otherwise(none))


def boxcar(t: Column, start: Column | float, duration: Column | float) -> Column:
    """1 from start to start + duration, both ends included, else 0."""
    start, duration = (x if isinstance(x, Column) else F.lit(float(x)) for x in (start, duration))
    return F.when((t >= start) & (t <= start + duration), 1.0).otherwise(0.0)


def stimulus_correlation(series: DataFrame, regressor: list[float], column: str = "y") -> DataFrame:
    """Adds abs_r, the absolute correlation with the regressor; null where either is constant."""
    r = F.array(*[F.lit(float(v)) for v in regressor])
    return series.withColumn("abs_r", F.abs(pearson(F.col(column), r)))


def regressor_values(times: np.ndarray, stimuli: list[tuple[float, float]]) -> list[float]:
    """The union of boxcars (start, duration) at the times."""
    return [float(any(s <= t <= s + d for s, d in stimuli)) for t in times]


def lag_grid(series: DataFrame, event: float, lags: list[float], durations: list[float], step: float = 1.0, column: str = "y") -> DataFrame:
    """Rows (lag, duration, mean_abs_r): the mean absolute correlation over all series for each candidate boxcar.

    A boxcar is a run of samples, so a correlation needs sums over runs only: the candidates are columns of one pass.
    """
    size = series.select(F.size(column)).first()
    n = size[0] if size else 0
    t = np.arange(n) * step
    rows = []
    for lag in lags:
        for d in durations:
            rows.append((float(lag), float(d), [float(event + lag <= x <= event + lag + d) for x in t]))
    spark = series.sparkSession
    candidates = spark.createDataFrame(rows, "lag double, duration double, reg array<double>")
    # the candidates are few; each meets every series
    r = series.select(column).crossJoin(F.broadcast(candidates)).select("lag", "duration", F.abs(pearson(F.col(column), F.col("reg"))).alias("r"))
    return r.groupBy("lag", "duration").agg(F.avg("r").alias("mean_abs_r"))


def run_values(series: DataFrame, runs: list[tuple[bool, ...]], column: str = "y") -> list[float | None]:
    """The mean absolute correlation over all series with each of the 0/1 regressors, in one pass."""
    rows = [(k, [float(v) for v in run]) for k, run in enumerate(runs)]
    candidates = series.sparkSession.createDataFrame(rows, "k int, reg array<double>")
    r = series.select(column).crossJoin(F.broadcast(candidates)).select("k", F.abs(pearson(F.col(column), F.col("reg"))).alias("r"))
    found = {x["k"]: x["v"] for x in r.groupBy("k").agg(F.avg("r").alias("v")).collect()}
    return [found.get(k) for k in range(len(runs))]


def all_run_values(series: DataFrame, n: int, column: str = "y") -> dict[tuple[int, int], float]:
    """run_values of every run of n samples by (first, length); runs of all samples have no correlation. A batch's correlations are
    one product with the runs, and a task hands on their sums and counts."""
    runs = [(first, length) for length in range(1, n) for first in range(n - length + 1)]
    if not runs:
        return {}

    def add(batches):
        total, known = np.zeros(len(runs)), 0
        r = np.zeros((len(runs), n))
        for k, (first, length) in enumerate(runs):
            r[k, first : first + length] = 1
        r -= r.mean(axis=1, keepdims=True)
        r /= np.sqrt((r * r).sum(axis=1, keepdims=True))
        for batch in batches:
            y = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n)
            for at in range(0, len(y), SERIES):
                off = y[at : at + SERIES] - y[at : at + SERIES].mean(axis=1, keepdims=True)
                length = np.sqrt((off * off).sum(axis=1))
                varies = length != 0
                off = off[varies] / length[varies, None]
                total += np.abs(off @ r.T).sum(axis=0)
                known += len(off)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(runs), dtype=np.int32)), pa.array(total), pa.array(np.full(len(runs), known))], ["k", "total", "known"])

    whole = series.select(F.col(column).cast("array<double>").alias("y")).filter((F.size("y") == n) & ~F.exists("y", lambda v: v.isNull()))
    sums = whole.mapInArrow(add, "k int, total double, known long")
    found = sums.groupBy("k").agg((F.sum("total") / F.nullif(F.sum("known"), F.lit(0))).alias("v")).collect()  # a row a run
    return {runs[x["k"]]: x["v"] for x in found}


def climb(values_of, n: int, event: float, lags: list[float], durations: list[float], fine: float = 0.01, step: float = 1.0, rounds: int = 10_000) -> tuple[float, float, float]:
    """Best lag with duration 1, then best duration, then hill-climbing in steps of `fine` until no neighbour is better.

    values_of(runs) gives the value of each boxcar, seen as the run of the n samples that it covers, or None. Candidates
    without a correlation (a constant regressor) count as missing. All candidates with one run have one value, which is
    worked out once; a neighbour is the next candidate with another run in each of the eight directions, so that the climb
    doesn't end on the first plateau where `fine` is smaller than the sampling step. The value rises with every move and
    there are finitely many runs, so the climb ends; beyond `rounds` moves it raises.
    """
    values: dict[tuple[bool, ...], float | None] = {}
    t = np.arange(n) * step

    def run_of(lag: float, d: float) -> tuple[bool, ...]:
        return tuple(bool(v) for v in (t >= event + lag - 1e-9) & (t <= event + lag + d + 1e-9))

    def best(candidates: list[tuple[float, float]]) -> tuple[float, float, float]:
        runs = [run_of(lag, d) for lag, d in candidates]
        new = [run for run in dict.fromkeys(runs) if run not in values]
        if new:
            values.update(zip(new, values_of(new), strict=True))
        known = [(values[run], -float(lag), -float(d)) for run, (lag, d) in zip(runs, candidates, strict=True) if values[run] is not None]
        if not known:
            return lags[0], durations[0], float("nan")
        value, lag, d = max(known)
        return -lag, -d, value

    def neighbour(lag: float, d: float, a: int, b: int) -> tuple[float, float] | None:
        here = run_of(lag, d)
        for k in range(1, int(np.ceil(step / fine)) + 2):
            x, y = round(lag + a * k * fine, 9), round(d + b * k * fine, 9)
            if y < fine:
                return None
            if run_of(x, y) != here:
                return x, y
        return None

    lag, _, _ = best([(x, 1.0) for x in lags])
    lag, d, value = best([(lag, x) for x in durations])
    for _ in range(rounds):
        around = [n for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (n := neighbour(lag, d, a, b))]
        new_lag, new_d, new = best(around)
        if not new > value:
            return lag, d, value
        lag, d, value = new_lag, new_d, new
    raise RuntimeError(f"the lag search has not settled after {rounds} moves")


def search_lag(series: DataFrame, event: float, lags: list[float], durations: list[float], fine: float = 0.01, step: float = 1.0, column: str = "y", rounds: int = 10_000) -> tuple[float, float, float]:
    """(lag, duration, value) of the climb on the mean absolute correlation over all series. Series of at most SHORT samples are read
    once, for all runs that there are; of longer ones a round is one pass."""
    series = series.select(column).persist()
    try:
        first = series.select(F.size(column)).first()
        n = first[0] if first else 0
        if n > SHORT:
            return climb(lambda runs: run_values(series, runs, column), n, event, lags, durations, fine, step, rounds)
        values = all_run_values(series, n, column)
        return climb(lambda runs: [values.get((run.index(True), sum(run))) if any(run) else None for run in runs], n, event, lags, durations, fine, step, rounds)
    finally:
        series.unpersist()


def search_lags(series: DataFrame, event: float, lags: list[float], durations: list[float], fine: float = 0.01, step: float = 1.0, column: str = "y") -> DataFrame:
    """A climb for each row (a component in a movement, say) on its own absolute correlation: the other columns, and lag,
    duration and abs_r (NaN where no candidate has a correlation)."""

    def one(y):
        off = y - y.mean() if len(y) else y
        length = np.sqrt(off @ off)

        def values_of(runs):
            r = np.array(runs, dtype=float)
            r -= r.mean(axis=1, keepdims=True)
            spread = np.sqrt((r * r).sum(axis=1)) * length
            return [abs(float(v)) / s if s > 1e-12 else None for v, s in zip(r @ off, spread.tolist(), strict=True)]

        return climb(values_of, len(y), event, lags, durations, fine, step)

    def step_of(x):
        found = np.array([one(y) for y in x])
        return found[:, 0], found[:, 1], found[:, 2]

    return map_series(series, column, "lag double, duration double, abs_r double", step_of)


def combine(components: DataFrame, target: list[float], threshold: float = 0.1, column: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """Rows (*keys, t, combined): for each key the sum of the series whose absolute correlation with the target is above the
    threshold, each with the correlation's sign. Component 0 is never used."""
    r = pearson(F.col(column), F.array(*[F.lit(float(v)) for v in target]))
    used = components.filter(F.col("pc") != 0).withColumn("r", r).filter(F.abs("r") > threshold)
    long = used.select(*keys, F.signum("r").alias("sign"), F.posexplode(column).alias("t", "v"))
    return long.groupBy(*keys, "t").agg(F.sum(F.col("sign") * F.col("v")).alias("combined"))


def raw_peaks(long: DataFrame, keys: list[str], order: str = "t", value: str = "y") -> DataFrame:
    """Strict local maxima and minima, with kind 1 and -1."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after, y = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    marked = long.withColumn("kind", F.when((y > before) & (y > after), 1).when((y < before) & (y < after), -1))
    return marked.filter(F.col("kind").isNotNull())


def peak_signal(long: DataFrame, keys: list[str], order: str = "t", value: str = "y") -> DataFrame:
    """The series with zeros everywhere but at its peaks."""
    w = Window.partitionBy(*keys).orderBy(order)
    return long.withColumn("peak", F.coalesce(sparse_peak(F.col(value), F.lag(value).over(w), F.lead(value).over(w)), F.lit(0.0)))


def thinned_peaks(y: np.ndarray, distance: int = 1) -> np.ndarray:
    """Indices of strict maxima, the highest first, none within `distance` of a higher one."""
    at = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] > y[2:])) + 1
    keep: list[int] = []
    for k in at[np.argsort(-y[at], kind="stable")]:
        if all(abs(int(k) - j) >= distance for j in keep):
            keep.append(int(k))
    return np.array(sorted(keep), dtype=int)


def resample(y: np.ndarray, n: int) -> np.ndarray:
    """Series in rows, to n samples by their Fourier coefficients."""
    m = y.shape[1]
    if n == m:
        return y.copy()
    c = np.fft.rfft(y, axis=1)
    half = min(m, n) // 2 + 1
    out = np.zeros((len(y), n // 2 + 1), dtype=complex)
    out[:, :half] = c[:, :half]
    if min(m, n) % 2 == 0:  # the shared highest frequency stands for two when one side has more
        out[:, half - 1] *= 2 if n < m else 0.5
    return np.fft.irfft(out, n, axis=1) * (n / m)


def butterworth(order: int, low: float, high: float, nyquist: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital band-pass by the bilinear transform."""
    edges = np.array([low, high]) / nyquist
    if not (0 < edges[0] < edges[1] < 1):
        raise ValueError("the band must lie between 0 and the Nyquist frequency")
    warped = 4 * np.tan(np.pi * edges / 2)  # at a sampling rate of 2
    width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * width / 2
    root = np.sqrt(poles**2 - centre**2 + 0j)
    poles = np.concatenate([poles + root, poles - root])
    gain = width**order * np.real(np.prod(4 - np.zeros(order)) / np.prod(4 - poles))
    digital = (4 + poles) / (4 - poles)
    zeros = np.concatenate([np.ones(order), -np.ones(order)])
    return np.real(np.poly(zeros)) * gain, np.real(np.poly(digital))


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Series in rows through a recursive filter (transposed direct form); state has a row for each series."""
    out = np.empty_like(x)
    z = state.copy()
    for t in range(x.shape[1]):
        v = x[:, t]
        y = b[0] * v + z[:, 0]
        z[:, :-1] = z[:, 1:] + np.outer(v, b[1:-1]) - np.outer(y, a[1:-1])
        z[:, -1] = b[-1] * v - a[-1] * y
        out[:, t] = y
    return out


def band_pass(x: np.ndarray, low: float, high: float, tr: float, order: int = 3) -> np.ndarray:
    """Forward and backward Butterworth filter of series in rows, with odd extension at both ends."""
    b, a = butterworth(order, low, high, 0.5 / tr)
    m = len(a)
    pad = min(3 * m, x.shape[1] - 1)
    left, right = 2 * x[:, :1] - x[:, pad:0:-1], 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
    extended = np.concatenate([left, x, right], axis=1)
    companion = np.eye(m - 1) - np.vstack([-a[1:], np.eye(m - 2, m - 1)]).T
    steady = np.linalg.solve(companion, b[1:] - a[1:] * b[0])
    forward = lfilter(b, a, extended, np.outer(extended[:, 0], steady))
    backward = lfilter(b, a, forward[:, ::-1], np.outer(forward[:, -1], steady))[:, ::-1]
    return backward[:, pad : pad + x.shape[1]]


def clean(x: np.ndarray, confounds: np.ndarray | None = None, standardise: bool = True) -> np.ndarray:
    """Series in rows without what the confounds (columns) explain, standardised by the sample deviation."""
    x = x - x.mean(axis=1, keepdims=True)
    if confounds is not None and confounds.size:
        c = confounds - confounds.mean(axis=0)
        q, r = np.linalg.qr(c)
        q = q[:, np.abs(np.diag(r)) > 1e-10 * max(1.0, np.abs(r).max())]
        x = x - (x @ q) @ q.T
    if standardise:
        spread = x.std(axis=1, ddof=1, keepdims=True)
        x = np.divide(x, spread, out=np.zeros_like(x), where=spread > 0)
    return x


def preprocess(series: DataFrame, tr: float, band: tuple[float, float] | None = None, confounds: np.ndarray | None = None, standardise: bool = False, order: int = 3, column: str = "y") -> DataFrame:
    """Confound regression, band-pass and standardising of every series, in Arrow batches."""

    def step(x):
        if confounds is not None or standardise:
            x = clean(x, confounds, standardise)
        if band is not None:
            x = band_pass(x, band[0], band[1], tr, order)
        return (as_lists(x),)

    return map_series(series, column, f"{column} array<double>", step)


def opened_and_closed(mask: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Voxels (x, y, z) after a 3 x 3 x 3 opening and closing of the mask; beyond the volume nothing is set."""

    def grown(m: DataFrame) -> DataFrame:
        out = m
        for axis, n in zip("xyz", shape, strict=True):
            near = F.explode(F.array(F.col(axis) - 1, F.col(axis), F.col(axis) + 1))
            out = out.withColumn("c", near).filter((F.col("c") >= 0) & (F.col("c") < n)).drop(axis).withColumnRenamed("c", axis).select("x", "y", "z").distinct()
        return out

    def shrunk(m: DataFrame) -> DataFrame:
        out = m
        for axis in "xyz":
            spread = out.withColumn("c", F.explode(F.array(F.col(axis) - 1, F.col(axis), F.col(axis) + 1))).drop(axis).withColumnRenamed("c", axis)
            out = spread.groupBy("x", "y", "z").count().filter("count = 3").select("x", "y", "z")
        return out

    return shrunk(grown(grown(shrunk(mask.select("x", "y", "z").distinct()))))


def scatter(scores: DataFrame, shape: tuple[int, int, int], value: str) -> DataFrame:
    """A full volume (x, y, z, value) with zeros where there is no score."""
    nx, ny, nz = shape
    grid = scores.sparkSession.range(nx * ny * nz).select(F.floor(F.col("id") / (ny * nz)).alias("x"), (F.floor(F.col("id") / nz) % ny).alias("y"), (F.col("id") % nz).alias("z"))
    return grid.join(scores.select("x", "y", "z", value), ["x", "y", "z"], "left").fillna(0.0, [value]).withColumn("index", voxel_index(F.col("x"), F.col("y"), F.col("z"), ny, nz))
