"""Similarity of components across files: subspaces, peaks and time warping, orientation, representatives, consistency."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import mid_ranks


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    """Dynamic-time-warping distance: the root of the least sum of squared differences, swept by anti-diagonals."""
    n, m = len(a), len(b)
    cost = (a[:, None] - b[None, :]) ** 2
    before = np.full(n, np.inf)  # diagonal d - 1, by row
    older = np.full(n, np.inf)
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        up = np.where(i > 0, before[i - 1], np.inf)
        corner = np.where((i > 0) & (d - i > 0), older[i - 1], np.inf)
        left = np.where(d - i > 0, before[i], np.inf)
        best = np.minimum(np.minimum(up, left), corner)
        now = np.full(n, np.inf)
        now[i] = cost[i, d - i] + (best if d else 0.0)
        older, before = before, now
    return math.sqrt(before[n - 1])


def dtw_pairs(pairs: DataFrame, oriented: bool = False) -> DataFrame:
    """pairs (i, j, a, b) -> (i, j, distance, sim, flipped). Oriented: the better of a and -a; flipped if -a is closer."""

    def run(batches):
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.array(a), np.array(b)
                d, flipped = dtw(x, y), False
                if oriented:
                    turned = dtw(-x, y)
                    d, flipped = min(d, turned), turned < d
                rows.append((d, 1 / (1 + d), flipped))
            d, s, f = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d, pa.float64()), pa.array(s, pa.float64()), pa.array(f, pa.bool_())], ["i", "j", "distance", "sim", "flipped"])

    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("i", "j")}
    return pairs.select("i", "j", "a", "b").repartition("i", "j").mapInArrow(run, f"i {kinds['i']}, j {kinds['j']}, distance double, sim double, flipped boolean")


def all_pairs(files: DataFrame, key: str, payload: str) -> DataFrame:
    """Pairs i < j of a table of files (few, each with a bounded payload)."""
    a, b = files.select(F.col(key).alias("i"), F.col(payload).alias("a")), files.select(F.col(key).alias("j"), F.col(payload).alias("b"))
    return a.join(b, F.col("i") < F.col("j"))


def subspace_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of squared cosines of the principal angles between column spaces, by the root of the sizes' product."""
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    return float(np.linalg.norm(qa.T @ qb) ** 2 / math.sqrt(a.shape[1] * b.shape[1]))


def orientations(flips: np.ndarray, seed: int = 0, rounds: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """Which files to turn, from the matrix of pairwise flips: signs of the leading eigenvector of 1 - 2 M."""
    w = 1.0 - 2.0 * flips.astype(float)
    np.fill_diagonal(w, 0)
    v = np.random.default_rng(seed).standard_normal(len(w))
    v /= np.linalg.norm(v)
    for _ in range(rounds):
        new = w @ v + len(w) * v  # shifted, so that the largest eigenvalue leads
        new /= np.linalg.norm(new)
        if np.linalg.norm(new - v) < tolerance:
            v = new
            break
        v = new
    return v < 0


def representatives(corr: DataFrame, power: float = 2.0, how: str = "max") -> DataFrame:
    """corr (file, pc, other, other_pc, r) within a movement -> (file, rep_pc, total): the component that the others follow
    best, by the sum over files of the largest (or all) absolute correlations to a power."""
    strength = F.pow(F.abs("r"), F.lit(power))
    per = corr.groupBy("file", "pc", "other").agg((F.max if how == "max" else F.sum)(strength).alias("s"))
    total = per.groupBy("file", "pc").agg(F.sum("s").alias("total"))
    best = total.groupBy("file").agg(F.max(F.struct(F.round("total", 9).alias("k"), (-F.col("pc")).alias("n"), "total")).alias("m"))
    return best.select("file", (-F.col("m.n")).alias("rep_pc"), F.col("m.total").alias("total"))


def spearman(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Rows (*keys, rho): correlation of mid-ranks."""
    r = mid_ranks(mid_ranks(df, a, keys, "_a"), b, keys, "_b")
    return r.groupBy(*keys).agg(F.corr("_a", "_b").alias("rho")) if keys else r.agg(F.corr("_a", "_b").alias("rho"))


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p of a rank correlation by the t distribution."""
    if n < 3 or abs(rho) >= 1:
        return 0.0 if n >= 3 else float("nan")
    return student_tail(abs(rho) * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


def student_tail(t: float, df: int) -> float:
    """Two-sided tail of Student's t: the regularised incomplete beta by its continued fraction."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(max(1 - x, 1e-300))) if x < 1 else 1.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
        h = d
        for m in range(1, 300):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + k * d or 1e-300)
                c = 1 + k / c or 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return h

    if x >= 1:
        return 1.0
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def consistency(similarity: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """similarity (i, j, mov_a_value, mov_b_value ...) of two movements' upper triangles -> mean rho."""
    return spearman(similarity, "a", "b", keys or []).agg(F.avg("rho").alias("mean_spearman"))
