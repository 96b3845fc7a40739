"""Penalised spline fits and functional principal components of very many series.

Series stay rows with an array payload. Fits and scores run in Arrow batches against small matrices in the closure;
means and covariances are K x K partial sums of each task, added up in one small aggregation, so nothing but a K x K
matrix ever reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.basis import Smoother, basis, lambdas, penalty, times


def as_matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def as_lists(x: np.ndarray) -> pa.Array:
    offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if x.size else np.zeros(len(x) + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x).ravel()))


def map_series(df: DataFrame, column: str, results: str, step) -> DataFrame:
    """df without `column` and with what step(matrix) returns, a tuple of Arrow arrays or numpy vectors for `results`."""
    kept = [c for c in df.columns if c != column]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                got = [x if isinstance(x, pa.Array) else pa.array(x) for x in step(as_matrix(batch.column(len(kept))))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), *got], [*kept, *[r.split()[0] for r in results.split(", ")]])

    return df.select(*kept, column).mapInArrow(run, f"{fields}, {results}" if fields else results)


def fit_series(df: DataFrame, smoother: Smoother, grid: np.ndarray | None = None, column: str = "y") -> DataFrame:
    """Replaces the series by coefficients c, the lambda chosen by GCV for each series, and its score."""
    grid = lambdas() if grid is None else grid

    def step(y):
        c, chosen, score = smoother.fit(y, grid)
        return as_lists(c), chosen, score

    return map_series(df, column, "c array<double>, lambda double, gcv double", step)


def fit_error(df: DataFrame, smoother: Smoother, grid: np.ndarray | None = None, column: str = "y") -> float:
    """Mean absolute deviation of the fits over all values of all series."""
    grid = lambdas() if grid is None else grid

    def step(y):
        c, _, _ = smoother.fit(y, grid)
        off = np.abs(y - c @ smoother.f.T)
        return off.sum(axis=1), np.full(len(y), float(y.shape[1]))

    row = map_series(df.select(column), column, "off double, n double", step).agg((F.sum("off") / F.sum("n")).alias("e")).first()
    return row["e"]


def choose_basis_size(df: DataFrame, candidates: list[int], n: int, threshold: float, degree: int = 3, tr: float = 0.75, derivative: int = 2) -> int:
    """One candidate: that one, and 0 stands for the number of volumes. Several: the first whose mean error is within the
    threshold, else the one with the least."""
    if len(candidates) == 1:
        return candidates[0] or n
    errors = []
    for k in candidates:
        errors.append(fit_error(df, smoother_for(n, k, degree, derivative, tr)))
        if errors[-1] <= threshold:
            return k
    return candidates[int(np.argmin(errors))]


def smoother_for(n: int, k: int = 12, degree: int = 3, derivative: int | None = 2, tr: float = 0.75, skip: int = 0) -> Smoother:
    """derivative None: no roughness penalty, which leaves ridge regression with a chosen lambda."""
    t = times(n, skip, tr)
    p = np.eye(k) if derivative is None else penalty(t[0], t[-1], k, degree, derivative)
    return Smoother.prepare(basis(t, k, degree), p)


def moments(df: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, sum of the vectors and sum of their outer products, over all rows."""

    def run(batches):
        n, total, outer = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = as_matrix(batch.column(0))
                n += len(x)
                total = x.sum(axis=0) + (0 if total is None else total)
                outer = x.T @ x + (0 if outer is None else outer)
        if n:
            flat = np.concatenate([[n], total, outer.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "v"])

    sums = df.select(column).mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
    found = {r["k"]: r["v"] for r in sums.collect()}
    size = int((-1 + np.sqrt(1 + 4 * (len(found) - 1))) / 2) if found else 0
    flat = np.array([found[k] for k in range(len(found))]) if found else np.zeros(1)
    return int(flat[0]), flat[1 : 1 + size], flat[1 + size :].reshape(size, size)


def grouped_moments(df: DataFrame, key: str, column: str) -> dict:
    """key -> (number of rows, sum, sum of outer products) of each group, in one job; rows without a key have none.

    Only for few groups: each task keeps a K x K matrix for every group that it meets.
    """

    def run(batches):
        sums: dict = {}
        for batch in batches:
            x, (keys, at) = as_matrix(batch.column(1)), np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            for k, g in enumerate(keys.tolist()):
                rows = x[at == k]
                flat = np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows).ravel()])
                sums[g] = flat + sums.get(g, 0.0)
        for g, flat in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(flat), kind), pa.array(np.arange(len(flat))), pa.array(flat)], ["g", "k", "v"])

    kind = pa.from_numpy_dtype(np.int64) if df.schema[key].dataType.simpleString() in ("int", "bigint") else pa.string()
    name = "long" if kind == pa.int64() else "string"
    sums = df.filter(F.col(key).isNotNull()).select(F.col(key).cast(name), column).mapInArrow(run, f"g {name}, k long, v double").groupBy("g", "k").agg(F.sum("v").alias("v"))
    found: dict = {}
    for r in sums.collect():
        found.setdefault(r["g"], {})[r["k"]] = r["v"]
    out = {}
    for g, values in found.items():
        flat = np.array([values[k] for k in range(len(values))])
        size = int((-1 + np.sqrt(1 + 4 * (len(flat) - 1))) / 2)
        out[g] = int(flat[0]), flat[1 : 1 + size], flat[1 + size :].reshape(size, size)
    return out


@dataclass
class FpcaModel:
    """Functional principal components: mean coefficients, eigenvectors (columns), eigenvalues and the total variance."""

    mean: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    total: float
    u: np.ndarray
    f: np.ndarray | None = None
    skipped: list[int] = field(default_factory=list)

    @staticmethod
    def fit(coeffs: DataFrame, q: int, u: np.ndarray | None = None, f: np.ndarray | None = None, column: str = "c", fix_sign: bool = True) -> FpcaModel:
        """Mean and covariance are pooled over all rows, so rows of many subjects give the group's components.

        The covariance times the penalty metric u is made symmetric before it is decomposed. fix_sign: each vector's
        largest entry is positive.
        """
        n, total, outer = moments(coeffs, column)
        if not n:
            raise ValueError("no series to learn from")
        return FpcaModel.of_moments(n, total, outer, q, u, f, fix_sign)

    @staticmethod
    def of_moments(n: int, total: np.ndarray, outer: np.ndarray, q: int, u: np.ndarray | None = None, f: np.ndarray | None = None, fix_sign: bool = True) -> FpcaModel:
        u = np.eye(len(total)) if u is None else u
        mean = total / n
        sigma = (outer - n * np.outer(mean, mean)) @ u / n
        sigma = (sigma + sigma.T) / 2
        values, vectors = np.linalg.eigh(sigma)
        order = np.argsort(values)[::-1]
        values, vectors = values[order], vectors[:, order]
        if fix_sign:
            vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1, 1)
        return FpcaModel(mean, vectors[:, :q], values[:q], float(values.sum()), u, f)

    def skip(self, components: list[int]) -> FpcaModel:
        """A view without some components; the others keep their order and are numbered from 0."""
        n = len(self.values)
        drop = {c % n for c in components}
        keep = [k for k in range(n) if k not in drop]
        return FpcaModel(self.mean, self.vectors[:, keep], self.values[keep], self.total, self.u, self.f, sorted(drop))

    def transform(self, coeffs: DataFrame, column: str = "c") -> DataFrame:
        """Replaces the coefficients by scores s; unseen subjects are centred by the training mean."""
        side = self.u @ self.vectors
        return map_series(coeffs, column, "s array<double>", lambda c: (as_lists((c - self.mean) @ side),))

    def components(self, spark: SparkSession) -> DataFrame:
        """Rows (pc, eigval, explained_pct, vec)."""
        rows = [(k, float(v), 100 * float(v) / self.total if self.total else None, self.vectors[:, k].tolist()) for k, v in enumerate(self.values)]
        return spark.createDataFrame(rows, "pc int, eigval double, explained_pct double, vec array<double>")

    def profiles(self, spark: SparkSession, t: np.ndarray) -> DataFrame:
        """Rows (pc, t, value): the components as functions of time."""
        if self.f is None:
            raise ValueError("the model has no basis matrix")
        values = self.f @ self.vectors
        return spark.createDataFrame([(k, float(t[i]), float(values[i, k])) for k in range(values.shape[1]) for i in range(len(t))], "pc int, t double, value double")

    def save(self, spark: SparkSession, path: str) -> None:
        parts = {"mean": self.mean[None, :], "vectors": self.vectors, "values": self.values[None, :], "u": self.u, "total": np.array([[self.total]])} | ({} if self.f is None else {"f": self.f})
        rows = [(name, i, m[i].tolist()) for name, m in parts.items() for i in range(len(m))]
        spark.createDataFrame(rows, "name string, i int, row array<double>").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> FpcaModel:
        parts: dict[str, dict[int, list[float]]] = {}
        for r in spark.read.parquet(path).collect():
            parts.setdefault(r["name"], {})[r["i"]] = r["row"]
        m = {name: np.array([rows[i] for i in sorted(rows)]) for name, rows in parts.items()}
        return FpcaModel(m["mean"][0], m["vectors"], m["values"][0], float(m["total"][0, 0]), m["u"], m.get("f"))


def best_voxels(scores: DataFrame, id_col: str = "voxel_id") -> DataFrame:
    """Rows (pc, voxel, score): the largest score of each component, the smaller voxel on ties.

    A task's candidates are cut down before the shuffle, as max_by is pre-aggregated.
    """
    long = scores.select(id_col, F.posexplode("s").alias("pc", "score"))
    best = long.groupBy("pc").agg(F.max(F.struct("score", (-F.col(id_col)).alias("neg"))).alias("m"))
    return best.select("pc", (-F.col("m.neg")).alias(id_col), F.col("m.score").alias("score"))
