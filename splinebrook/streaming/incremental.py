"""Streams of new series: fits against a prepared basis, and group moments that grow batch by batch.

Both go beyond batch use. Fits have no state, so any stream will do; moments are sums, so each micro-batch writes its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.basis import Smoother
from ..operators.fpca import FpcaModel, fit_series, moments


def fit_stream(series: DataFrame, smoother: Smoother, grid: np.ndarray | None = None, column: str = "y") -> DataFrame:
    """The same as fit_series on a stream: one row out for each row in, late or not."""
    return fit_series(series, smoother, grid, column)


class RunningMoments:
    """Number, sum and outer products of coefficients over all batches seen, in a folder with a table for each batch.

    A batch that comes again after a failure overwrites its own table, and a restart finds the others: nothing is kept in
    the driver's memory only.
    """

    def __init__(self, spark: SparkSession, path: str, column: str = "c"):
        self.spark, self.path, self.column = spark, path, column

    def add(self, batch: DataFrame, batch_id: int) -> None:
        n, total, outer = moments(batch, self.column)
        rows = [(k, float(v)) for k, v in enumerate(np.concatenate([[n], total, outer.ravel()]))] if n else []
        self.spark.createDataFrame(rows, "k long, v double").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def sums(self) -> tuple[int, np.ndarray, np.ndarray]:
        stored = self.spark.read.schema("k long, v double, batch long").parquet(self.path)
        found = {r["k"]: r["v"] for r in stored.groupBy("k").agg(F.sum("v").alias("v")).collect()}
        if not found:
            raise ValueError("no series seen yet")
        flat = np.array([found[k] for k in range(len(found))])
        size = int((-1 + np.sqrt(1 + 4 * (len(flat) - 1))) / 2)
        return int(flat[0]), flat[1 : 1 + size], flat[1 + size :].reshape(size, size)

    def model(self, q: int, u: np.ndarray | None = None) -> FpcaModel:
        return FpcaModel.of_moments(*self.sums(), q, u)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
