"""Small tables that an iterative operator writes and reads again, in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"


class Steps:
    """Tables of an iteration, as Parquet. What is no longer read can be deleted, unlike a checkpoint."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def save(self, df: DataFrame, *by: str) -> DataFrame:
        """df as stored, with a folder for each value of the columns `by`."""
        path = f"{folder(self.spark)}/{self.name}-{uuid.uuid4().hex}"
        df.write.partitionBy(*by).parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, keep: int = 1) -> None:
        """Deletes all tables but the last `keep`."""
        gone, self.paths = self.paths[: len(self.paths) - keep], self.paths[len(self.paths) - keep :]
        for path in gone:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
