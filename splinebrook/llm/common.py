"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose texts a Python worker holds as Python strings at once.
SLICE_ROWS = 256
#: Bits of the filter that keeps untouched rows out of a shuffle: so many for each member, 32 MB in all at most. Beyond
#: about 10^8 members it lets through ever more rows, which the join that follows then settles.
MEMBER_BITS = 16
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; where that is unset, one in the warehouse, which is shared
    too, or a temporary one if Spark runs on this machine alone."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if named is None and sc.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return named or sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, for tables that an operator writes and reads again."""
    return f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def draw(df: DataFrame, rows: int, key: Column, seed: int, spare: int = 4) -> DataFrame:
    """At most `rows` rows of df, those with the least hashes of the key.

    Sorting for the least ones would gather that many from each task, so only about `spare` times as many rows as are
    wanted are let through to the sort, by a bound on the hash that follows from the number of rows.
    """
    total = total_rows(df)
    hashed = df.withColumn("__draw", F.xxhash64(key, F.lit(seed)))
    if total > spare * rows:
        bound = int(-(1 << 63) + (1 << 64) * (spare * rows / total))
        hashed = hashed.filter(F.col("__draw") < F.lit(bound))
    return hashed.orderBy("__draw", *[c for c in df.columns if c != "text"][:1]).limit(rows).drop("__draw")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table that an operator wrote under scratch_path, through Hadoop's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none where it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that long texts are never all expanded to Python strings together."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """mapInArrow with a function that `make` builds once per task; it gets slices of a bounded number of rows.

    A worker waits for its next task with what Arrow's pool has kept, so that is given back at the end.
    """

    def run(batches):
        step = make()
        for batch in sliced(batches, rows):
            out = step(batch)
            if out is not None and out.num_rows:
                yield out
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def total_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def maybe_in(df: DataFrame, key: str, members: DataFrame, hit: str = "hit") -> DataFrame:
    """df with a boolean column `hit`: true for each row whose key is among members (one column), and for few others.

    members is read twice, so it should be cheap to read.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (MEMBER_BITS * total_rows(members)).bit_length()))

    def slot(of: str) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(bits))

    at = members.select(slot(members.columns[0]).alias("s"))
    bitmaps = at.groupBy(F.bitmap_bucket_number("s").alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("__bits"))
    placed = df.withColumn("__slot", slot(key)).withColumn("__part", F.bitmap_bucket_number("__slot")).withColumn("__at", F.bitmap_bit_position("__slot"))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = F.floor(byte / F.pow(F.lit(2), F.col("__at") % 8)) % 2 == 1
    return placed.join(F.broadcast(bitmaps), "__part", "left").withColumn(hit, F.coalesce(found, F.lit(False))).select(*df.columns, hit)
