"""Which of many series to turn so that as many as possible point one way: the signs of a leading eigenvector.

W is 1 for two series of one orientation, -1 for two that are opposite, 0 on the diagonal, with a row for each pair. A round of
power iteration is a join of the pairs with the vector and one aggregation; W is shifted by the number of series, so that its
greatest eigenvalue leads and the iteration cannot swing. The start comes from the MD5 of each name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Steps

ROUNDS, TOLERANCE = 200, 1e-6
#: Rounds that are planned together before the change is looked at.
TOGETHER = 4


def start(name: Column) -> Column:
    """A number from 0 to 1 for each name."""
    return F.conv(F.substring(F.md5(name.cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def orientations(pairs: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """pairs (i, j, flipped), each pair once -> (node, loading, flip): flip is true for a loading below 0.

    Stops when the vector of length 1 changes by less than the tolerance in a round. Series without pairs are left out; null flips
    say nothing.
    """
    steps = Steps(pairs.sparkSession, "orientation")
    known = pairs.filter("flipped IS NOT NULL AND i <> j")
    sign = F.when(F.col("flipped"), -1.0).otherwise(1.0)
    w = steps.save(known.select("i", "j", sign.alias("w")).unionByName(known.select(F.col("j").alias("i"), F.col("i").alias("j"), sign.alias("w"))))
    nodes = w.select(F.col("i").alias("node")).distinct()
    n = nodes.count()

    def scaled(v: DataFrame) -> DataFrame:
        length = v.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))  # one row
        return v.crossJoin(F.broadcast(length)).select("node", (F.col("x") / F.col("length")).alias("x"))

    def turned(v: DataFrame) -> DataFrame:
        pulled = w.join(v.select(F.col("node").alias("j"), "x"), "j").groupBy(F.col("i").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("pull"))
        return scaled(v.join(pulled, "node").select("node", (F.col("pull") + float(n) * F.col("x")).alias("x")))

    v = steps.save(scaled(nodes.select("node", start(F.col("node")).alias("x"))))
    for _ in range(0, rounds if n else 0, TOGETHER):
        before = v
        for _ in range(TOGETHER - 1):
            before = turned(before)
        before = steps.save(before)
        v = steps.save(turned(before))
        old = before.withColumnRenamed("x", "y")
        change = v.join(old, "node").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2))).first()[0]
        if change < tolerance:
            break
    return v.select("node", F.col("x").alias("loading"), (F.col("x") < 0).alias("flip"))
