"""Average linkage of a table of distances: every round merges all pairs of clusters that are each other's nearest.

Average linkage is reducible, so such merges are those of the one-by-one method in another order, and about log(n) rounds are
enough. The distance of two merged clusters is the mean over their members' pairs: a sum of the old distances, weighted by sizes,
which is one aggregation over the table. Distances stay rows on the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Steps

#: Distances that agree to so many digits are equal; the pair of least names goes first.
DIGITS = 12
ROUNDS = 10_000


def average_linkage(distances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """distances (a, b, d) of all pairs, once each -> (merges, steps).

    merges: (a, b, height, size), a cluster being named by its least member and a < b; the union is named a. steps: (node, height,
    cluster), what each node belongs to from that height on. Names of one type that can be ordered; nodes without
    a distance to others are left out.
    """
    saved = Steps(distances.sparkSession, "linkage")
    both = distances.select("a", "b", "d").unionByName(distances.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).filter("a <> b AND d IS NOT NULL")
    table = saved.save(both.select("a", "b", F.col("d").cast("double").alias("d"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")))
    members = table.select(F.col("a").alias("node"), F.col("a").alias("cluster")).distinct()
    members, merges, steps = saved.save(members), None, None
    for _ in range(ROUNDS):
        order = F.struct(F.round("d", DIGITS).alias("d"), F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        nearest = table.groupBy("a").agg(F.min_by(F.struct("b", "d", "na", "nb"), order).alias("n")).select("a", "n.*")
        back = nearest.select(F.col("a").alias("b"), F.col("b").alias("a"))
        new = saved.save(nearest.join(back, ["a", "b"]).filter("a < b").select("a", "b", F.col("d").alias("height"), (F.col("na") + F.col("nb")).alias("size")))
        if new.isEmpty():
            break
        merges = new if merges is None else merges.unionByName(new)
        into = new.select(F.col("b").alias("cluster"), F.col("a").alias("whole"), "height")
        grown = new.select(F.col("a").alias("cluster"), "height").unionByName(into.select("cluster", "height"))
        members = saved.save(members.join(into.drop("height"), "cluster", "left").select("node", F.coalesce("whole", "cluster").alias("cluster"), F.col("cluster").alias("before")))
        reached = members.join(grown.select(F.col("cluster").alias("before"), "height"), "before").select("node", "height", "cluster")
        steps = reached if steps is None else steps.unionByName(reached)
        members = members.select("node", "cluster")
        a, b = (into.select(F.col("cluster").alias(c), F.col("whole").alias(f"whole_{c}")) for c in "ab")
        named = table.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("whole_a", "a").alias("a"), F.coalesce("whole_b", "b").alias("b"), "d", "na", "nb").filter("a <> b")
        pairs = (F.col("na") * F.col("nb")).cast("double")
        means = named.groupBy("a", "b").agg((F.sum(F.col("d") * pairs) / F.sum(pairs)).alias("d"))
        own = table.select("a", "na").distinct().join(a, "a", "left").groupBy(F.coalesce("whole_a", "a").alias("a")).agg(F.sum("na").alias("na"))
        table = saved.save(means.join(own, "a").join(own.select(F.col("a").alias("b"), F.col("na").alias("nb")), "b").select("a", "b", "d", "na", "nb"))
    if merges is None:
        none = distances.select("a", "b", F.col("d").cast("double").alias("height"), F.lit(0).cast("long").alias("size")).filter("false")
        return none, none.select(F.col("a").alias("node"), "height", F.col("b").alias("cluster"))
    return merges, steps


def two_clusters(merges: DataFrame, steps: DataFrame) -> DataFrame:
    """Rows (node, cluster): the two clusters before the last merge, named by their least members."""
    last = merges.agg(F.max_by(F.struct("a", "b", "height"), F.struct(F.round("height", DIGITS), "size")).alias("m")).select("m.*")
    nodes = merges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # the second cluster is all that was named b when the last merge came; the rest is the first
    second = steps.join(F.broadcast(last.select(F.col("b").alias("cluster"))), "cluster", "left_semi").select("node").distinct()
    alone = last.select(F.col("b").alias("node"))
    second = second.unionByName(alone).distinct().withColumn("second", F.lit(True))
    named = nodes.join(second, "node", "left").crossJoin(F.broadcast(last.select("a", "b")))
    return named.select("node", F.when(F.col("second"), F.col("b")).otherwise(F.col("a")).alias("cluster"))
