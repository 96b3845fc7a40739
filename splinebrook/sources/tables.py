"""The model's tables, derived from the driver's: signals, subjects' series, metadata, region series and importances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the mapping: days of a subject's series, quarters and regions of a region series, quarters of movement 1.
DAYS = 30
QUARTERS = 28
HALF = QUARTERS // 2
REGIONS = ("AF", "AO", "NF", "NO", "RF", "RO")
FIRST_YEAR = 1995


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """voxel_id, roi, y array<double>: one series for each vector."""
    e = table(spark, sf_dir, "embeddings").filter(F.col("embedding").isNotNull())
    return e.select(F.col("vec_id").alias("voxel_id"), F.col("label").alias("roi"), F.col("embedding").cast("array<double>").alias("y"))


def to_long(df: DataFrame, column: str = "y") -> DataFrame:
    """One row for each value, with t from 0."""
    return df.select(*[c for c in df.columns if c != column], F.posexplode(column).alias("t", "y"))


def subject_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, y array<double> of DAYS values: the mean event value of each day of a month, 0 on days without events."""
    e = table(spark, sf_dir, "events")
    day = F.least(F.dayofmonth("ts") - 1, F.lit(DAYS - 1))
    means = [F.coalesce(F.avg(F.when(day == d, F.col("value"))), F.lit(0.0)) for d in range(DAYS)]
    return e.groupBy("user_id").agg(F.array(*means).alias("y"))


def subject_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, roi (event type), y: the same for each event type."""
    e = table(spark, sf_dir, "events")
    day = F.least(F.dayofmonth("ts") - 1, F.lit(DAYS - 1))
    means = [F.coalesce(F.avg(F.when(day == d, F.col("value"))), F.lit(0.0)) for d in range(DAYS)]
    return e.groupBy("user_id", F.col("event_type").alias("roi")).agg(F.array(*means).alias("y"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sub_id, instrument_group, group, is_train_set, balance."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = c.join(n, c.c_nationkey == n.n_nationkey)
    return joined.select(F.col("c_custkey").alias("sub_id"), F.col("c_mktsegment").alias("instrument_group"), F.col("n_name").alias("group"), (F.col("c_custkey") % 2).cast("int").alias("is_train_set"), F.col("c_acctbal").alias("balance"))


def region_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, roi, y array<double> of QUARTERS values: shipped price by quarter, 0 where nothing was shipped.

    Every subject with a shipment gets all regions.
    """
    o, li = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem")
    t = (F.year("l_shipdate") - FIRST_YEAR) * 4 + F.quarter("l_shipdate") - 1
    rows = li.select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("roi"), t.alias("t"), "l_extendedprice").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    sums = [F.coalesce(F.sum(F.when(F.col("t") == q, F.col("l_extendedprice"))), F.lit(0.0)) for q in range(QUARTERS)]
    # narrow rows are dealt out by subject first, so that a task's table of sums holds its own subjects only
    dealt = rows.select(F.col("o_custkey").alias("subject"), "roi", "t", "l_extendedprice").repartition("subject")
    found = dealt.groupBy("subject", "roi").agg(F.array(*sums).alias("y"))
    own = found.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.when(F.col("subject").isNotNull() & F.col("roi").isNotNull(), F.struct("roi", "y")))).alias("own"))
    zeros = F.array_repeat(F.lit(0.0), QUARTERS)
    every = own.withColumn("roi", F.explode(F.array(*[F.lit(r) for r in REGIONS])))
    return every.select("subject", "roi", F.coalesce(F.try_element_at("own", "roi"), zeros).alias("y"))


def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair, ml_model, roi, importance: mean discounted quantity of a brand by flags and order priority."""
    o, li, p = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "part"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    pair = F.concat("l_returnflag", F.lit(" vs "), "l_linestatus").alias("pair")
    return rows.groupBy(pair, F.col("o_orderpriority").alias("ml_model"), F.col("p_brand").alias("roi")).agg(F.round(F.avg(F.col("l_discount") * F.col("l_quantity")), 9).alias("importance"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, group, y, score: quality labels with a score from the text's length."""
    la, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return la.join(d, "doc_id").select("doc_id", F.col("lang").alias("group"), F.col("quality").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 2000)).alias("score"), "n_chars")
