"""Text artifacts as tables: temporal profiles, reports, participants and the newest of several files."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relational import newest


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, movement, t, value) from profile files: a heading, "#Times:", numbers, "#PC temporal profile:", numbers."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def numbers(part):
        return F.transform(F.filter(F.split(F.trim(part), r"[\s,\[\]]+"), lambda x: x != ""), lambda x: x.cast("double"))

    after = F.split_part("value", F.lit("#Times:"), F.lit(2))
    parts = [numbers(F.split_part(after, F.lit("#PC temporal profile:"), F.lit(k))).alias(name) for k, name in ((1, "t"), (2, "v"))]
    return text.select("path", F.regexp_extract("path", r"movement(\d+)", 1).alias("movement"), F.explode(F.arrays_zip(*parts)).alias("p")).select("path", "movement", F.col("p")["t"].alias("t"), F.col("p")["v"].alias("value"))


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, pair, ml_model, balanced_accuracy) from classification reports in folders ml_<a>_vs_<b>."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    found = text.select("path", F.regexp_extract("path", r"ml_(.+?_vs_[^/]+)", 1).alias("pair"), F.regexp_extract("value", r"(?i)model:\s*(\S+)", 1).alias("ml_model"), F.expr(r"try_cast(regexp_extract(value, '(?i)balanced accuracy:\\s*([0-9.]+)', 1) as double)").alias("balanced_accuracy"))
    return found.filter("balanced_accuracy IS NOT NULL")


def newest_files(spark: SparkSession, path: str, key_pattern: str) -> DataFrame:
    """Rows (path, modified, key): for each key in the paths the newest file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return newest(files.select("path", F.col("modificationTime").alias("modified"), F.regexp_extract("path", key_pattern, 1).alias("key")), ["key"])


def metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """Participants: the index column is dropped, flags are doubles (missing: 0), a missing instrument group is "NM"."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df.drop(*[c for c in df.columns if c.startswith(("Unnamed:", "_c")) or not c.strip()])
    flags = [c for c in df.columns if c.startswith(("has_", "is_")) and c != "is_train_set"]
    df = df.withColumns({c: F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(0.0)) for c in flags})
    if "is_train_set" in df.columns:
        df = df.withColumn("is_train_set", F.expr("try_cast(is_train_set as int)"))
    if "instrument_group" in df.columns:
        df = df.withColumn("instrument_group", F.coalesce("instrument_group", F.lit("NM")))
    return df


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Rows (path, params, subject, movement) of the files under path, in order of movement and name.

    params is the folder below path that a parameter combination's results lie in.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path")
    root = F.regexp_extract("path", re.escape(path.rstrip("/")) + r"/([^/]+)/", 1)
    named = files.select("path", root.alias("params"), F.regexp_extract("path", r"(sub-[A-Za-z0-9]+)", 1).alias("subject"), F.expr("try_cast(regexp_extract(path, 'movement([0-9]+)', 1) as int)").alias("movement"))
    return named.orderBy("movement", "path")


def params(spark: SparkSession, path: str) -> DataFrame:
    """Rows (params, n_files): the parameter combinations that have results under path."""
    return listing(spark, path).filter("params <> ''").groupBy("params").agg(F.count(F.lit(1)).alias("n_files")).orderBy("params")


def averaged_signals(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, movement, t, value) from files whose third line holds an averaged signal's numbers."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", r"\r?\n").alias("lines"))
    numbers = F.transform(F.filter(F.split(F.trim(F.get("lines", F.lit(2))), r"[\s,\[\]]+"), lambda x: x != ""), lambda x: x.cast("double"))
    return text.select("path", F.regexp_extract("path", r"movement(\d+)", 1).alias("movement"), F.posexplode(numbers).alias("t", "value"))


def model_sizes(models: DataFrame) -> DataFrame:
    """models (path, pc, vec), the components of many files -> (path, k, n_pcs, differs): differs where files disagree in k."""
    sizes = models.groupBy("path").agg(F.max(F.size("vec")).alias("k"), F.count(F.lit(1)).alias("n_pcs"))
    kinds = sizes.agg((F.count_distinct("k") > 1).alias("differs"))
    return sizes.join(F.broadcast(kinds))


def legacy_components(df: DataFrame, names: dict[str, str], tr: float, skip: int = 0) -> DataFrame:
    """Columns of an older layout renamed (old name: new name), with times made from the profiles' length."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"not a table of the old layout: {missing} missing")
    renamed = df.withColumnsRenamed(names)
    return renamed.withColumn("times", F.transform(F.sequence(F.lit(0), F.size("profile") - 1), lambda k: (k + skip) * F.lit(tr)))


ROI_COLUMNS = "pair group_0 group_1 ml_model roi_index roi_label importance rank feature_set importance_method model_path".split()


def roi_importances(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The first of these CSV files or folders that holds region importances; a missing label is the region's number."""
    for path in paths:
        try:
            df = spark.read.csv(path, header=True, recursiveFileLookup=True)
        except AnalysisException:  # no such path
            continue
        if {"pair", "ml_model", "importance"} <= set(df.columns):
            kinds = {"roi_index": "int", "importance": "double", "rank": "int", "feature_set": "int"}
            found = df.select(*[F.expr(f"try_cast(`{c}` as {kinds.get(c, 'string')})").alias(c) if c in df.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in ROI_COLUMNS])
            place = F.row_number().over(Window.partitionBy("pair", "ml_model").orderBy(F.desc("importance"), F.desc("roi_index")))
            return found.withColumn("roi_label", F.coalesce("roi_label", F.concat(F.lit("roi_"), "roi_index"))).withColumn("rank", F.coalesce("rank", place))
    raise FileNotFoundError(f"no region importances in {list(paths)}")


def write_sorted(df: DataFrame, path: str, order: Sequence[Column | str], digits: int = 6) -> None:
    """A result table as CSV parts in a total order, doubles rounded: summaries, similarities, RSA metrics."""
    rounded = df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
    rounded.orderBy(*order).write.mode("overwrite").csv(path, header=True)


def one_mask_for_all(images: DataFrame, mask: DataFrame) -> DataFrame:
    """mask (x, y, z, y_t), the rows of a single image -> as masks of every image of images (path, ...)."""
    return images.select("path").distinct().crossJoin(mask.select("x", "y", "z", "y_t"))


def tagged(path: str, now: datetime | None = None, **parameters) -> str:
    """path with a date tag and the run's parameters, in order of their names, as a result folder's name."""
    names = "_".join(f"{k}-{v}" for k, v in sorted(parameters.items()))
    return "_".join(filter(None, [path.rstrip("/"), f"{now or datetime.now():%Y%m%d_%H%M%S}", names]))


def checked_pairs(pairs: Sequence[Sequence[str]], known: Sequence[str]) -> list[tuple[str, str]]:
    """Pairs of different known groups, each once in either order; what breaks this is an error."""
    out: list[tuple[str, str]] = []
    for pair in pairs:
        if len(pair) != 2 or pair[0] == pair[1]:
            raise ValueError(f"not a pair of two groups: {list(pair)}")
        if set(pair) - set(known):
            raise ValueError(f"unknown groups: {sorted(set(pair) - set(known))}")
        if tuple(sorted(pair)) in {tuple(sorted(p)) for p in out}:
            raise ValueError(f"given twice: {list(pair)}")
        out.append((pair[0], pair[1]))
    return out
