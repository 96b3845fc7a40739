"""Comparison of the components of many files, for every set of parameters at once.

A file is one (params, movement, subject) with a few components, each with its coefficients `vec` and its time course
`signal`. Sets of parameters are a column, so a sweep is one job; a set's pairs of files are the result, and are rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import pearson
from . import similarity as S
from .timeseries import combine

FILE = ("params", "movement", "subject")


#: A set's files are dealt to this many tasks, each of which sees all of its partners.
DEALS = 32


def pairs_of_files(files: DataFrame, payload: str) -> DataFrame:
    """Pairs of files of one set of parameters, the one first that comes first by movement and subject."""
    a = files.select("params", F.struct("movement", "subject").alias("i"), F.col(payload).alias("a"))
    b = files.select("params", F.struct("movement", "subject").alias("j"), F.col(payload).alias("b"))
    a = a.withColumn("deal", F.pmod(F.xxhash64("i"), F.lit(DEALS)).cast("int"))
    b = b.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    return a.join(b, ["params", "deal"]).filter("i < j").drop("deal")


def subspaces(components: DataFrame) -> DataFrame:
    """(params, i, j, sim): similarity of the spaces that the files' coefficient vectors span."""
    files = components.groupBy(*FILE).agg(F.transform(F.array_sort(F.collect_list(F.struct("pc", "vec"))), lambda c: c["vec"]).alias("m"))
    pairs = pairs_of_files(files, "m")
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("params", "i", "j")}

    def run(batches):
        for batch in batches:
            sims = [S.subspace_similarity(np.array(a).T, np.array(b).T) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(sims, pa.float64())], ["params", "i", "j", "sim"])

    return pairs.select("params", "i", "j", "a", "b").mapInArrow(run, f"params {kinds['params']}, i {kinds['i']}, j {kinds['j']}, sim double")


def represented(components: DataFrame, how: str = "correlated", pc: int = 0, target: Sequence[float] | None = None, threshold: float = 0.1) -> DataFrame:
    """(params, movement, subject, y): one signal a file. fixed: component `pc`; correlated: the component that the movement's
    other files follow best; combined: the signed sum of the components that follow `target`. A file without any is left out."""
    if how == "fixed":
        return components.filter(F.col("pc") == pc).select(*FILE, F.col("signal").alias("y"))
    if how == "combined":
        long = combine(components, [float(v) for v in target or []], threshold, "signal", FILE)
        listed = long.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("t", "combined"))).alias("m"))
        return listed.select(*FILE, F.col("m.combined").alias("y"))
    if how != "correlated":
        raise ValueError(f"unknown representation {how!r}")
    group = ["params", "movement"]
    a = components.select(*group, F.col("subject").alias("file"), "pc", F.col("signal").alias("a"))
    b = components.select(*group, F.col("subject").alias("other"), F.col("pc").alias("other_pc"), F.col("signal").alias("b"))
    corr = a.join(b, group).filter("file <> other").select(F.struct(*group, "file").alias("file"), "pc", "other", "other_pc", pearson(F.col("a"), F.col("b")).alias("r"))
    best = S.representatives(corr).select("file.params", "file.movement", F.col("file.file").alias("subject"), F.col("rep_pc").alias("pc"))
    return components.join(best, [*FILE, "pc"]).select(*FILE, F.col("signal").alias("y"))


def warped(signals: DataFrame) -> DataFrame:
    """(params, i, j, sim, flipped): time warping of the files' signals, the better of both signs."""
    pairs = pairs_of_files(signals, "y")
    keyed = pairs.select(F.struct("params", "i").alias("i"), F.struct("params", "j").alias("j"), "a", "b")
    return S.dtw_pairs(keyed, oriented=True).select("i.params", "i.i", "j.j", "sim", "flipped")


def consistency(similar: DataFrame) -> DataFrame:
    """(params, score, one_minus_p): mean rank correlation, over pairs of movements, of their subjects' similarities, and one
    less the mean p. Sets with fewer than two movements or three pairs of subjects have no row."""
    inside = similar.filter("i.movement = j.movement").select("params", F.col("i.movement").alias("m"), F.col("i.subject").alias("si"), F.col("j.subject").alias("sj"), "sim")
    key = ["params", "si", "sj"]
    other = inside.select(*key, F.col("m").alias("n"), F.col("sim").alias("b"))
    both = inside.withColumnRenamed("sim", "a").join(other, key).filter("m < n")
    counts = both.groupBy("params", "m", "n").agg(F.count(F.lit(1)).alias("k")).filter("k >= 3")
    rho = S.spearman(both.select("params", "m", "n", F.round("a", 12).alias("a"), F.round("b", 12).alias("b")), "a", "b", ["params", "m", "n"]).join(counts, ["params", "m", "n"])
    rho = rho.filter("rho IS NOT NULL AND NOT isnan(rho)")
    kind = rho.schema["params"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            p = [S.spearman_p(r, k) for r, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64())], ["params", "rho", "p"])

    tested = rho.select("params", "rho", "k").mapInArrow(run, f"params {kind}, rho double, p double")
    return tested.groupBy("params").agg(F.avg("rho").alias("score"), (1 - F.avg("p")).alias("one_minus_p"))


def compare(components: DataFrame, how: str = "subspace", **choice) -> tuple[DataFrame, DataFrame]:
    """The similarities of all pairs of files and the consistency of each set of parameters.

    how: subspace (coefficients), or the way in which one signal stands for a file (fixed, correlated, combined).
    """
    similar = subspaces(components) if how == "subspace" else warped(represented(components, how, **choice))
    return similar, consistency(similar)


def best_sets(scores: DataFrame, k: int = 10) -> DataFrame:
    """(by, params, value): the k sets of parameters of the largest absolute score, and those of the largest 1 - p."""

    def top(by: str, value: Column) -> DataFrame:
        return scores.select(F.lit(by).alias("by"), "params", value.alias("value")).orderBy(F.desc("value"), "params").limit(k)

    return top("score", F.abs("score")).unionByName(top("one_minus_p", F.col("one_minus_p")))
