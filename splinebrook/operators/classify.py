"""Pair classifiers as pyspark.ml pipelines: fitted and stored for each (pair, model), the newest loaded to score other rows.

A pipeline scales the features, keeps the k with the largest F statistic, and fits a classifier with balanced weights. The
features are a column of the table and stay on the cluster; a stored model is a folder that pyspark.ml writes and reads.
A pair is the same in either order: label 0 is the group that sorts first.

Features and labels meet once for all pairs, in a join by shuffle, and the subjects of the pairs' groups are stored by group: fits and
scores read the two folders of their pair. Nothing that grows with the subjects goes through the driver: neither labels as a
broadcast nor the results of a task for each shuffle partition in every pass of a fit.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, UnivariateFeatureSelector
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import classification_metrics
from .scratch import Steps

SEED = 42
LABEL, WEIGHT = "label", "weight"


def classifier(name: str) -> Estimator:
    """The classifier of a model's name."""
    columns = {"featuresCol": "selected", "labelCol": LABEL, "weightCol": WEIGHT}
    made = {
        "LR": lambda: LogisticRegression(maxIter=200, regParam=0.01, **columns),
        "SVM": lambda: LinearSVC(maxIter=100, regParam=0.01, **columns),
        "DTree": lambda: DecisionTreeClassifier(maxDepth=4, minInstancesPerNode=5, seed=SEED, **columns),
        "RandForest": lambda: RandomForestClassifier(numTrees=100, minInstancesPerNode=2, seed=SEED, **columns),
    }
    return made[name]()


@dataclass(frozen=True)
class Subjects:
    """Subjects of the groups that pairs name, stored by group until they are dropped."""

    rows: DataFrame  # (key, x, place); place is a group's place in groups
    groups: list[str]
    sizes: dict[str, int]
    steps: Steps

    def both(self, pair: tuple[str, str]) -> bool:
        """Whether there are subjects of both groups."""
        return pair[0] != pair[1] and all(self.sizes.get(g) for g in pair)

    def drop(self) -> None:
        self.steps.forget(keep=0)


def gathered(features: DataFrame, labels: DataFrame, pairs: Iterable[tuple[str, str]], key: str = "id", column: str = "x") -> Subjects:
    """features (key, x), labels (key, group) -> the subjects of all groups of the pairs."""
    groups = sorted({g for pair in pairs for g in pair})
    place = F.array_position(F.array(*map(F.lit, groups)).cast("array<string>"), F.col("group").cast("string"))
    own = labels.select(key, place.cast("int").alias("place")).filter("place > 0")
    rows = features.select(key, F.col(column).cast("array<double>").alias("x")).join(own.hint("merge"), key)
    steps = Steps(features.sparkSession, "subjects")
    rows = steps.save(rows.select(key, "x", "place"), "place")
    sizes = {groups[r["place"] - 1]: r["count"] for r in rows.groupBy("place").count().collect()}  # a row for each group
    return Subjects(rows, groups, sizes, steps)


def labelled(subjects: Subjects, pair: tuple[str, str], key: str = "id") -> DataFrame:
    """(key, features, label, weight) of the pair's two groups, weights balanced. subjects.both(pair) must hold."""
    places = [subjects.groups.index(g) + 1 for g in sorted(pair)]
    total = sum(subjects.sizes[g] for g in pair)
    of = lambda values: F.when(F.col("place") == places[0], values[0]).otherwise(values[1])
    weights = [total / (2.0 * subjects.sizes[g]) for g in sorted(pair)]
    return subjects.rows.filter(F.col("place").isin(places)).select(key, array_to_vector("x").alias("features"), of([0.0, 1.0]).alias(LABEL), of(weights).alias(WEIGHT))


def fit(rows: DataFrame, model: str, k: int = 20) -> PipelineModel:
    """rows as labelled gives them."""
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    select = UnivariateFeatureSelector(featuresCol="scaled", outputCol="selected", labelCol=LABEL, selectionMode="numTopFeatures")
    select = select.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k)
    return Pipeline(stages=[scale, select, classifier(model)]).fit(rows)


def folder_of(root: str, pair: tuple[str, str], model: str) -> str:
    return f"{root}/ml_{'_vs_'.join(sorted(pair))}/{model}"


def store(fitted: PipelineModel, root: str, pair: tuple[str, str], model: str, tag: str) -> str:
    """Write a fitted pipeline under root; tags sort by time."""
    path = f"{folder_of(root, pair, model)}/{tag}"
    fitted.write().overwrite().save(path)
    return path


def discard(spark: SparkSession, root: str) -> None:
    """Delete all models under root. Loaded ones stay as they are."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def newest(spark: SparkSession, root: str, pair: tuple[str, str], model: str) -> PipelineModel | None:
    """The stored pipeline with the greatest tag; None if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(folder_of(root, pair, model))
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    tags = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
    return PipelineModel.load(f"{folder_of(root, pair, model)}/{max(tags)}") if tags else None


def scored(fitted: PipelineModel, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows (key, y, predicted, score): score is the probability of label 1, or the margin where there is none."""
    out = fitted.transform(rows)
    score = vector_to_array("probability")[1] if "probability" in out.columns else vector_to_array("rawPrediction")[1]
    return out.select(key, F.col(LABEL).cast("int").alias("y"), F.col("prediction").cast("int").alias("predicted"), score.alias("score"))


def train_all(features: DataFrame, labels: DataFrame, pairs: Iterable[tuple[str, str]], models: Iterable[str], root: str, tag: str, key: str = "id", column: str = "x", k: int = 20) -> list[str]:
    """Fit and store every model of every pair that has both groups; the paths written."""
    pairs, paths = list(pairs), []
    subjects = gathered(features, labels, pairs, key, column)
    try:
        for pair in filter(subjects.both, pairs):
            rows = labelled(subjects, pair, key)
            paths += [store(fit(rows, model, k), root, pair, model, tag) for model in models]
    finally:
        subjects.drop()
    return paths


def evaluate_all(features: DataFrame, labels: DataFrame, pairs: Iterable[tuple[str, str]], models: Iterable[str], root: str, key: str = "id", column: str = "x") -> DataFrame | None:
    """Rows (pair, ml_model, n, tn, ..., balanced_accuracy, auc): the newest stored models on other subjects.

    Pairs without a stored model, or with subjects of one group only, are left out.
    """
    out, spark = None, features.sparkSession
    pairs, models = list(pairs), list(models)
    steps, subjects = Steps(spark, "scores"), gathered(features, labels, pairs, key, column)
    try:
        for pair in filter(subjects.both, pairs):
            rows = labelled(subjects, pair, key)
            for model in models:
                fitted = newest(spark, root, pair, model)
                if fitted is None:
                    continue
                metrics = classification_metrics(steps.save(scored(fitted, rows, key)), "y", "predicted", "score")
                named = metrics.select(F.lit(" vs ".join(sorted(pair))).alias("pair"), F.lit(model).alias("ml_model"), "*")
                out = named if out is None else out.unionByName(named)
    finally:
        subjects.drop()
    return out
