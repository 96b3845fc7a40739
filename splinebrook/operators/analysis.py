"""A whole classification study as one stored run: out-of-fold scores, parameters, permutation tests, importances, final models.

A run is a folder, runs/<tag>, of tables: cv (pair, ml_model, id, y, cv_prob, cv_pred), permutation, importances and, written last,
report, which has a row for each pair with the figures and where its final model is. A run without its report is not there:
`report` and `evaluate` take the newest that has one, so a driver that is lost half-way leaves the run before in force. Nothing
of an older run is changed. Tags sort by time. Linear models (LR, SVM), whose features stay on the cluster throughout.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classify, crossval
from .relational import classification_metrics, mid_ranks
from .scratch import Steps


def pair_labels(labels: DataFrame, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """labels (id, group) -> (pair, id, y): 0 is the group that sorts first."""
    both = F.array(*[F.struct(F.lit(" vs ".join(sorted(p))).alias("pair"), *[F.lit(g).alias(c) for c, g in zip(("zero", "one"), sorted(p), strict=True)]) for p in pairs])
    rows = labels.select("id", "group", F.explode(both).alias("p"))
    return rows.select("p.pair", "id", F.when(F.col("group") == F.col("p.zero"), 0).when(F.col("group") == F.col("p.one"), 1).alias("y")).filter("y IS NOT NULL")


def performance(cv: DataFrame) -> DataFrame:
    """Rows (pair, n, tn, fp, fn, tp, accuracy, balanced_accuracy, auc) of out-of-fold scores."""
    hit = lambda y, p: F.sum(((F.col("y") == y) & (F.col("cv_pred") == p)).cast("long"))
    ranked = mid_ranks(cv, "cv_prob", ["pair"], "rank")
    ones = F.sum(F.col("y").cast("double"))
    sums = ranked.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"), F.sum(F.when(F.col("y") == 1, F.col("rank"))).alias("ranks"), ones.alias("ones"))
    auc = (F.col("ranks") - F.col("ones") * (F.col("ones") + 1) / 2) / (F.col("ones") * (F.col("n") - F.col("ones")))
    balanced = (F.col("tp") / (F.col("tp") + F.col("fn")) + F.col("tn") / (F.col("tn") + F.col("fp"))) / 2
    return sums.select("pair", "n", "tn", "fp", "fn", "tp", ((F.col("tn") + F.col("tp")) / F.col("n")).alias("accuracy"), balanced.alias("balanced_accuracy"), auc.alias("auc"))


def run(features: DataFrame, labels: DataFrame, pairs: Iterable[tuple[str, str]], model: str, root: str, tag: str, grid: list[dict], permutations: int = 200, folds: int = 5, seed: int = 42) -> DataFrame:
    """The report of a new run. features (id, x), labels (id, group) of the training subjects.

    Pairs without two subjects of each group are left out; a tag that has a report is an error.
    """
    spark = features.sparkSession
    pairs, folder = [tuple(sorted(p)) for p in pairs], f"{root}/runs/{tag}"
    if tag in tags(spark, root):
        raise ValueError(f"there is a run {tag} already")
    named = pair_labels(labels, pairs)

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    entries = crossval.chosen_entries(features, named, model, grid, seed)
    cv = stored(crossval.nested_cv(features, named, model, grid, folds, seed), "cv")
    tested = stored(crossval.permutation_test(features, named, model, grid, permutations, folds, seed), "permutation")
    found = None
    for k in sorted({e.get("k", 50) for e in entries.values()}):  # one pass for each number of features in the grid
        own = [p for p, e in entries.items() if e.get("k", 50) == k]
        part = crossval.importances(features, named.filter(F.col("pair").isin(own)), model, k, seed)
        found = part if found is None else found.unionByName(part)
    if found is not None:
        stored(found, "importances")
    paths = []
    kept = [pair for pair in pairs if " vs ".join(pair) in entries]
    subjects = classify.gathered(features, labels, kept)
    try:
        for pair in kept:
            name = " vs ".join(pair)
            k = entries[name].get("k", 50)
            paths.append((name, k, classify.store(classify.fit(classify.labelled(subjects, pair), model, k), f"{folder}/models", pair, model, tag)))
    finally:
        subjects.drop()
    models = spark.createDataFrame(paths, "pair string, k int, model_path string")
    report_rows = performance(cv).join(tested.select("pair", "permuted_mean", "permuted_sd", "p"), "pair").join(models, "pair")
    return stored(report_rows.withColumn("ml_model", F.lit(model)).withColumn("tag", F.lit(tag)), "report")


def tags(spark: SparkSession, root: str) -> list[str]:
    """Tags of the runs that have a report, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/runs")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
    whole = lambda t: system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/runs/{t}/report/_SUCCESS"))
    return sorted(t for t in names if whole(t))


def report(spark: SparkSession, root: str, tag: str | None = None) -> DataFrame:
    """The report of a run, the newest one by default."""
    known = tags(spark, root)
    if not known or (tag is not None and tag not in known):
        raise FileNotFoundError(f"no run {tag or ''} under {root}")
    return spark.read.parquet(f"{root}/runs/{tag or known[-1]}/report")


def evaluate(features: DataFrame, labels: DataFrame, root: str, tag: str | None = None) -> DataFrame:
    """Rows (pair, ml_model, n, tn, fp, fn, tp, accuracy, balanced_accuracy, auc) of a run's final models on other subjects.

    Pairs of which the subjects have one group only are left out.
    """
    spark, out, steps = features.sparkSession, None, Steps(features.sparkSession, "scores")
    stored = [(tuple(r["pair"].split(" vs ")), r) for r in report(spark, root, tag).select("pair", "ml_model", "model_path").collect()]  # a row for each pair
    subjects = classify.gathered(features, labels, [pair for pair, _ in stored])
    try:
        for pair, r in stored:
            if not subjects.both(pair):
                continue
            scores = steps.save(classify.scored(PipelineModel.load(r["model_path"]), classify.labelled(subjects, pair)))
            named = classification_metrics(scores, "y", "predicted", "score").select(F.lit(r["pair"]).alias("pair"), F.lit(r["ml_model"]).alias("ml_model"), "*")
            out = named if out is None else out.unionByName(named)
    finally:
        subjects.drop()
    kinds = "pair string, ml_model string, n long, tn long, fp long, fn long, tp long, accuracy double, balanced_accuracy double, auc double"
    return spark.createDataFrame([], kinds) if out is None else out
