import numpy as np
import pytest
from pyspark.sql import functions as F

from splinebrook.operators import classify, relational as R, rsa


def test_models_are_stored_and_score_other_subjects(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.standard_normal(12) + (2.0 if i % 2 else 0.0) * (np.arange(12) < 3)).tolist(), "a" if i % 2 else "b") for i in range(160)]
    df = spark.createDataFrame(rows, "id long, x array<double>, group string")
    train, test, root = df.filter("id < 100"), df.filter("id >= 100"), str(tmp_path)
    paths = classify.train_all(train, train, [("a", "b"), ("a", "none")], ["LR", "SVM", "DTree"], root, "t1", k=4)
    assert len(paths) == 3
    classify.train_all(train.withColumn("group", F.lit("a")).unionByName(train.limit(2).withColumn("group", F.lit("b"))), train, [("a", "b")], ["LR"], root, "t0", k=4)
    got = {r["ml_model"]: r for r in classify.evaluate_all(test, test, [("b", "a"), ("a", "none")], ["LR", "SVM", "DTree", "RandForest"], root).collect()}
    assert got.keys() == {"LR", "SVM", "DTree"} and all(r["n"] == 60 for r in got.values())
    assert all(r["balanced_accuracy"] > 0.85 and r["pair"] == "a vs b" for r in got.values()) and got["LR"]["auc"] > 0.95
    assert classify.newest(spark, root, ("x", "y"), "LR") is None


def sent_to_driver(spark, since: int) -> tuple[int, int]:
    """Bytes that tasks of stages numbered `since` and above sent to the driver, and the next stage's number."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    stages = [stages.apply(k) for k in range(stages.size())]
    return sum(s.resultSize() for s in stages if s.stageId() >= since), max([since, *(s.stageId() + 1 for s in stages)])


def test_little_reaches_the_driver(spark, tmp_path):
    """Neither labels nor features go through the driver, whatever their number."""
    sent, (_, at) = {}, sent_to_driver(spark, 0)
    for n in (400, 40_000):
        ids = spark.range(n)
        x = F.array(*[F.xxhash64("id", F.lit(k)) % 1000 / 1000.0 + (F.col("id") % 2) * int(k < 2) for k in range(6)])
        df = ids.select("id", x.alias("x"), F.when(F.col("id") % 2 == 1, "a").otherwise("b").alias("group"))
        classify.train_all(df, df, [("a", "b")], ["LR"], f"{tmp_path}/{n}", "t", k=4)
        found = classify.evaluate_all(df, df, [("a", "b")], ["LR"], f"{tmp_path}/{n}").collect()
        assert [r["n"] for r in found] == [n]
        sent[n], at = sent_to_driver(spark, at)
    assert 0 < sent[400] and sent[40_000] < 3 * sent[400]


def test_subjects_are_stored_once_by_group_until_dropped(spark):
    rows = [(0, [1.0], "a"), (1, [2.0], "b"), (2, [3.0], ""), (3, [4.0], None), (4, None, "b"), (5, [6.0], "a"), (5, [6.0], "b"), (6, [7.0], "z")]
    df = spark.createDataFrame(rows, "id long, x array<double>, group string")
    features, labels = df.select("id", "x").dropDuplicates(["id"]), df.select("id", "group")
    subjects = classify.gathered(features, labels, [("b", "a"), ("a", ""), ("a", "a"), ("a", "none")])
    assert subjects.sizes == {"a": 2, "b": 3, "": 1}
    assert [subjects.both(p) for p in [("b", "a"), ("a", ""), ("a", "a"), ("a", "none")]] == [True, True, False, False]
    got = {(r["id"], r["label"], r["weight"]) for r in classify.labelled(subjects, ("b", "a")).drop("features").collect()}
    assert got == {(0, 0.0, 1.25), (5, 0.0, 1.25), (1, 1.0, 5 / 6), (4, 1.0, 5 / 6), (5, 1.0, 5 / 6)}
    subjects.drop()
    assert not subjects.steps.paths
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        subjects.rows.count()


def test_global_ranks_without_one_window(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 300, 2000).astype(float)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "id long, v double")
    got = {r["id"]: r["mid_rank"] for r in R.mid_ranks(df, "v", []).collect()}
    assert [got[k] for k in range(2000)] == rsa.ranks(values).tolist()


def test_layouts():
    assert R.infer_layout(60, 6, 10) == "flat" and R.infer_layout(96, 6, 10) == "blocks"
    with pytest.raises(ValueError):
        R.infer_layout(61, 6, 10)


def test_rsa_over_targets(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, rng.standard_normal(8).tolist()) for k in range(24)], "id long, x array<double>")
    two = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(24)], "id long, label string")
    three = spark.createDataFrame([(k, "xyz"[k % 3]) for k in range(24)], "id long, label string")
    one = spark.createDataFrame([(k, "a") for k in range(24)], "id long, label string")
    got = rsa.analyse_targets(spark, df, "id", {"two": two, "three": three, "one": one}, n=50).collect()
    assert {r["target"] for r in got} == {"two", "three"} and len(got) == 3 + 6
    p = np.array(sorted(r["rsa_p"] for r in got))
    want = np.minimum(np.minimum.accumulate((p * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1], 1)
    assert np.allclose(sorted(r["rsa_q_global"] for r in got), want)
