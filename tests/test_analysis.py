import numpy as np
import pytest

from splinebrook.operators import analysis, crossval as X

GRID = [{"k": 3}, {"k": 6}]


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(0)
    groups = np.array(["a"] * 14 + ["b"] * 12 + ["c"] * 4 + ["d"])
    x = rng.standard_normal((31, 70)) + (groups == "a")[:, None] * 2.5 * (np.arange(70) < 3)
    features = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    return features, spark.createDataFrame([(i, str(g)) for i, g in enumerate(groups)], "id long, group string")


@pytest.fixture(scope="module")
def done(spark, frames, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("runs"))
    analysis.run(*frames, [("b", "a"), ("c", "a"), ("a", "d")], "LR", root, "t1", GRID, permutations=8, folds=3)
    return root


def test_report_is_of_the_stored_tables(spark, frames, done):
    features, labels = frames
    rows = {r.pair: r for r in analysis.report(spark, done).collect()}
    assert rows.keys() == {"a vs b", "a vs c"}  # one d is not enough
    named = analysis.pair_labels(labels, [("a", "b"), ("a", "c")])
    cv = X.nested_cv(features, named, "LR", GRID, folds=3).collect()
    for pair, r in rows.items():
        own = [v for v in cv if v.pair == pair]
        assert r.n == len(own) and r.tp == sum(v.y == 1 and v.cv_pred == 1 for v in own) and r.fp == sum(v.y == 0 and v.cv_pred == 1 for v in own)
        assert r.balanced_accuracy == pytest.approx((r.tp / (r.tp + r.fn) + r.tn / (r.tn + r.fp)) / 2)
        zero, one = ([v.cv_prob for v in own if v.y == c] for c in (0, 1))
        assert r.auc == pytest.approx(np.mean([(o > z) + (o == z) / 2 for o in one for z in zero]))
    tested = {r.pair: r.p for r in X.permutation_test(features, named, "LR", GRID, 8, 3).collect()}
    assert {p: r.p for p, r in rows.items()} == pytest.approx(tested)
    assert {p: {"k": r.k} for p, r in rows.items()} == X.chosen_entries(features, named, "LR", GRID)
    assert spark.read.parquet(f"{done}/runs/t1/importances").count() == 140


def test_final_models_score_others(spark, frames, done):
    rng = np.random.default_rng(9)
    groups = ["a", "b"] * 15
    x = rng.standard_normal((30, 70)) + (np.array(groups) == "a")[:, None] * 2.5 * (np.arange(70) < 3)
    features = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    labels = spark.createDataFrame(list(enumerate(groups)), "id long, group string")
    found = analysis.evaluate(features, labels, done).collect()
    assert [r.pair for r in found] == ["a vs b"] and found[0].n == 30 and found[0].balanced_accuracy > 0.85
    assert analysis.evaluate(features, labels.filter("group = 'a'"), done).count() == 0


def test_a_run_without_its_report_is_not_there(spark, frames, done, monkeypatch):
    def lost(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(analysis.classify, "store", lost)
    with pytest.raises(KeyboardInterrupt):
        analysis.run(*frames, [("a", "b")], "LR", done, "t2", GRID[:1], permutations=2, folds=3)
    assert analysis.tags(spark, done) == ["t1"] and analysis.report(spark, done).first().tag == "t1"
    monkeypatch.undo()
    analysis.run(*frames, [("a", "b")], "LR", done, "t2", GRID[:1], permutations=2, folds=3)
    assert analysis.tags(spark, done) == ["t1", "t2"] and analysis.report(spark, done).first().tag == "t2"
    with pytest.raises(ValueError):
        analysis.run(*frames, [("a", "b")], "LR", done, "t2", GRID[:1])
    with pytest.raises(FileNotFoundError):
        analysis.report(spark, done, "t9")
