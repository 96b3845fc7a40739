import hashlib

import numpy as np
import pytest

from splinebrook.operators import crossval as X
from splinebrook.operators.learning import Logistic, Pipeline, balanced_accuracy


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((48, 150))
    x[:20, [3, 70, 149]] += 1.2
    return x, np.array([0] * 20 + [1] * 28)


@pytest.fixture(scope="module")
def frames(spark, data):
    x, y = data
    features = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    rows = [("all", i, int(c)) for i, c in enumerate(y)] + [("few", i, int(c)) for i, c in enumerate(y) if i % 5 == 0] + [("alone", 0, 0), ("alone", 47, 1)]
    return features, spark.createDataFrame([*rows, ("all", 999, 1)], "pair string, id long, y int")


def placed(ids, y):
    return sorted(ids, key=lambda i: (y[i], hashlib.md5(str(i).encode()).hexdigest(), i))


def plain(pair, x, y, ids, fits, k, grid, seed=42, folds=3):
    """{(permutation, fold, at, place): mean score} by whole pipelines over the pair's rows, one fit after another."""
    order = placed(ids, y)
    x, parts, out = x[order], X.Parts(int(sum(y[i] == 0 for i in order)), int(sum(y[i] == 1 for i in order)), folds), {}
    for fit in fits:
        role = X.played(parts, fit[0], seed)
        labels = parts.classes()[role]
        rows = np.repeat(np.arange(parts.n), X.row_weights(pair, parts, fit, seed)[role].astype(int))
        unseen = np.flatnonzero(parts.trains(fit[1], fit[2])[1][role])
        for at, g in enumerate(grid):
            made = Pipeline(Logistic, "anova", {}, g["k"]).fit(x[rows], labels[rows], None)
            for p, s in zip(unseen, made.score(x[unseen]), strict=True):
                out.setdefault((fit[0], fit[1], at, int(p)), []).append(s)
    return {key: np.mean(s) for key, s in out.items()}, parts, order


GRID = [{"k": 4}, {"k": 9}]


def test_parts_are_stratified():
    q = X.Parts(20, 28, 5)
    y, at = q.classes(), q.outer()
    assert all(abs((at[y == c] == f).sum() - (y == c).sum() / 5) < 1 for c in (0, 1) for f in range(5))
    train, unseen = q.trains(2, 1)
    assert not (train & unseen).any() and not train[at == 2].any() and not unseen[at == 2].any()
    assert X.Parts(2, 9, 5).outer().tolist() == list(range(11))  # each its own


@pytest.mark.parametrize("pair", ["all", "few"])
def test_nested_cv_against_whole_pipelines(spark, data, frames, pair):
    x, y = data
    ids = range(48) if pair == "all" else range(0, 48, 5)
    got = {r.id: r for r in X.nested_cv(*frames, "LR", GRID, folds=3).filter(f"pair = '{pair}'").collect()}
    none, parts, order = plain(pair, x, y, ids, [], 9, GRID)
    outer = plain(pair, x, y, ids, X.fits_of(parts, [0], nested=False), 9, GRID)[0]
    inner = plain(pair, x, y, ids, X.fits_of(parts, [0], nested=True), 9, GRID)[0]
    labels = parts.classes()
    assert got.keys() == set(ids)
    for fold in np.unique(parts.outer()):
        accuracy = []
        for at in range(len(GRID)):
            seen = [(labels[p], s) for (_, f, a, p), s in inner.items() if f == fold and a == at]
            accuracy.append(balanced_accuracy(np.array([v for v, _ in seen]), np.array([s for _, s in seen])))
        best = int(np.argmax(np.round(accuracy, 12)))
        for place in np.flatnonzero(parts.outer() == fold):
            assert got[order[place]].cv_prob == pytest.approx(outer[0, int(fold), best, int(place)], abs=1e-6)


def test_pairs_without_two_rows_of_a_class_are_left_out(frames):
    assert {r.pair for r in X.nested_cv(*frames, "SVM", [{"k": 5}], folds=3).select("pair").distinct().collect()} == {"all", "few"}


def test_permutations_against_whole_pipelines(data, frames, monkeypatch):
    x, y = data
    features, labels = frames
    got = X.permutation_test(features, labels.filter("pair = 'few'"), "LR", [{"k": 4}], n=12, folds=3).first()
    ids = range(0, 48, 5)
    _, parts, _ = plain("few", x, y, ids, [], 4, GRID)
    every = plain("few", x, y, ids, X.fits_of(parts, list(range(13)), nested=False), 4, [{"k": 4}])[0]
    accuracy = []
    for k in range(13):
        labels = parts.classes()[X.played(parts, k, 42)]
        found = sorted((p, s) for (q, _, _, p), s in every.items() if q == k)
        accuracy.append(balanced_accuracy(labels, np.array([s for _, s in found])))
    assert got.balanced_accuracy == pytest.approx(accuracy[0])
    assert got.p == pytest.approx((sum(a >= accuracy[0] - 1e-12 for a in accuracy[1:]) + 1) / 13)


def test_importances_against_whole_pipelines(data, frames):
    x, y = data
    got = {r.feature_idx: r for r in X.importances(*frames, "LR", k=6).filter("pair = 'all'").collect()}
    order, parts = placed(range(48), y), X.Parts(20, 28, 5)
    want = np.zeros(150)
    fits = X.fits_of(parts, [0], nested=False, outer=False)
    for fit in fits:
        rows = np.repeat(np.arange(48), X.row_weights("all", parts, fit, 42).astype(int))
        want += Pipeline(Logistic, "anova", {}, 6).fit(x[order][rows], parts.classes()[rows], None).importance()[0] / len(fits)
    assert np.allclose([got[f].weight for f in range(150)], want, atol=1e-6)
    assert all(r.selected == (r.weight > 0) for r in got.values())


def test_columns_travel_once_for_all_fits_of_a_unit(frames):
    """Not once for each fit that chose them: 20 permutations' bags share the few columns of a narrow study."""
    features, labels = frames
    columns, _, parts = X.study(features.select("id", X.F.slice("x", 1, 12).alias("x")), labels.filter("pair = 'all'"), 3)
    fits = {p: X.fits_of(q, list(range(1, 21)), nested=False) for p, q in parts.items()}
    units = X.units_of(parts, fits, 12)
    assert len(units["all"]) == 20 * 3 * X.BAGS and max(np.bincount(units["all"])) == X.BAGS
    columns, chosen = columns.cache(), X.chosen_features(columns, parts, fits, units, 9, 42).cache()
    sent = X.by_unit(columns, chosen, units, lambda picked, frame: X.pd.DataFrame({"fits": [picked["fit"].nunique()], "columns": [len(frame)]}), "fits int, columns int").collect()
    assert len(sent) == 60 and all(r.fits == X.BAGS and 9 <= r["columns"] <= 12 for r in sent)
