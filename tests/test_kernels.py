import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from splinebrook.operators import learning, rsa, similarity as S, timeseries as T
from splinebrook.operators.learning import MODELS, Forest, Network, Tree, auc, balanced_accuracy, bags, fit_bag, folds, mean_score, nested_cv, parameter_grid, permutation_test, principal_plane
from splinebrook.plans import catalog


def plain_dtw(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = (x - y) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return float(np.sqrt(d[-1, -1]))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=12), st.lists(st.floats(-5, 5), min_size=1, max_size=12))
def test_dtw(a, b):
    x, y = np.array(a), np.array(b)
    assert np.isclose(S.dtw(x, y), plain_dtw(a, b))
    assert np.isclose(S.dtw(x, y), S.dtw(y, x)) and S.dtw(x, x) == 0


def test_subspaces_and_orientation():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((20, 3))
    assert np.isclose(S.subspace_similarity(a, a @ rng.standard_normal((3, 3))), 1)
    truth = rng.random(12) < 0.4
    flips = (truth[:, None] != truth[None, :]).astype(float)
    got = S.orientations(flips)
    assert (got == truth).all() or (got == ~truth).all()


def test_student_tail():
    assert np.isclose(S.student_tail(2.228, 10), 0.05, atol=2e-4)
    assert np.isclose(S.student_tail(0.0, 5), 1.0)
    assert np.isclose(S.student_tail(12.706, 1), 0.05, atol=1e-4)


def test_band_pass_keeps_the_band():
    t = np.arange(600) * 0.75
    slow, mid = np.sin(2 * np.pi * 0.002 * t), np.sin(2 * np.pi * 0.05 * t)
    out = T.band_pass(np.stack([slow, mid]), 0.02, 0.1, 0.75)
    assert np.abs(out[0, 100:-100]).max() < 0.02 and np.abs(out[1, 100:-100] - mid[100:-100]).max() < 0.02
    with pytest.raises(ValueError):
        T.butterworth(3, 0.1, 2.0, 0.66)


def test_resample_and_clean():
    t = np.arange(32)
    y = np.sin(2 * np.pi * 3 * t / 32)[None, :]
    assert np.allclose(T.resample(y, 64)[0, ::2], y[0])
    assert np.allclose(T.resample(T.resample(y, 64), 32), y)
    c = np.random.default_rng(0).standard_normal((32, 2))
    assert np.abs(T.clean(y + (c @ [3.0, -2.0])[None, :], c, False) @ (c - c.mean(axis=0))).max() < 1e-9


def test_thinned_peaks():
    y = np.array([0, 3, 0, 5, 0, 4, 0, 0, 1, 0.0])
    assert T.thinned_peaks(y).tolist() == [1, 3, 5, 8]
    assert T.thinned_peaks(y, 3).tolist() == [3, 8]


def test_morphology(spark):
    cells = [(x, y, z) for x in range(1, 5) for y in range(1, 5) for z in range(1, 5)] + [(7, 7, 7)]
    got = T.opened_and_closed(spark.createDataFrame(cells, "x int, y int, z int"), (9, 9, 9)).collect()
    assert sorted(map(tuple, got)) == sorted(cells[:-1])


def test_average_linkage():
    d = np.array([[0, 1, 9, 8], [1, 0, 9, 9], [9, 9, 0, 2], [8, 9, 2, 0.0]])
    assert rsa.average_linkage(d).tolist() == [0, 0, 1, 1]


def blobs(n=60, d=12, seed=0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    x = rng.standard_normal((n, d))
    x[:, :3] += 2.5 * y[:, None]
    return x, y


@pytest.mark.parametrize("model", list(MODELS))
def test_models_learn(model):
    x, y = blobs()
    rng = np.random.default_rng(1)
    params = {"clf": {"trees": 20}} if model == "RandForest" else {}
    fitted = fit_bag(model, params, x[:40], y[:40], False, rng)
    assert balanced_accuracy(y[40:], fitted.score(x[40:])) >= 0.8
    if model in ("LR", "SVM", "DTree"):
        assert bags(model, y[:40]) == 30 and balanced_accuracy(y[40:], mean_score(model, params, x[:40], y[:40], x[40:], rng)) >= 0.8
    weight, selected = fitted.importance()
    assert weight.shape == (12,) and selected.any() and weight[:3].mean() > weight[3:].mean()


def slow_tree(x, y, w, depth, leaf):
    """A tree by looking at every cut of every column, node by node."""
    mean = float(np.average(y, weights=w))
    if not depth or len(y) < 2 * leaf or y.min() == y.max():
        return mean
    gini = lambda rows: 2 * ((w * y)[rows].sum() - (w * y)[rows].sum() ** 2 / w[rows].sum())
    cuts = []
    for c in range(x.shape[1]):
        for v in np.unique(x[:, c])[:-1]:
            go = x[:, c] <= v
            if min(go.sum(), (~go).sum()) >= leaf:
                cuts.append((gini(go | ~go) - gini(go) - gini(~go), c, (v + x[~go, c].min()) / 2))
    if not cuts or max(cuts)[0] <= 1e-12:
        return mean
    _, c, cut = next(k for k in cuts if k[0] >= max(cuts)[0] - 1e-9)
    go = x[:, c] <= cut
    return c, cut, slow_tree(x[go], y[go], w[go], depth - 1, leaf), slow_tree(x[~go], y[~go], w[~go], depth - 1, leaf)


def test_trees_grown_by_level_equal_trees_grown_by_node():
    rng = np.random.default_rng(0)

    def fallen(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    for depth, leaf in [(4, 5), (2, 1), (6, 3)]:
        x = np.round(rng.normal(size=(90, 4)), 1)
        y, w = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=90) / 2 > 0).astype(int), rng.uniform(0.5, 2, 90)
        want = slow_tree(x, y, w, depth, leaf)
        assert Tree(depth, leaf).fit(x, y, w, rng).score(x) == pytest.approx([fallen(want, r) for r in x])
    constant = Forest(5).fit(np.ones((20, 3)), np.arange(20) % 2, np.ones(20), rng)
    assert not constant.importance().any() and np.abs(constant.score(np.ones((4, 3))) - 0.5).max() < 0.3


def test_network_latent():
    x, y = blobs()
    assert Network().fit(x, y, np.ones(len(y)), np.random.default_rng(0)).transform_latent(x).shape == (60, 8)


def test_cross_validation_and_permutations(spark):
    x, y = blobs()
    ids = np.arange(60)
    out = nested_cv(spark, x, ids, {"a vs b": y}, ["LR"], {"LR": parameter_grid('{"k": [3, 6], "c": [1.0]}')}, k=3).toPandas()
    assert len(out) == 60 and (out.cv_pred == out.y).mean() > 0.8
    assert permutation_test(spark, x, y, "LR", 0.9, n=19, k=3) <= 0.1
    assert len(np.unique(folds(np.array([0, 1, 1, 1, 1]), 3))) == 5
    assert auc(np.array([0, 0, 1, 1]), np.array([0.1, 0.4, 0.4, 0.9])) == 0.875
    assert principal_plane(x).shape == (60, 2)


def test_lag_search_climbs_until_it_settles(spark):
    y = [-abs(t - 22.0) for t in range(30)]
    days = spark.createDataFrame([(y,), ([2 * v for v in y],)], "y array<double>")
    lag, d, r = T.search_lag(days, 10.0, [2.0, 3.0], [1.0, 3.0, 5.0])
    corr = {(a, b): abs(np.corrcoef(y, [float(a <= t <= b) for t in range(30)])[0, 1]) for a in range(30) for b in range(a, 30) if b - a < 29}
    on = [t for t in range(30) if 10 + lag - 1e-9 <= t <= 10 + lag + d + 1e-9]
    assert r == pytest.approx(max(corr.values())) and r == pytest.approx(corr[on[0], on[-1]]) and len(on) > 9
    with pytest.raises(RuntimeError):
        T.search_lag(days, 10.0, [2.0, 3.0], [1.0, 3.0, 5.0], rounds=1)


def test_lag_search_reads_short_series_once(spark, monkeypatch):
    """The climb over all runs' values is that of a pass for each round; null, constant and longer series are left out."""
    rng = np.random.default_rng(4)
    rows = [(r.tolist(),) for r in rng.standard_normal((40, 30)).cumsum(axis=1)] + [([2.0] * 30,), (None,), ([1.0, None] * 15,)]
    days = spark.createDataFrame(rows, "y array<double>")
    args = (10.0, [float(v) for v in range(-3, 4)], [1.0, 3.0, 5.0])
    monkeypatch.setattr(T, "SHORT", 0)
    want = T.search_lag(days, *args)
    monkeypatch.setattr(T, "SHORT", 64)
    monkeypatch.setattr(T, "run_values", None)
    got = T.search_lag(days, *args)
    assert got[:2] == want[:2] and got[2] == pytest.approx(want[2])


@pytest.mark.parametrize("least", [12, 4])
def test_tree_study_of_tables_is_that_of_arrays(spark, least, monkeypatch):
    """Bagged and plain fits, features in several blocks, an id without features and one without a class."""
    monkeypatch.setattr(learning, "COLUMNS", 3)
    x, y = blobs()
    ids, y = np.arange(60), np.where(np.cumsum(y == 1) > least, 0, y) if least < 7 else y
    features = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, x, strict=True)], "id long, x array<double>")
    labels = spark.createDataFrame([("a vs b", int(i), int(c)) for i, c in zip(ids, y, strict=True)] + [("a vs b", 99, 1), ("a vs b", 3, None), ("one", 1, 1)], "pair string, id long, y int")
    monkeypatch.setattr(learning, "MOST_BYTES", 0)
    got = sorted(map(tuple, learning.tables_cv(features, labels, ["DTree"], k=3).collect()))
    want = sorted(map(tuple, nested_cv(spark, x, ids, {"a vs b": y}, ["DTree"], k=3).collect()))
    assert got == want and len(got) == 60


def test_trees_of_few_samples_at_a_time(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((80, 5))[rng.integers(0, 80, 80)]
    y, rows = rng.integers(0, 2, 80), rng.integers(0, 80, (9, 80))
    whole, gains = learning.grow(x, y, np.ones(80), rows, 6, 2, 2, np.random.default_rng(3))
    monkeypatch.setattr(learning, "SAMPLES", 100)
    some, same = learning.grow(x, y, np.ones(80), rows, 6, 2, 2, np.random.default_rng(3))
    assert all((a == b).all() for a, b in zip(whole, some, strict=True)) and np.allclose(gains, same)
    # equal rows that count several times are the rows themselves
    monkeypatch.setattr(learning, "distinct_samples", lambda x, y, w, rows: (rows.ravel(), np.repeat(np.arange(9), 80), np.ones(720, dtype=int)))
    plain, same = learning.grow(x, y, np.ones(80), rows, 6, 2, 2, np.random.default_rng(3))
    assert all((a == b).all() for a, b in zip(whole, plain, strict=True)) and np.allclose(gains, same)
