import numpy as np
import pytest

from splinebrook.operators import compare, similarity as S, timeseries as T

SCHEMA = "params string, movement int, subject int, pc int, vec array<double>, signal array<double>"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((5, 3, 12))
    return {(p, m, s, c): base[s, c] + noise * rng.standard_normal(12) for p, noise in (("a", 0.1), ("b", 2.0)) for m in (1, 2, 3) for s in range(5) for c in range(3)}


@pytest.fixture(scope="module")
def components(spark, data):
    return spark.createDataFrame([(*k, v.tolist(), (v * 2).tolist()) for k, v in data.items()], SCHEMA)


def slow_rho(sims, params):
    """Mean rank correlation over pairs of movements, and p, from a dictionary of similarities."""
    pairs = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    rows = {m: ranked([sims[params, m, i, j] for i, j in pairs]) for m in (1, 2, 3)}
    rho = [np.corrcoef(rows[m], rows[n])[0, 1] for m in (1, 2, 3) for n in (1, 2, 3) if m < n]
    return np.mean(rho), 1 - np.mean([S.spearman_p(r, len(pairs)) for r in rho])


def ranked(x):
    return np.argsort(np.argsort(x)).astype(float)


def test_subspaces_and_consistency(components, data):
    similar, scores = compare.compare(components)
    assert similar.count() == 2 * 15 * 14 // 2
    got = {r["params"]: r for r in scores.collect()}
    sims = {}
    for p in "ab":
        for m in (1, 2, 3):
            for i in range(5):
                for j in range(i + 1, 5):
                    a, b = (np.array([data[p, m, s, c] for c in range(3)]).T for s in (i, j))
                    cos = np.linalg.svd(np.linalg.qr(a)[0].T @ np.linalg.qr(b)[0])[1]
                    sims[p, m, i, j] = (cos**2).sum() / 3
        assert (got[p]["score"], got[p]["one_minus_p"]) == pytest.approx(slow_rho(sims, p))
    assert got["a"]["score"] > 0.8 > got["b"]["score"]
    best = compare.best_sets(scores, 1).collect()
    assert [(r["by"], r["params"]) for r in best] == [("score", "a"), ("one_minus_p", "a")]


def test_representatives_and_warping(components, data):
    similar, scores = compare.compare(components, "fixed", pc=1)
    sims = {}
    for p in "ab":
        for m in (1, 2, 3):
            for i in range(5):
                for j in range(i + 1, 5):
                    a, b = data[p, m, i, 1] * 2, data[p, m, j, 1] * 2
                    sims[p, m, i, j] = 1 / (1 + min(S.dtw(a, b), S.dtw(-a, b)))
    for r in scores.collect():
        assert (r["score"], r["one_minus_p"]) == pytest.approx(slow_rho(sims, r["params"]))
    chosen = compare.represented(components, "correlated").collect()
    assert len(chosen) == 30
    for r in chosen:
        totals = [sum(max(np.corrcoef(data[r["params"], r["movement"], r["subject"], c], data[r["params"], r["movement"], o, k])[0, 1] ** 2 for k in range(3)) for o in range(5) if o != r["subject"]) for c in range(3)]
        assert r["y"] == pytest.approx((data[r["params"], r["movement"], r["subject"], int(np.argmax(totals))] * 2).tolist())
    target = data["a", 1, 0, 1].tolist()
    combined = {(r["params"], r["movement"], r["subject"]): r["y"] for r in compare.represented(components, "combined", target=target).collect()}
    x = [data["a", 1, 0, c] * 2 for c in (1, 2)]
    r = [np.corrcoef(v, target)[0, 1] for v in x]
    assert combined["a", 1, 0] == pytest.approx(sum(np.sign(k) * v for k, v in zip(r, x, strict=True) if abs(k) > 0.1).tolist())
    with pytest.raises(ValueError):
        compare.represented(components, "none")


def test_no_files_and_too_few(spark, components):
    nothing = spark.createDataFrame([], SCHEMA)
    for how in ("subspace", "fixed", "correlated"):
        similar, scores = compare.compare(nothing, how)
        assert similar.count() == 0 and scores.count() == 0
    _, scores = compare.compare(components.filter("movement = 1"))
    assert scores.count() == 0


def test_lag_of_each_component_is_that_of_a_search_over_it_alone(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.standard_normal(20).tolist()) for k in range(4)] + [(4, [1.0] * 20)]
    df = spark.createDataFrame(rows, "pc int, y array<double>")
    got = {r["pc"]: r for r in T.search_lags(df, 4.0, [0.0, 2.0, 4.0], [1.0, 3.0]).collect()}
    for k in range(4):
        want = T.search_lag(df.filter(f"pc = {k}"), 4.0, [0.0, 2.0, 4.0], [1.0, 3.0])
        assert (got[k]["lag"], got[k]["duration"], got[k]["abs_r"]) == pytest.approx(want)
    assert np.isnan(got[4]["abs_r"])
