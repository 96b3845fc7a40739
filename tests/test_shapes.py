import numpy as np
import pytest

from splinebrook.operators import agglomerate as A, orientation as O, peaks as K, rsa
from splinebrook.operators.similarity import orientations
from splinebrook.operators.timeseries import thinned_peaks


@pytest.mark.parametrize("distance", [1, 2, 7, 40])
def test_peaks_over_segments(spark, monkeypatch, distance):
    """Two series over many segments, one with a long slope of ever higher peaks, so that chains run over borders."""
    monkeypatch.setattr(K, "SPAN", 2)
    rng = np.random.default_rng(0)
    t = np.arange(900)
    series = {"a": rng.standard_normal(900), "b": np.where(t % 2, t / 1000.0, -1.0), "c": np.round(rng.standard_normal(900), 1), "d": np.zeros(2)}
    rows = [(k, int(i), float(v)) for k, y in series.items() for i, v in enumerate(y)]
    got = {}
    for r in K.thinned(spark.createDataFrame(rows, "s string, t long, y double"), ["s"], distance).collect():
        got.setdefault(r.s, []).append(r.t)
    want = {k: thinned_peaks(y, distance).tolist() for k, y in series.items() if len(y) > 2}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_peaks_need_a_distance(spark):
    with pytest.raises(ValueError):
        K.thinned(spark.createDataFrame([(1, 1.0)], "t long, y double"), [], 0)


def test_orientation_of_two_camps(spark):
    rng = np.random.default_rng(1)
    turned = rng.random(14) < 0.4
    flips = (turned[:, None] != turned[None, :]) ^ (np.triu(rng.random((14, 14)) < 0.08, 1) | np.triu(rng.random((14, 14)) < 0.08, 1).T)
    flips = np.triu(flips, 1) | np.triu(flips, 1).T
    pairs = spark.createDataFrame([(i, j, bool(flips[i, j])) for i in range(14) for j in range(i + 1, 14)], "i long, j long, flipped boolean")
    got = {r.node: r for r in O.orientations(pairs).collect()}
    w = 1.0 - 2.0 * flips
    np.fill_diagonal(w, 0)
    values, vectors = np.linalg.eigh(w)
    lead = vectors[:, -1] * np.sign(vectors[0, -1] * got[0].loading)
    assert np.allclose([got[k].loading for k in range(14)], lead, atol=1e-4)
    found = np.array([got[k].flip for k in range(14)])
    assert (found == turned).all() or (found != turned).all()
    other = orientations(flips)
    assert (found == other).all() or (found != other).all()


def test_orientation_without_pairs(spark):
    assert O.orientations(spark.createDataFrame([(1, 2, None)], "i long, j long, flipped boolean")).count() == 0


def slow_linkage(d):
    clusters, merges = {k: [k] for k in range(len(d))}, []
    while len(clusters) > 1:
        h, a, b = min((round(float(np.mean(d[np.ix_(clusters[x], clusters[y])])), 12), x, y) for x in clusters for y in clusters if x < y)
        clusters[a] += clusters.pop(b)
        merges.append((a, b, h, len(clusters[a])))
    return merges


@pytest.mark.parametrize("n", [2, 3, 17])
def test_linkage_against_one_merge_at_a_time(spark, n):
    x = np.random.default_rng(n).standard_normal((n, 4))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=-1))
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(n) for j in range(i + 1, n)], "a long, b long, d double")
    merges, steps = A.average_linkage(pairs)
    got = sorted(((r.a, r.b, r.height, r["size"]) for r in merges.collect()), key=lambda m: m[2])
    want = slow_linkage(d)
    assert [(a, b, s) for a, b, _, s in got] == [(a, b, s) for a, b, _, s in want] and np.allclose([m[2] for m in got], [m[2] for m in want])
    two = {r.node: r.cluster for r in A.two_clusters(merges, steps).collect()}
    names = rsa.average_linkage(d)
    assert len(set(two.values())) == 2 and all((two[i] == two[j]) == (names[i] == names[j]) for i in range(n) for j in range(n))


def test_linkage_with_ties_and_without_pairs(spark):
    line = spark.createDataFrame([(i, j, float(j - i)) for i in range(5) for j in range(i + 1, 5)], "a long, b long, d double")
    merges, _ = A.average_linkage(line)
    assert merges.count() == 4 and {r["size"] for r in merges.filter("height > 1.6").collect()} >= {5}
    merges, steps = A.average_linkage(line.filter("false"))
    assert merges.count() == 0 and steps.count() == 0
