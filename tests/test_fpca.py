import numpy as np
import pytest

from splinebrook.functions.basis import penalty
from splinebrook.operators.fpca import FpcaModel, best_voxels, choose_basis_size, fit_series, smoother_for
from splinebrook.sources.tables import signals


def frame(spark, x, column="c"):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], f"voxel_id long, {column} array<double>")


def test_model_against_numpy(spark):
    rng = np.random.default_rng(0)
    x, a = rng.standard_normal((200, 6)) * np.arange(1, 7), rng.standard_normal((6, 6))
    u = a @ a.T
    m = FpcaModel.fit(frame(spark, x), 3, u)
    c = x - x.mean(axis=0)
    sigma = c.T @ c @ u / len(x)
    sigma = (sigma + sigma.T) / 2
    assert np.allclose(sigma @ m.vectors, m.vectors * m.values)
    assert np.allclose(m.vectors.T @ m.vectors, np.eye(3), atol=1e-10)
    assert np.isclose(m.total, np.trace(sigma))
    got = m.transform(frame(spark, x)).orderBy("voxel_id").collect()
    assert np.allclose([r["s"] for r in got], c @ u @ m.vectors)


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_partitions_do_not_matter(spark, sf, parts):
    coeffs = fit_series(signals(spark, sf).repartition(parts), smoother_for(64)).select("voxel_id", "c")
    m = FpcaModel.fit(coeffs, 4, penalty(0, 47.25, 12, 3, 0))
    n = FpcaModel.fit(coeffs.coalesce(1), 4, penalty(0, 47.25, 12, 3, 0))
    assert np.allclose(m.values, n.values)


def test_skip_and_save(spark, tmp_path):
    m = FpcaModel.fit(frame(spark, np.random.default_rng(1).standard_normal((50, 5))), 4, f=np.ones((3, 5)))
    s = m.skip([1, -1])
    assert np.allclose(s.values, m.values[[0, 2]])
    m.save(spark, str(tmp_path / "m"))
    back = FpcaModel.load(spark, str(tmp_path / "m"))
    assert np.allclose(back.vectors, m.vectors) and np.allclose(back.f, m.f) and back.total == m.total


def test_best_voxel_ties(spark):
    df = frame(spark, np.array([[1.0, 5.0], [3.0, 5.0], [3.0, 2.0]]), "s")
    assert sorted(map(tuple, best_voxels(df).collect())) == [(0, 1, 3.0), (1, 0, 5.0)]


def test_basis_size(spark, sf):
    s = signals(spark, sf)
    assert choose_basis_size(s, [9], 64, 0.0) == 9
    assert choose_basis_size(s, [0], 64, 0.0) == 64
    assert choose_basis_size(s, [6, 12], 64, 10.0) == 6
    with pytest.raises(ValueError):
        FpcaModel.fit(s.filter("false"), 1, column="y")
