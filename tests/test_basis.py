import numpy as np
import pytest

from splinebrook.functions.basis import Smoother, basis, evaluate, hat_gcv, knots, lambdas, penalty, ridge_solve, times


@pytest.mark.parametrize("k,degree", [(4, 3), (12, 3), (7, 2), (20, 1)])
def test_rows_sum_to_one(k, degree):
    t = times(64)
    assert np.abs(basis(t, k, degree).sum(axis=1) - 1).max() < 1e-12


def test_right_end_is_closed():
    t = times(10)
    assert basis(t, 5)[-1].tolist() == [0, 0, 0, 0, 1]


def test_too_few_functions():
    with pytest.raises(ValueError):
        knots(0, 1, 3, 3)


@pytest.mark.parametrize("derivative", [0, 1, 2])
def test_penalties_agree(derivative):
    exact, rough = (penalty(0, 100, 5, 3, derivative, m) for m in ("exact", "trapezoid"))
    assert np.allclose(exact, rough, rtol=5e-5, atol=5e-5 * np.abs(exact).max())


def test_derivative_is_the_slope():
    knot, t, h = knots(0, 10, 8, 3), np.linspace(0.1, 9.9, 50), 1e-5
    slope = (evaluate(t + h, knot, 3) - evaluate(t - h, knot, 3)) / (2 * h)
    assert np.allclose(evaluate(t, knot, 3, 1), slope, atol=1e-6)


def test_gcv_equals_hat_matrix_and_ridge():
    rng = np.random.default_rng(42)
    f, r = rng.standard_normal((50, 10)), rng.standard_normal((10, 10))
    p, y, grid = r.T @ r, rng.standard_normal((30, 50)), np.logspace(-3, 3, 20)
    s = Smoother.prepare(f, p)
    assert np.allclose(s.gcv(y, grid), np.stack([hat_gcv(f, p, lam, y) for lam in grid], axis=1), rtol=1e-6)
    c, chosen, score = s.fit(y, grid)
    assert np.abs(c - ridge_solve(f, p + 1e-12 * np.eye(10), chosen, y)).max() < 1e-8
    assert np.allclose(score, s.gcv(y, grid).min(axis=1))


def test_lambda_grid():
    assert len(lambdas()) == 100 and np.isclose(lambdas()[0], 1e-6) and np.isclose(lambdas()[-1], 1e12)
