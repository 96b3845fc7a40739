"""B-spline bases, roughness penalties and the prepared smoothing problem: small matrices for the driver."""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np

log = logging.getLogger(__name__)

#: Added to the penalty, so that directions it does not see keep a little weight at very large lambdas.
RIDGE = 1e-12


def times(n: int, skip: int = 0, tr: float = 0.75) -> np.ndarray:
    """Seconds of the volumes that are left after the first `skip`."""
    return np.arange(skip, skip + n) * tr


def knots(t_min: float, t_max: float, k: int, degree: int) -> np.ndarray:
    """Clamped knots with equal steps inside, for k functions."""
    if k <= degree:
        raise ValueError("a basis needs more functions than its degree")
    return np.concatenate([np.full(degree, t_min), np.linspace(t_min, t_max, k - degree + 1), np.full(degree, t_max)])


def evaluate(t: np.ndarray, knot: np.ndarray, degree: int, derivative: int = 0) -> np.ndarray:
    """Values (or derivatives) of all functions at t; the right end belongs to the last interval."""
    t = np.asarray(t, dtype=float)
    count = len(knot) - 1
    last = np.max(np.flatnonzero(knot[1:] > knot[:-1]))
    value = ((knot[:-1] <= t[:, None]) & (t[:, None] < knot[1:])).astype(float)
    value[t == knot[-1]] = 0.0
    value[t == knot[-1], last] = 1.0

    def ratio(a, b):
        return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=np.broadcast_to(b != 0, np.broadcast(a, b).shape))

    for d in range(1, degree + 1):
        n = count - d
        width_l, width_r = knot[d : d + n] - knot[:n], knot[d + 1 : d + 1 + n] - knot[1 : 1 + n]
        if d > degree - derivative:  # the upper steps of the recursion become differences
            value = d * (ratio(value[:, :n], width_l[None, :]) - ratio(value[:, 1 : n + 1], width_r[None, :]))
        else:
            left = ratio(t[:, None] - knot[None, :n], width_l[None, :])
            right = ratio(knot[None, d + 1 : d + 1 + n] - t[:, None], width_r[None, :])
            value = left * value[:, :n] + right * value[:, 1 : n + 1]
    return value


def basis(t: np.ndarray, k: int, degree: int = 3, strict: bool = True) -> np.ndarray:
    """The basis at times t. Its rows must sum to one (checked on 400 points): an error if strict, else a warning."""
    knot = knots(float(t[0]), float(t[-1]), k, degree)
    grid = np.linspace(float(t[0]), float(t[-1]), 400)
    if np.abs(evaluate(grid, knot, degree).sum(axis=1) - 1).max() > 1e-10:
        if strict:
            raise ValueError("the basis functions do not sum to one")
        log.warning("the basis functions do not sum to one")
    return np.nan_to_num(evaluate(t, knot, degree))


def penalty(t_min: float, t_max: float, k: int, degree: int = 3, derivative: int = 2, method: str = "exact") -> np.ndarray:
    """Integrals of the products of derivatives: exact (Gauss-Legendre in each knot span), or trapezoid on 1000 points."""
    knot = knots(t_min, t_max, k, degree)
    if method == "trapezoid":
        grid = np.linspace(t_min, t_max, 1000)
        weights = np.full(1000, grid[1] - grid[0])
        weights[[0, -1]] /= 2
    elif method == "exact":
        nodes, w = np.polynomial.legendre.leggauss(degree + 1)
        spans = [(a, b) for a, b in zip(knot[:-1], knot[1:]) if b > a]
        grid = np.concatenate([(a + b) / 2 + (b - a) / 2 * nodes for a, b in spans])
        weights = np.concatenate([(b - a) / 2 * w for a, b in spans])
    else:
        raise ValueError(f"unknown method {method!r}")
    values = evaluate(grid, knot, degree, derivative)
    return values.T @ (weights[:, None] * values)


def lambdas(low: float = -6, high: float = 12, count: int = 100) -> np.ndarray:
    return np.unique(np.logspace(low, high, count))


@dataclass(frozen=True)
class Smoother:
    """A penalised least-squares problem in coordinates where data and penalty are both diagonal.

    V'F'FV = I and V'(P + ridge)V = diag(mu), so for any lambda the coefficients are V (z / (1 + lambda mu)), z = V'F'y.
    """

    f: np.ndarray
    v: np.ndarray
    mu: np.ndarray

    @staticmethod
    def prepare(f: np.ndarray, p: np.ndarray, ridge: float = RIDGE) -> Smoother:
        gram = f.T @ f
        try:
            low = np.linalg.cholesky(gram)
        except np.linalg.LinAlgError:
            low = np.linalg.cholesky(gram + 1e-10 * np.trace(gram) / len(gram) * np.eye(len(gram)))
        inverse = np.linalg.inv(low)
        mu, u = np.linalg.eigh(inverse @ (p + ridge * np.eye(len(p))) @ inverse.T)
        return Smoother(f, inverse.T @ u, np.maximum(mu, 0))

    @property
    def to_z(self) -> np.ndarray:
        return self.v.T @ self.f.T

    def gcv(self, y: np.ndarray, grid: np.ndarray) -> np.ndarray:
        """Generalised cross-validation scores (rows of y) x (lambdas)."""
        n = y.shape[1]
        z = y @ self.to_z.T
        shrink = 1 / (1 + grid[:, None] * self.mu[None, :])
        rest = (y * y).sum(axis=1)[:, None] - (z * z) @ (2 * shrink - shrink**2).T
        # a series in the basis' span has no rest but rounding
        rest = np.maximum(rest, 0)
        return rest / n / (1 - shrink.sum(axis=1)[None, :] / n) ** 2

    def fit(self, y: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coefficients, chosen lambdas (the first of the best) and their scores."""
        scores = self.gcv(y, grid)
        best = scores.argmin(axis=1)
        chosen = grid[best]
        z = y @ self.to_z.T
        return (z / (1 + chosen[:, None] * self.mu[None, :])) @ self.v.T, chosen, scores[np.arange(len(y)), best]


def ridge_solve(f: np.ndarray, p: np.ndarray, lam: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(F'F + lambda_i P) c_i = F'y_i, row by row in one batched solve."""
    a = f.T @ f + lam[:, None, None] * p
    return np.linalg.solve(a, (y @ f)[:, :, None])[:, :, 0]


def hat_gcv(f: np.ndarray, p: np.ndarray, lam: float, y: np.ndarray) -> np.ndarray:
    """The same score from the hat matrix; only to hold the fast form against."""
    n = len(f)
    rest = np.eye(n) - f @ np.linalg.solve(f.T @ f + lam * (p + RIDGE * np.eye(len(p))), f.T)
    return n * ((y @ rest.T) ** 2).sum(axis=1) / np.trace(rest) ** 2
