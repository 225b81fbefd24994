"""Low-rank Gaussians, paths in many dimensions, and log-determinants by quadrature."""

from __future__ import annotations

import math

import numpy as np
import pytest

from sparkbayes.operators import inference as I
from sparkbayes.operators import numeric as N
from sparkbayes.operators.low_rank import LowRank


@pytest.mark.parametrize("n,J", [(4, 0), (4, 2), (6, 6), (12, 5)])
def test_low_rank_equals_dense(n, J):
    rng = np.random.default_rng(n + J)
    A = rng.normal(size=(n, n))
    A = A @ A.T + np.eye(n)
    S = [rng.normal(size=n) for _ in range(J)]
    Y = [A @ s for s in S]
    alpha = rng.uniform(0.5, 2, n)
    H, want = LowRank(alpha, S, Y), I.inverse_hessian(alpha, S, Y)
    assert np.allclose(H.dense(), want) and np.isclose(H.logdet(), np.linalg.slogdet(want)[1])
    v = rng.normal(size=n)
    assert np.allclose(H.times(v), want @ v)
    u = rng.normal(size=(3, n))
    x = H.moved(u)
    assert np.allclose(H.moved(np.eye(n)).T @ H.moved(np.eye(n)), want)
    assert np.allclose(H.logq(u), [-0.5 * (e @ np.linalg.solve(want, e) + n * math.log(2 * math.pi) + np.linalg.slogdet(want)[1]) for e in x])


def test_five_thousand_parameters():
    n = 5000
    scale = np.linspace(0.5, 2.0, n)
    look = lambda x: (float(-0.5 * ((x / scale) ** 2).sum()), -x / scale**2)
    p = I.pathfinder_path(look, np.zeros(n), np.random.default_rng(0), draws=50, elbo_draws=3)
    assert p.status == "CONVERGED" and p.chosen == "SUCCESS" and p.draws.shape == (50, n)
    plain = -0.5 * (scale**-2.0).sum() + 0.5 * n * (1 + math.log(2 * math.pi))  # the bound of independent unit variances
    assert np.isfinite(p.draws).all() and abs(p.elbo - plain) < 200 and p.updates > 1


def test_statuses():
    assert [I.search_status(*x) for x in ((0, 1, "CONVERGED"), (1, 5, "CONVERGED"), (5, 20, "CONVERGED"), (5, 10, "CONVERGED"), (5, 9, "NON_FINITE"), (9, 9, "MAX_ITER_REACHED"))] == ["INIT_FAILED", "INIT_FAILED_LOW_UPDATE_PCT", "LOW_UPDATE_PCT", "CONVERGED", "NON_FINITE", "MAX_ITER_REACHED"]
    nowhere = I.pathfinder_path(lambda x: (float("nan"), x), np.zeros(2), np.random.default_rng(0))
    assert nowhere.status == "INIT_FAILED" and nowhere.chosen == "LBFGS_FAILED" and not len(nowhere.draws)

    def cliff(x):
        if x[0] > 1:
            return float("nan"), x
        return float(-0.5 * (x - 3) @ (x - 3) + 0.1 * x[0] ** 3), -(x - 3) + np.array([0.3 * x[0] ** 2, 0.0])

    assert I.pathfinder_path(cliff, np.zeros(2), np.random.default_rng(1), draws=5).status in ("CONVERGED", "NON_FINITE", "INIT_FAILED", "INIT_FAILED_LOW_UPDATE_PCT", "LOW_UPDATE_PCT")


def test_the_report_counts_all_paths(spark):
    def look(x):
        if x[1] > 1.5:
            return float("nan"), x
        return float(-0.5 * x @ (x * np.array([1.0, 4.0]))), -x * np.array([1.0, 4.0])

    table = I.run_paths(spark, look, np.zeros(2), paths=4, draws_per_path=10, seed=2).cache()
    report = I.path_report(table)
    assert sum(report.values()) == 4 and table.where("k >= 0").count() == 40


def test_tridiagonal_and_log_determinant(spark):
    rng = np.random.default_rng(0)
    A = rng.normal(size=(6, 6))
    A = A @ A.T + np.eye(6)
    b = rng.normal(size=6)
    x, T = N.linear_cg(lambda v: A @ v, b, tridiagonal=True, tol=1e-13)
    assert np.allclose(A @ x, b) and np.allclose(np.linalg.eigvalsh(T[:6, :6]), np.linalg.eigvalsh(A), rtol=1e-4)
    e1 = np.linalg.solve(T, np.eye(len(T))[0])
    assert np.isclose(b @ x, (b @ b) * e1[0])  # b' A^-1 b from the tridiagonal matrix alone
    assert np.isclose(N.logdet_quadrature(lambda v: A @ v, 6), np.linalg.slogdet(A)[1], rtol=1e-6)
    wide = np.diag(np.linspace(1, 3, 40)) + 0.01
    assert abs(N.logdet_quadrature(lambda v: wide @ v, 40, probes=60, steps=60) / np.linalg.slogdet(wide)[1] - 1) < 0.05
    entries = spark.createDataFrame([(i, j, float(A[i, j])) for i in range(6) for j in range(6)], "i int, j int, v double")
    assert np.isclose(N.logdet_quadrature(N.table_matvec(entries, 6), 6, probes=1, steps=12, seed=1), N.logdet_quadrature(lambda v: A @ v, 6, probes=1, steps=12, seed=1))
