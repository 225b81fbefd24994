"""Modes within bounds, by Hessian-vector products, and over many basins."""

from __future__ import annotations

import numpy as np
import pytest

from sparkbayes.functions import expr as E
from sparkbayes.operators import inference as I
from sparkbayes.operators import optimize as O


@pytest.fixture(scope="module")
def logistic(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = rng.uniform(size=400) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "x double, z double, y int").cache()
    names = ["a", "b", "c"]
    logit = E.param("a") + E.param("b") * E.data("x") + E.param("c") * E.data("z")
    prior = sum((E.normal(E.param(n), 0.0, 3.0) for n in names[1:]), E.normal(E.param("a"), 0.0, 3.0))
    return I.table_target(df, E.bernoulli_logit(E.data("y"), logit), prior, names)


def test_products_are_the_hessian_times_a_vector(logistic):
    x, v = np.array([0.3, 0.8, -1.0]), np.array([1.0, -2.0, 0.5])
    value, g, h = logistic(x)
    got = logistic.slopes(x)
    assert np.isclose(got[0], value) and np.allclose(got[1], g) and np.allclose(logistic.product(x, v), h @ v)


def test_trust_region_finds_the_same_mode(logistic):
    want, _, _ = I.find_map(logistic, np.zeros(3))
    x, seen, info = I.find_map(logistic, np.zeros(3), method="trust-ncg")
    assert np.allclose(x, want, atol=1e-5) and info["products"] > 0 and np.max(np.abs(seen[1])) < 1e-3
    with pytest.raises(ValueError):
        I.find_map(I.function_target(["a"], lambda x: -x @ x, lambda x: -2 * x), np.ones(1), method="trust-ncg")


@pytest.mark.parametrize("method", ["newton", "lbfgs"])
def test_bounds(logistic, method):
    inner, _, info = I.find_map(logistic, np.zeros(3), method=method, bounds=[(-10, 10), (None, None), (None, 10)])
    assert np.allclose(inner, I.find_map(logistic, np.zeros(3))[0], atol=1e-4) and info["at_bound"] == []
    x, seen, info = I.find_map(logistic, np.zeros(3), method=method, bounds=[(None, None), (None, 0.5), (-1.0, None)])
    assert x[1] == 0.5 and x[2] == -1.0 and info["at_bound"] == ["b", "c"]
    assert abs(seen[1][0]) < 1e-3 and seen[1][1] > 0 and seen[1][2] < 0
    with pytest.raises(ValueError):
        I.find_map(logistic, np.zeros(3), bounds=[(0, 1)])
    with pytest.raises(ValueError):
        I.find_map(logistic, np.zeros(3), bounds=[(2, 1)] * 3)


def bumps():
    """Many modes; the highest is at (2, -1)."""
    value = lambda x: float(-0.05 * ((x[0] - 2) ** 2 + (x[1] + 1) ** 2) + np.cos(3 * (x[0] - 2)) + np.cos(3 * (x[1] + 1)))
    slope = lambda x: np.array([-0.1 * (x[0] - 2) - 3 * np.sin(3 * (x[0] - 2)), -0.1 * (x[1] + 1) - 3 * np.sin(3 * (x[1] + 1))])
    return I.function_target(["x", "y"], value, slope)


def test_hops_leave_poor_basins():
    start = np.array([-4.0, 5.0])
    assert I.find_map(bumps(), start)[1][0] < 1
    x, seen, info = I.find_map(bumps(), start, method="basinhopping", hops=40, chains=4, step=2.5, seed=3)
    assert np.allclose(x, [2, -1], atol=1e-4) and np.isclose(seen[0], 2) and info["modes"] > 3
    inside, _, _ = I.find_map(bumps(), start, method="basinhopping", hops=20, chains=3, step=2.5, bounds=[(None, 1.0), (None, None)])
    assert inside[0] <= 1.0


def test_chains_share_their_looks():
    passes = []

    def many(points):
        passes.append(len(points))
        return [(-float(p @ p), -2 * p, -2 * np.eye(2)) for p in points]

    target = I.Target(["x", "y"], lambda x: many([x])[0], many=many)
    lo, hi = O.limits(None, 2)
    found = O.together(target, [O.climb(np.array([float(i), 1.0]), lo, hi) for i in range(5)])
    assert all(np.allclose(x, 0) for x, _ in found) and max(passes) == 5 and len(passes) <= 4
