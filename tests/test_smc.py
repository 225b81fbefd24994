"""Trajectories and tempered particles."""

from __future__ import annotations

import math

import numpy as np
import pytest

from sparkbayes.functions import expr as E
from sparkbayes.operators import smc


def chain(kernel, look, start, step, n, **kw):
    x, out = np.asarray(start, dtype=float), []
    for i in range(n):
        [(x, _)] = smc.side_by_side([smc.KERNELS[kernel](x, look(x[None])[0], step, np.random.default_rng([7, i]), **kw)], look)
        out.append(x)
    return np.array(out)


def gaussian(points):
    s = np.array([1.0, 3.0])
    return [(float(-0.5 * ((p / s) ** 2).sum()), -p / s**2) for p in points]


@pytest.mark.parametrize("kernel", ["nuts", "hmc"])
def test_kernels_keep_the_distribution(kernel):
    x = chain(kernel, gaussian, [0.0, 0.0], 0.6, 4000)
    assert abs(x.mean(axis=0)).max() < 0.25 and np.allclose(x.std(axis=0), [1, 3], rtol=0.1)
    assert np.isclose(np.mean(np.abs(x[:, 0]) < 1), 0.683, atol=0.04)


def test_trajectories_stop_where_they_turn():
    asked = []

    def look(points):
        asked.append(len(points))
        return [(float(-0.5 * p @ p), -p) for p in points]

    smc.side_by_side([smc.no_u_turn(np.ones(2), look(np.ones((1, 2)))[0], 0.5, np.random.default_rng(i), depth=10) for i in range(20)], look)
    assert 3 <= len(asked) < 40  # far fewer than 2^10 steps


def test_particles_on_a_tables_likelihood(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(1.2, 0.5, size=300)
    df = spark.createDataFrame([(float(v),) for v in y], "y double").repartition(4)
    m, s = E.param("m"), E.param("s")
    likelihood, prior = E.normal(E.data("y"), m, E.exp(s)), E.normal(m, 0.0, 2.0) + E.normal(s, 0.0, 1.0)
    x, report = smc.fit_smc(df, likelihood, prior, ["m", "s"], ["y"], lambda r: r.normal(size=2) * [2.0, 1.0], particles=120, moves=2, step=0.05, depth=3, seed=1)
    assert report["lambda"].iloc[-1] == 1.0 and abs(x[:, 0].mean() - y.mean()) < 0.03 and abs(np.exp(x[:, 1]).mean() - y.std()) < 0.03
    assert 0.5 < x[:, 0].std() / (y.std() / math.sqrt(300)) < 1.6
    with pytest.raises(ValueError):
        smc.fit_smc(df, likelihood, prior, ["m", "s"], ["y"], lambda r: r.normal(size=2), kernel="nope")


def test_two_modes_keep_their_weights(spark):
    """One row whose likelihood has modes at -0.5 and 0.5 in each of two dimensions, weighted 0.1 and 0.9."""
    df = spark.createDataFrame([(1.0,)], "one double")
    a, b = E.param("a"), E.param("b")
    bump = lambda at, w: E.exp(math.log(w) + E.normal(a, at * E.data("one"), 0.1) + E.normal(b, at * E.data("one"), 0.1))
    likelihood, prior = E.log(bump(-0.5, 0.1) + bump(0.5, 0.9) + 1e-300), E.normal(a, 0.0, 1.0) + E.normal(b, 0.0, 1.0)
    x, report = smc.fit_smc(df, likelihood, prior, ["a", "b"], ["one"], lambda r: r.normal(size=2), particles=600, moves=1, step=0.1, depth=2, seed=3)
    assert abs(np.mean(x[:, 0] > 0) - 0.9) < 0.08 and (np.sign(x[:, 0]) == np.sign(x[:, 1])).mean() > 0.98
    assert abs(x[x[:, 0] > 0].std(axis=0) - 0.1).max() < 0.03 and abs(report.attrs["log_evidence"] - math.log(0.154)) < 0.4
