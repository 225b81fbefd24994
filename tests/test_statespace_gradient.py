"""Gradients of filters against differences and direct densities; models with state-space likelihoods."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from dataclasses import replace

from sparkbayes.operators import inference as I
from sparkbayes.operators import statespace as S
from sparkbayes.operators import statespace_gradient as G
from sparkbayes.plans import model as M


def random_model(rng, m=3, p=2, r=2, times=0):
    lead = (times,) if times else ()
    psd = lambda k: (lambda x: x @ np.swapaxes(x, -1, -2) + 0.5 * np.eye(k))(rng.normal(size=(*lead, k, k)))
    P0 = rng.normal(size=(m, m))
    return S.StateSpace(T=0.4 * rng.normal(size=(*lead, m, m)), Z=rng.normal(size=(p, m)), R=rng.normal(size=(m, r)), H=psd(p), Q=psd(r), x0=rng.normal(size=m), P0=P0 @ P0.T + np.eye(m), c=rng.normal(size=m), d=rng.normal(size=(*lead, p)))


@pytest.mark.parametrize("times", [0, 4])
def test_gradients_equal_differences(times):
    rng = np.random.default_rng(times)
    model = random_model(rng, times=times)
    ys = rng.normal(size=(3, 6, 2))
    ys[0, 1, 0] = ys[1, 2] = ys[2, 4:] = np.nan
    value, grads = G.value_and_gradient(model, ys)
    assert math.isclose(value, sum(S.direct_logp(model, y) for y in ys), rel_tol=1e-9)
    for k in S.MATRICES:
        base = getattr(model, k)
        for at in np.ndindex(base.shape):
            up, down = base.copy(), base.copy()
            up[at] += 1e-6
            down[at] -= 1e-6
            if k in ("P0", "H", "Q"):  # a symmetric matrix moves on both sides
                up, down = (np.swapaxes(x, -1, -2) / 2 + x / 2 for x in (up, down))
            diff = (G.filtered(replace(model, **{k: up}), ys)[0].sum() - G.filtered(replace(model, **{k: down}), ys)[0].sum()) / 2e-6
            got = (grads[k] + np.swapaxes(grads[k], -1, -2))[at] / 2 if k in ("P0", "H", "Q") else grads[k][at]
            assert math.isclose(got, diff, rel_tol=1e-5, abs_tol=1e-5), (k, at)


def level(p):
    return S.StateSpace(T=[[1.0]], Z=[[1.0]], R=[[1.0]], H=[[math.exp(p["h"])]], Q=[[math.exp(p["q"])]], x0=[0.0], P0=[[10.0]])


@pytest.fixture(scope="module")
def walks(spark):
    rng, rows = np.random.default_rng(4), []
    for s in range(40):
        x = 0.0
        for t in range(20 + s):
            x += rng.normal() * 0.5
            rows.append((s, t, None if rng.uniform() < 0.1 else float(x + rng.normal() * 1.5)))
    return spark.createDataFrame(rows, "s int, t int, y double").repartition(6).cache()


def test_a_node_of_a_model(spark, walks):
    model = M.Model((M.rv("h", "Normal", mu=0.0, sigma=2.0), M.rv("q", "Normal", mu=M.Ref("h", 0.5), sigma=3.0)))
    model = M.with_statespace(model, "y", level, ["h", "q"], series="s", time=["t"], observed=["y"])
    series = {}
    for r in walks.orderBy("t").collect():
        series.setdefault(r.s, []).append(np.nan if r.y is None else r.y)
    at = {"h": 0.3, "q": -1.0}
    normal = lambda x, m, s: -0.5 * ((x - m) / s) ** 2 - math.log(s) - 0.5 * math.log(2 * math.pi)
    f = lambda h, q: sum(S.kalman(level({"h": h, "q": q}), np.array(y)).loglike.sum() for y in series.values()) + normal(h, 0, 2) + normal(q, 0.5 * h, 3)
    assert math.isclose(M.model_logp(model, walks, at), f(0.3, -1.0), rel_tol=1e-9)
    target = M.statespace_target(model, walks)
    value, g, hess = target(np.array([0.3, -1.0]))
    e = 1e-5
    assert math.isclose(value, f(0.3, -1.0), rel_tol=1e-9)
    assert np.allclose(g, [(f(0.3 + e, -1) - f(0.3 - e, -1)) / (2 * e), (f(0.3, -1 + e) - f(0.3, -1 - e)) / (2 * e)], rtol=1e-5)
    x, seen, _ = I.find_map(target, np.array([0.0, 0.0]))
    grid = max(((f(h, q), h, q) for h in x[0] + np.linspace(-0.2, 0.2, 9) for q in x[1] + np.linspace(-0.2, 0.2, 9)))
    assert np.allclose(grid[1:], x, atol=1e-6) and abs(x[0] - math.log(2.25)) < 0.3 and abs(x[1] - math.log(0.25)) < 0.6
    assert np.linalg.eigvalsh(seen[2])[-1] < 0
    for method in ("bfgs", "lbfgs"):
        assert np.allclose(I.find_map(target, np.array([0.0, 0.0]), method=method)[0], x, atol=1e-3)
    with pytest.raises(ValueError):
        M.with_statespace(model, "z", level, ["nope"], series="s", time=["t"], observed=["y"])
    with pytest.raises(NotImplementedError):
        M.marginalize(model, ["h"])


def test_points_share_the_steps(monkeypatch):
    """Five points over 300 series of 10 values cost 10 steps, and say what each says by itself."""
    from sparkbayes.operators import side_by_side as B

    rng = np.random.default_rng(3)
    lists = pa.array([rng.normal(size=10).tolist() for _ in range(300)], pa.list_(pa.float64()))
    models = [S.StateSpace(T=[[0.9]], Z=[[1.0]], R=[[1.0]], H=[[h]], Q=[[1.0]], x0=[0.0], P0=[[2.0]]) for h in (0.5, 0.6, 1.0, 2.0, 3.0)]
    [(_, _, ys)] = [*B.side_by_side(lists, 1, 1, apart=False, points=len(models))]
    want, calls = [G.value_and_gradient(x, ys) for x in models], []
    monkeypatch.setattr(G, "inverse", lambda a: (calls.append(a.shape), B.inverse(a))[1])
    value, grads = G.values_and_gradients(G.Together(models), ys)
    assert len(calls) == 10
    assert all(math.isclose(value[i], v) and all(np.allclose(grads[k][i], g[k]) for k in g) for i, (v, g) in enumerate(want))
