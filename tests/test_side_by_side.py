"""Filters of batches of series against the filter of one series."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkbayes.operators import side_by_side as B
from sparkbayes.operators import statespace as S

OUTPUTS = ["filtered", "filtered_cov", "predicted", "predicted_cov", "observed", "observed_cov", "loglike"]


def made(seed: int, m: int, p: int, times: int = 0) -> S.StateSpace:
    rng = np.random.default_rng(seed)
    near = lambda k: np.eye(k) + 0.1 * rng.normal(size=(k, k))
    square = lambda k: near(k) @ np.diag(rng.uniform(0.5, 2, k)) @ near(k).T
    cov = lambda k: (lambda a: (a + a.T) / 2)(square(k))
    return S.StateSpace(T=0.7 * near(m), Z=rng.normal(size=(times, p, m)) if times else rng.normal(size=(p, m)), R=near(m), H=np.diag(rng.uniform(0.5, 1, p)), Q=cov(m), x0=rng.normal(size=m), P0=cov(m), c=rng.normal(size=m), d=rng.normal(size=p))


def column(series: list[np.ndarray]) -> pa.Array:
    return pa.array([y.ravel().tolist() for y in series], pa.list_(pa.float64()))


@pytest.mark.parametrize("m,p,times,missing", [(1, 1, 0, False), (2, 1, 0, True), (2, 1, 12, True), (3, 2, 0, True), (3, 2, 9, False), (6, 2, 0, True)])
def test_batches_are_the_single_series(m, p, times, missing):
    rng = np.random.default_rng(m * 100 + times)
    series = [rng.normal(size=(n, p)) for n in (1, 9, 4, 12, 12, 7)]
    if missing:
        for y in series[1:4]:
            y[rng.uniform(size=y.shape) < 0.4] = np.nan
    model, seen = made(m, m, p, times), []
    for kind in B.STEPS:
        if kind == "convergent" and (times or missing):
            continue
        for places, sizes, ys in B.side_by_side(column(series), p, m):
            got = B.filtered(model, sizes, ys, kind)
            a, P = B.smoothed(model, sizes, got)
            total = B.filtered(model, sizes, ys, kind, keep=False)["loglike"]
            for i, s in enumerate(places):
                one, n = S.kalman(model, series[s], kind), sizes[i]
                for k in OUTPUTS:
                    assert np.allclose(got[k][i if len(got[k]) > 1 else 0, :n], getattr(one, k), rtol=1e-9, atol=1e-9), (kind, k)
                mean, cov = S.smooth(model, one)
                assert np.allclose(a[i, :n], mean) and np.allclose(P[i, :n], cov) and np.isclose(total[i], one.loglike.sum())
                seen.append((kind, s))
    assert len(seen) == len({*seen}) and len(seen) % len(series) == 0


def test_models_of_their_own():
    rng = np.random.default_rng(5)
    series, models = [rng.normal(size=(n, 1)) for n in (5, 8, 8)], [made(1, 2, 1)] * 3
    models = [S.StateSpace(T=x.T, Z=rng.normal(size=(n, 1, 2)), R=x.R, H=x.H, Q=x.Q, x0=x.x0 + n, P0=x.P0) for x, n in zip(models, (7, 8, 9), strict=True)]
    series[1][2] = np.nan
    for places, sizes, ys in B.side_by_side(column(series), 1, 2):
        own = B.Stacked([models[s] for s in places], S.MATRICES)
        got = B.filtered(own, sizes, ys)
        a, _ = B.smoothed(own, sizes, got)
        for i, s in enumerate(places):
            one = S.kalman(models[s], series[s])
            assert np.allclose(got["filtered"][i, : sizes[i]], one.filtered) and np.allclose(a[i, : sizes[i]], S.smooth(models[s], one)[0])


def test_a_step_moves_all_series(monkeypatch):
    """1,000 series of 20 values each take 20 steps, not 20,000, and share their covariances."""
    calls = []
    for kind, step in [*B.STEPS.items()]:
        monkeypatch.setitem(B.STEPS, kind, lambda a, P, *rest, step=step: (calls.append(P.shape), step(a, P, *rest))[1])
    model = made(2, 2, 1)
    for kind in B.STEPS:
        calls.clear()
        for _, sizes, ys in B.side_by_side(column([np.full((20, 1), float(i)) for i in range(1000)]), 1, 2):
            B.filtered(model, sizes, ys, kind, keep=False)
        assert 0 < len(calls) <= 20 and {*calls} == {(1, 2, 2)}


def test_batches_are_bounded():
    sizes = np.array([10, 200_000, 200_000, 10, 3_000_000] + [50] * 5000)
    found = [*B.batches(sizes, np.arange(len(sizes)) % 2 == 0, 4)]
    assert sorted(np.concatenate(found).tolist()) == [*range(len(sizes))]
    assert all(len(x) == 1 or len(x) <= B.SIDE and len(x) * sizes[x].max() * 4 <= B.CELLS and len({*(x % 2)}) == 1 for x in found)


def test_tables_of_series_in_any_order(spark):
    """Times of which one is unknown, missing values, and series of one value: as the kernel of one series has it."""
    rng = np.random.default_rng(9)
    ys = {q: rng.normal(size=n) for q, n in (("a", 6), ("b", 1), ("c", 3))}
    rows = [(q, None if q == "a" and t == 5 else t, None if q == "c" and t == 1 else float(v)) for q, y in ys.items() for t, v in enumerate(y)]
    rng.shuffle(rows)
    ys["c"][1] = np.nan
    df, model = spark.createDataFrame([(q, None if t is None else int(t), None if v is None else float(v)) for q, t, v in rows], "q string, t int, y double"), made(4, 2, 1)
    got = {(r["q"], r["t"]): r for r in S.filter_series(df, model, "q", ["t"], ["y"], smoothed=True).collect()}
    want = {q: S.kalman(model, y) for q, y in ys.items()}
    assert len(got) == 10
    for (q, t), r in got.items():
        assert np.allclose(r["filtered"], want[q].filtered[t]) and np.allclose(r["smoothed_cov"], S.smooth(model, want[q])[1][t].ravel()) and np.isclose(r["loglike"], want[q].loglike[t])
    sums = S.loglikes(df, model, "q", ["t"], ["y"], ["standard", "cholesky"]).groupBy("q").agg(F.sum("loglike").alias("x")).collect()
    assert all(np.isclose(r["x"], 2 * want[r["q"]].loglike.sum()) for r in sums)


def in_batches(df) -> bool:
    plan = df._jdf.queryExecution().toString()
    return "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_likelihoods_go_in_batches(spark):
    df = spark.createDataFrame([("a", 0, 1.0)], "q string, t int, y double")
    assert in_batches(S.loglike(df, made(4, 2, 1), "q", ["t"], ["y"], kind="convergent"))
    with pytest.raises(Exception, match="no missing values"):
        S.loglike(df.unionByName(df.select("q", "t", F.lit(None).cast("double").alias("y"))), made(4, 2, 1), "q", ["t"], ["y"], kind="convergent").collect()


def test_outputs_go_in_batches(spark):
    df = spark.createDataFrame([("a", 0, 1.0)], "q string, t int, y double")
    assert in_batches(S.filter_series(df, made(4, 2, 1), "q", ["t"], ["y"], smoothed=True))


@pytest.mark.parametrize("n_lags", [1, 2])
def test_hidden_chains_side_by_side(n_lags):
    """As each sequence by itself, also with transitions that vary with time."""
    from sparkbayes.operators import markov

    rng = np.random.default_rng(n_lags)
    k, sizes = 3, np.array([2, 7, 4, 7])
    logs = rng.normal(size=(4, 7, k))
    for shape in ((k**n_lags,), (8, k**n_lags)):
        p, init = rng.dirichlet(np.ones(k), shape), rng.dirichlet(np.ones(k**n_lags))
        got = markov.smoothed_side_by_side(logs, sizes, p, init, n_lags)
        for i, n in enumerate(sizes):
            alpha, beta, total = markov.hmm_kernel(logs[i, :n], p[: n - n_lags] if p.ndim == 3 else p, init, n_lags)
            joint = np.exp(alpha + beta - total)
            single = joint.reshape(len(joint), k, -1).sum(axis=2)
            for j in range(1, n_lags):
                single = np.vstack([single, joint[-1].reshape(k**j, k, -1).sum(axis=(0, 2))])
            assert np.allclose(got[i, :n], single)
