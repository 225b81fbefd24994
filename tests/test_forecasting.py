"""Forecasts from any time, under scenarios and draws, against the kernels on single series."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkbayes.operators import forecasting as C
from sparkbayes.operators import statespace as S


def build(p, X):
    h = p.get("h", 0.5)
    Z = np.concatenate([np.ones((len(X), 1)), X], axis=1)[:, None, :]
    return S.StateSpace(T=np.eye(2), Z=Z, R=[[1.0], [0.0]], H=[[h]], Q=[[0.3]], x0=[0.0, 0.0], P0=np.eye(2) * 4)


N, AHEAD = 12, 4
RNG = np.random.default_rng(2)
XS = {s: RNG.normal(size=N + AHEAD) for s in ("a", "b")}
YS = {s: np.cumsum(RNG.normal(size=N)) + 2 * XS[s][:N] for s in ("a", "b")}
DAY = lambda t: datetime.date(2020, 1, 1) + datetime.timedelta(days=3 * t)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(s, DAY(t), None if (s, t) == ("a", 3) else float(YS[s][t]), float(XS[s][t])) for s in XS for t in range(N)], "s string, day date, y double, x double").repartition(5)


@pytest.fixture(scope="module")
def ahead(spark):
    return spark.createDataFrame([(s, DAY(t), float(XS[s][t])) for s in XS for t in range(N, N + AHEAD)], "s string, day date, x double").repartition(3)


def wanted(s, at, steps, output, h=0.5):
    y = YS[s].copy()
    if s == "a":
        y[3] = np.nan
    model = build({"h": h}, XS[s][:, None])
    f = S.kalman(model, y[:, None])
    a, P = {"filtered": (f.filtered, f.filtered_cov), "predicted": (f.predicted, f.predicted_cov), "smoothed": S.smooth(model, f)}[output]
    return S.forecast(model, a[at], P[at], steps, start=at)


def check(got, at, steps, output):
    found = {(r.s, r.step): r for r in got.collect()}
    assert len(found) == 2 * steps
    for s in XS:
        mean, cov = wanted(s, at, steps, output)
        for k in range(steps):
            r = found[s, k + 1]
            assert r.time == DAY(at + 1 + k) and np.allclose(r.mean, mean[k]) and np.allclose(r["cov"], cov[k].ravel())


@pytest.mark.parametrize("output", C.OUTPUTS)
def test_scenario_from_the_end(rows, ahead, output):
    check(C.forecasts(rows, build, "s", "day", ["y"], regressors=["x"], scenario=ahead, output=output), N - 1, AHEAD, output)


def test_start_and_end(rows, ahead):
    check(C.forecasts(rows, build, "s", "day", ["y"], regressors=["x"], scenario=ahead, start=DAY(6), end=DAY(13)), 6, 7, "smoothed")
    check(C.forecasts(rows, build, "s", "day", ["y"], regressors=["x"], start=DAY(6), periods=3, output="filtered"), 6, 3, "filtered")
    check(C.forecasts(rows, build, "s", "day", ["y"], regressors=["x"], scenario=ahead, periods=2), N - 1, 2, "smoothed")


def test_one_scenario_for_all_series(spark, rows):
    common = spark.createDataFrame([(DAY(N + k), float(k)) for k in range(3)] + [(DAY(2), 99.0)], "day date, x double")
    got = C.forecasts(rows, build, "s", "day", ["y"], regressors=["x"], scenario=common).collect()
    assert sorted((r.s, r.step) for r in got) == [(s, k) for s in "ab" for k in (1, 2, 3)]


def test_draws_of_parameters(spark, rows, ahead):
    draws = spark.createDataFrame([(i, 0.2 + 0.3 * i) for i in range(3)], "draw long, h double")
    got = C.forecasts(rows, build, "s", "day", ["y"], regressors=["x"], scenario=ahead, draws=draws).collect()
    assert len(got) == 2 * 3 * AHEAD
    for r in got:
        mean, cov = wanted(r.s, N - 1, AHEAD, "smoothed", 0.2 + 0.3 * r.draw)
        assert np.allclose(r.mean, mean[r.step - 1]) and np.allclose(r["cov"], cov[r.step - 1].ravel())


def test_paths_have_the_forecasts_moments(spark, rows, ahead):
    draws = spark.range(3000).select(F.col("id").alias("draw"))
    got = C.forecasts(rows, build, "s", "day", ["y"], regressors=["x"], scenario=ahead, draws=draws, paths=True, seed=1)
    found = {(r.s, r.step): r for r in got.groupBy("s", "step").agg(F.avg(F.get("observed", F.lit(0))).alias("m"), F.var_samp(F.get("observed", F.lit(0))).alias("v")).collect()}
    for s in XS:
        mean, cov = wanted(s, N - 1, AHEAD, "smoothed")
        for k in range(AHEAD):
            assert abs(found[s, k + 1].m - mean[k, 0]) < 5 * np.sqrt(cov[k, 0, 0] / 3000) and abs(found[s, k + 1].v / cov[k, 0, 0] - 1) < 0.15


@pytest.mark.parametrize(
    "more,said",
    [
        ({"output": "nope"}, "output"),
        ({"periods": 2, "end": DAY(13)}, "not both"),
        ({"scenario": None}, "periods, end or a scenario"),
        ({"scenario": None, "periods": 3}, "a scenario of"),
        ({"regressors": ["x", "z"]}, "not in the rows"),
        ({"paths": True}, "paths need draws"),
        ({"start": DAY(100)}, "has no row at"),
        ({"periods": 9}, "regressors for 4 of 9 steps"),
    ],
)
def test_what_is_refused(rows, ahead, more, said):
    with pytest.raises(Exception, match=said):
        C.forecasts(rows, build, "s", "day", ["y"], **{"regressors": ["x"], "scenario": ahead} | more).collect()


def test_starting_states_of_many_series():
    """Side by side as each by itself, from any row."""
    rng = np.random.default_rng(4)
    ys = [rng.normal(size=(n, 1)) for n in (3, 9, 6)]
    models = [S.StateSpace(T=np.eye(2), Z=rng.normal(size=(n + 2, 1, 2)), R=[[1.0], [0.0]], H=[[2.0]], Q=[[1.0]], x0=[1.0, 0.0], P0=np.diag([4.0, 3.0])) for n in (3, 9, 6)]
    for output in C.OUTPUTS:
        for at in ([2, 8, 5], [1, 4, 5]):
            for (a, P), model, y, t in zip(C.starting_states(models, ys, at, output), models, ys, at, strict=True):
                b, Q = C.starting_state(model, y, t, output)
                assert np.allclose(a, b) and np.allclose(P, Q)
