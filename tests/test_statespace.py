"""Filters against one another and against the series' joint normal density; builders against closed forms."""

import numpy as np
import pytest

from sparkbayes.operators import statespace as S
from sparkbayes.plans import statespace_models as M

RNG = np.random.default_rng(3)


def random_model(m=3, p=2, r=2, seed=0):
    rng = np.random.default_rng(seed)
    T = rng.normal(size=(m, m))
    T *= 0.8 / np.abs(np.linalg.eigvals(T)).max()
    a, b = rng.normal(size=(m, m)), rng.normal(size=(p, p))
    return S.StateSpace(T=T, Z=rng.normal(size=(p, m)), R=rng.normal(size=(m, r)), H=b @ b.T + np.eye(p), Q=np.eye(r), x0=rng.normal(size=m), P0=a @ a.T + np.eye(m), c=rng.normal(size=m) * 0.1, d=rng.normal(size=p))


@pytest.mark.parametrize("kind", ["standard", "cholesky"])
@pytest.mark.parametrize("missing", [False, True])
def test_filters_give_the_joint_density(kind, missing):
    model = random_model()
    y = S.simulate(model, 12, RNG)[1]
    if missing:
        y[3] = np.nan
        y[6, 0] = np.nan
    assert np.isclose(S.kalman(model, y, kind).loglike.sum(), S.direct_logp(model, y), atol=1e-8)


def test_univariate_filter_with_diagonal_noise():
    model = random_model()
    model = S.replace(model, H=np.diag([0.5, 2.0]))
    y = S.simulate(model, 12, RNG)[1]
    y[2, 1] = np.nan
    a, b = S.kalman(model, y), S.kalman(model, y, "univariate")
    assert np.isclose(a.loglike.sum(), b.loglike.sum())
    assert np.allclose(a.filtered, b.filtered) and np.allclose(a.predicted_cov, b.predicted_cov)


def test_convergent_filter_equals_the_standard_one():
    model = random_model()
    y = S.simulate(model, 200, RNG)[1]
    a, b = S.kalman(model, y), S.kalman(model, y, "convergent", tol=1e-13)
    assert np.allclose(a.loglike, b.loglike, atol=1e-8) and np.allclose(a.filtered, b.filtered, atol=1e-8)
    with pytest.raises(ValueError):
        S.kalman(model, np.full((3, 2), np.nan), "convergent")
    with pytest.raises(ValueError):
        S.kalman(model, y, "other")


def test_smoother_is_the_conditional_mean():
    model = random_model(2, 1, 1, seed=5)
    y = S.simulate(model, 5, RNG)[1]
    mean = S.smooth(model, S.kalman(model, y))[0]
    # joint normal of states and observations by brute force
    n, m = 5, 2
    mu, cov, x, P = [], np.zeros((n * m, n * m)), model.x0, model.P0
    for t in range(n):
        mu.append(x)
        step = np.eye(m)
        for s in range(t, n):
            cov[s * m : (s + 1) * m, t * m : (t + 1) * m] = step @ P
            cov[t * m : (t + 1) * m, s * m : (s + 1) * m] = (step @ P).T
            step = model.T @ step
        x, P = model.c + model.T @ x, model.T @ P @ model.T.T + model.R @ model.Q @ model.R.T
    Z = np.kron(np.eye(n), model.Z)
    V = Z @ cov @ Z.T + np.kron(np.eye(n), model.H)
    want = np.concatenate(mu) + cov @ Z.T @ np.linalg.solve(V, (y - model.d).ravel() - Z @ np.concatenate(mu))
    assert np.allclose(mean.ravel(), want)


def test_simulation_smoother_has_the_smoothed_mean():
    model = random_model(2, 1, 1, seed=6)
    y = S.simulate(model, 8, RNG)[1]
    draws = np.mean([S.simulation_smoother(model, y, RNG) for _ in range(1500)], axis=0)
    assert np.allclose(draws, S.smooth(model, S.kalman(model, y))[0], atol=0.15)


def test_forecast_continues_the_prediction():
    model = random_model()
    y = S.simulate(model, 20, RNG)[1]
    f, g = S.kalman(model, y[:15]), S.kalman(model, np.vstack([y[:15], np.full((5, 2), np.nan)]))
    mean, cov = S.forecast(model, f.filtered[-1], f.filtered_cov[-1], 5, start=14)
    assert np.allclose(mean, g.observed[15:]) and np.allclose(cov, g.observed_cov[15:])


def test_impulse_response():
    model = S.StateSpace(T=[[0.5]], Z=[[1.0]], R=[[1.0]], H=[[0.0]], Q=[[1.0]], x0=[0.0], P0=[[1.0]])
    assert np.allclose(S.impulse_response(model, 4, shock_size=[2.0])[:, 0], [2, 1, 0.5, 0.25])
    with pytest.raises(ValueError):
        S.impulse_response(model, 4, shock_size=[1.0], shock_cov=[[1.0]])


def arma_autocov(phi, theta, sigma, n):
    psi = np.zeros(400)
    psi[0] = 1
    for i in range(1, 400):
        psi[i] = (theta[i - 1] if i <= len(theta) else 0) + sum(phi[j] * psi[i - 1 - j] for j in range(min(i, len(phi))))
    return np.array([sigma**2 * (psi[: 400 - h] * psi[h:]).sum() for h in range(n)])


def test_sarimax_has_the_arma_density():
    model = M.sarimax((2, 0, 1), ar=[0.5, -0.2], ma=[0.4], sigma=1.3)
    y = RNG.normal(size=12)
    g = arma_autocov([0.5, -0.2], [0.4], 1.3, 12)
    V = g[np.abs(np.subtract.outer(np.arange(12), np.arange(12)))]
    want = -0.5 * (12 * S.LN_2PI + np.linalg.slogdet(V)[1] + y @ np.linalg.solve(V, y))
    assert np.isclose(S.kalman(model, y).loglike.sum(), want, atol=1e-6)


def test_differences_follow_the_arma():
    model = M.sarimax((1, 1, 0), ar=[0.6], seasonal_order=(0, 1, 0, 4), sigma=1.0)
    x, y = S.simulate(model, 40, np.random.default_rng(2), P0=np.zeros((model.m, model.m)))
    w = np.diff(y[:, 0])
    assert np.allclose(w[4:] - w[:-4], x[5:, -1])
    with pytest.raises(ValueError):
        M.sarimax((1, 0, 0), ar=[])


def test_ets_is_exponential_smoothing():
    model = M.ets(("A", "N", "N"), alpha=0.3, sigma=1.0, level0=2.0, P0=np.zeros((2, 2)) + np.diag([1e-12, 0]))
    y, level = np.array([2.0, 3.0, 1.0, 4.0]), 2.0
    f = S.kalman(model, y)
    for t, v in enumerate(y[:-1]):
        level += 0.3 * (v - level)
        if t:
            assert np.isclose(f.observed[t + 1, 0], level, atol=0.5)


def test_components_add_up():
    trend, season, noise = M.level_trend(2, [0.1, 0.05]), M.time_seasonality(4, 0.2), M.measurement_error(0.5)
    model = (trend + season + noise).build()
    assert model.T.shape == (5, 5) and np.allclose(model.H, 0.25) and model.states[:2] == ("level", "trend")
    x = np.arange(10.0).reshape(2, 5)
    parts = np.array([v[:, 0] for v in M.extract(model, x).values()])
    assert np.allclose(parts.sum(axis=0), [(model.Z @ v)[0] for v in x])
    with pytest.raises(ValueError):
        trend + M.level_trend(1)


def test_seasons_repeat():
    for part in (M.time_seasonality(4), M.time_seasonality(4, remove_first=False), M.frequency_seasonality(4.0)):
        model = part.build(x0=np.array([1.0, -2.0, 0.5, 3.0][: part.m]), P0=np.zeros((part.m, part.m)))
        y = S.simulate(model, 12, RNG)[1][:, 0]
        assert np.allclose(y[:4], y[4:8], atol=1e-9)


def test_regression_recovers_coefficients():
    X = RNG.normal(size=(60, 2))
    y = X @ [2.0, -1.0] + RNG.normal(size=60) * 0.1
    f = S.kalman((M.regression(X) + M.measurement_error(0.1)).build(), y)
    assert np.allclose(f.filtered[-1], [2, -1], atol=0.1)


def test_varmax_and_factor_models_filter():
    v = M.varmax([np.array([[0.5, 0.1], [0.0, 0.3]])], [np.array([[0.2, 0.0], [0.1, 0.1]])], cov=np.array([[1.0, 0.2], [0.2, 0.5]]))
    y = S.simulate(v, 10, RNG)[1]
    assert np.isclose(S.kalman(v, y).loglike.sum(), S.direct_logp(v, y), atol=1e-6)
    f = M.dynamic_factor(np.array([[1.0], [0.5], [-0.3]]), [np.array([[0.7]])], error_ar=[np.eye(3) * 0.2])
    y = S.simulate(f, 8, RNG)[1]
    assert np.isclose(S.kalman(f, y, "standard", jitter=0).loglike.sum(), S.direct_logp(f, y), atol=1e-6)


def test_posterior_outputs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(s, t, float(t + s)) for s in (1, 2) for t in range(6)], "s int, t int, y double")
    draws = spark.range(300).select(F.col("id").alias("draw"), F.lit(1.0).alias("h"))

    def build(p):
        return S.StateSpace(T=[[1.0]], Z=[[1.0]], R=[[1.0]], H=[[p["h"]]], Q=[[1.0]], x0=[0.0], P0=[[10.0]])

    got = S.posterior_outputs(df, draws, build, "s", ["t"], ["y"], steps=2).withColumn("x", F.get("state", F.lit(0)))
    mean = {(r[0], r[1], r[2]): r[3] for r in got.groupBy("s", "output", "t").agg(F.avg("x")).collect()}
    f = S.kalman(build({"h": 1.0}), np.arange(6.0) + 1)
    assert abs(mean[1, "filtered", 3] - f.filtered[3, 0]) < 0.2 and abs(mean[1, "forecast", 7] - f.filtered[-1, 0]) < 0.35
    assert abs(mean[1, "smoothed", 3] - S.smooth(build({"h": 1.0}), f)[0][3, 0]) < 0.2 and got.count() == 2 * 300 * (3 * 6 + 2)


def test_tables_of_matrices_outputs_and_models(spark):
    from pyspark.sql import functions as F

    build = lambda p: S.StateSpace(T=[[p["phi"]]], Z=[[1.0]], R=[[1.0]], H=[[p["h"]]], Q=[[1.0]], x0=[0.0], P0=[[2.0]])
    draws = spark.createDataFrame([(0, 0.5, 1.0), (1, 0.9, 2.0)], "draw long, phi double, h double")
    got = {(r["draw"], r["matrix"]): (r["shape"], r["entries"]) for r in S.sample_matrices(draws, build, ("T", "H")).collect()}
    assert got == {(0, "T"): ([1, 1], [0.5]), (0, "H"): ([1, 1], [1.0]), (1, "T"): ([1, 1], [0.9]), (1, "H"): ([1, 1], [2.0])}
    with pytest.raises(ValueError):
        S.sample_matrices(draws, build, ("nothing",))
    y = [1.0, None, -0.5, 2.0]
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate(y)], "s string, t int, y double")
    out = S.sample_filter_outputs(df, draws, build, "s", ["t"], ["y"])
    ys = np.array([np.nan if v is None else v for v in y])
    for draw, phi, h in ((0, 0.5, 1.0), (1, 0.9, 2.0)):
        model = build({"phi": phi, "h": h})
        f = S.kalman(model, ys)
        rows = out.where((F.col("draw") == draw) & (F.col("output") == "smoothed")).orderBy("t").collect()
        assert np.allclose([r["mean"][0] for r in rows], S.smooth(model, f)[0][:, 0])
        # One-step predictions of the observations, each a normal of its own, give the filter's likelihood.
        assert np.allclose(S.sequence_mvn_logp(f.observed, f.observed_cov, ys), f.loglike)
    assert S.sequence_mvn_draws(np.zeros((5, 2)), np.zeros((5, 2, 2)), np.random.default_rng(0)).tolist() == [[0.0, 0.0]] * 5
    tables = S.model_tables(spark, build({"phi": 0.5, "h": 1.0}))
    assert tables["matrices"].count() == 9 and {r["label"] for r in tables["coords"].collect()} == {"state_0", "y_0", "shock_0"} and tables["info"].where("what = 'states'").head()["value"] == "1"


def test_one_number_filters_equal_the_matrix_ones():
    rng = np.random.default_rng(3)
    y = np.where(rng.random(40) < 0.2, np.nan, rng.normal(size=40))
    small = S.StateSpace(T=[[0.7]], Z=[[1.5]], R=[[1.0]], H=[[0.4]], Q=[[0.6]], x0=[0.3], P0=[[2.0]], c=[0.1], d=[0.2])
    wide = S.StateSpace(T=[[0.7, 0.0], [0.0, 0.5]], Z=[[1.5, 0.0]], R=[[1.0], [0.0]], H=[[0.4]], Q=[[0.6]], x0=[0.3, 0.0], P0=np.diag([2.0, 1.0]), c=[0.1, 0.0], d=[0.2])
    a, b = S.kalman(small, y), S.kalman(wide, y)
    assert np.allclose(a.loglike, b.loglike) and np.allclose(a.filtered[:, 0], b.filtered[:, 0]) and np.allclose(a.filtered_cov[:, 0, 0], b.filtered_cov[:, 0, 0])
    (m, v), (m2, v2) = S.smooth(small, a), S.smooth(wide, b)
    assert np.allclose(m[:, 0], m2[:, 0]) and np.allclose(v[:, 0, 0], v2[:, 0, 0])
