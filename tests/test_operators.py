"""Histograms, chains, hidden chains, marginals, inference and helpers on small tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkbayes.functions import expr as E
from sparkbayes.functions.special import normal_logp
from sparkbayes.operators import histogram, inference, marginal, markov, numeric


def test_histograms_keep_counts(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(x), float(abs(y)) if i >= 100 else 0.0) for i, (x, y) in enumerate(rng.normal(size=(2000, 2)))], "a double, b double")
    got = histogram.quantile_histogram(df, ["a", "b"], 50).groupBy("column").agg(F.sum("count")).collect()
    assert {r[0]: r[1] for r in got} == {"a": 2000, "b": 2000}
    zero = {r["bin"]: r for r in histogram.quantile_histogram(df, "b", 50, zero_inflation=True).collect()}
    assert zero[0]["count"] == 100 and sum(r["count"] for r in zero.values()) == 2000
    assert histogram.quantile_histogram(df.limit(0), "a", 5).count() == 0


def test_rare_values_fold_down(spark):
    df = spark.createDataFrame([(x,) for x in [1, 2, 2, 2, 3, 4, 4, 4, 5]], "v int")
    assert {r[0]: r[1] for r in histogram.discrete_histogram(df, "v", 3).collect()} == {2: 4, 4: 4}


def test_chain_logp_by_hand(spark):
    P = np.array([[0.9, 0.1], [0.3, 0.7]])
    df = spark.createDataFrame([("a", t, s) for t, s in enumerate([0, 0, 1, 1])] + [("b", 0, 2)], "q string, t int, s int")
    got = {r[0]: r[1] for r in markov.chain_logp(df, "q", ["t"], "s", p=P, init=[0.6, 0.4]).collect()}
    assert math.isclose(got["a"], math.log(0.6 * 0.9 * 0.1 * 0.7)) and got["b"] == float("-inf")
    with pytest.raises(ValueError):
        markov.chain_logp(df, "q", ["t"], "s", p=P, logit_p=P)
    with pytest.raises(ValueError):
        markov.check_table(np.ones((2, 2)), 1)


def test_simulated_chains_have_the_frequencies(spark):
    P = [[0.6, 0.2, 0.2], [0.5, 0.1, 0.4], [0.1, 0.1, 0.8]]
    got = markov.transition_counts(markov.simulate(spark, 400, 60, P, [0.2, 0.3, 0.5], seed=1), "sequence", ["t"], "state").collect()
    assert all(abs(r["p"] - P[r["s_1"]][r["state"]]) < 0.03 for r in got)
    two = np.zeros((2, 2, 2))
    two[..., 0], two[..., 1] = 0.25, 0.75
    got = markov.simulate(spark, 200, 30, two, n_lags=2, seed=2).where("t >= 2").agg(F.avg("state")).head()[0]
    assert abs(got - 0.75) < 0.03
    assert markov.greedy(P, [0, 0, 1], 2) == [2, 2, 2]


def test_gibbs_keeps_the_stationary_shares(spark):
    P = np.array([[0.8, 0.2], [0.4, 0.6]])
    df = markov.simulate(spark, 300, 40, P, [2 / 3, 1 / 3], seed=3)
    for proposal in ("uniform", "proportional"):
        new = markov.gibbs_step(df, "sequence", "t", "state", P, [2 / 3, 1 / 3], proposal=proposal, seed=4)
        assert abs(new.agg(F.avg("state")).head()[0] - 1 / 3) < 0.03 and new.count() == df.count()


def test_hidden_chain_golden_value(spark):
    """Emissions 0, 0, 1 have probability 0.1344."""
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0), (1, 2, 1.0)], "q int, t int, y double")
    p = [0.2, 0.6]
    got = markov.hmm_logp(df, "q", ["t"], "y", lambda v, j: F.when(v == 1, math.log(p[j])).otherwise(math.log(1 - p[j])), [[0.5, 0.5], [0.3, 0.7]], [0.375, 0.625]).head()[1]
    assert math.isclose(got, math.log(0.1344))


def test_hidden_chain_against_all_paths():
    rng = np.random.default_rng(2)
    for lags in (1, 2):
        k, n = 2, 5
        p = rng.dirichlet(np.ones(k), size=(k,) * lags)
        init, logs = rng.dirichlet(np.ones(k**lags)), rng.normal(size=(n, k))
        alpha, beta, total = markov.hmm_kernel(logs, p.reshape(-1, k), init, lags)
        weights = {}
        for path in itertools.product(range(k), repeat=n):
            w = init[int("".join(map(str, path[:lags])), k)]
            for t in range(lags, n):
                w *= p[path[t - lags : t + 1]]
            weights[path] = w * math.exp(sum(logs[t, s] for t, s in enumerate(path)))
        assert math.isclose(total, math.log(sum(weights.values())))
        for t in range(n - lags + 1):
            want = sum(w for path, w in weights.items() if path[t] == 1) / sum(weights.values())
            assert math.isclose(np.exp(alpha[t] + beta[t] - total).reshape(k, -1).sum(axis=1)[1], want)


def test_hidden_paths_are_drawn_by_their_probabilities(spark):
    rng = np.random.default_rng(3)
    p, init, logs = rng.dirichlet(np.ones(2), size=2), np.array([0.3, 0.7]), rng.normal(size=(4, 2))
    first, steps = markov.conditional_chain(logs, p, init)
    total = markov.enumerate_hmm(logs, p, init)
    for path in itertools.product(range(2), repeat=4):
        joint = math.log(init[path[0]]) + sum(math.log(p[a, b]) for a, b in itertools.pairwise(path)) + sum(logs[t, s] for t, s in enumerate(path))
        given = math.log(first[path[0]]) + sum(math.log(steps[t][a, b]) for t, (a, b) in enumerate(itertools.pairwise(path)))
        assert math.isclose(joint - total, given)
    df = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate([0.1, 1.2, 0.9])], "q int, t int, y double")
    emission = lambda y: -0.5 * (y[:, None] - np.array([0.0, 1.0])) ** 2
    drawn = {r[0]: r[1] for r in markov.hmm_draws(df, "q", ["t"], "y", emission, [[0.7, 0.3], [0.2, 0.8]], [0.5, 0.5], 4000).groupBy("t").agg(F.avg("state")).collect()}
    exact = {r["t"]: r["prob"] for r in markov.hmm_smoothed(df, "q", ["t"], "y", emission, [[0.7, 0.3], [0.2, 0.8]], [0.5, 0.5]).where("state = 1").collect()}
    assert all(abs(drawn[t] - exact[t]) < 0.03 for t in exact)


def test_smoothed_states_sum_to_one(spark):
    df = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate([0.1, 1.2, 0.9, -0.2])], "q int, t int, y double")
    logs = lambda y: -0.5 * (y[:, None] - np.array([0.0, 1.0])) ** 2
    P2 = np.full((2, 2, 2), 0.5)
    for p, init, lags in (([[0.7, 0.3], [0.2, 0.8]], [0.5, 0.5], 1), (P2, np.full(4, 0.25), 2)):
        got = markov.hmm_smoothed(df, "q", ["t"], "y", logs, p, init, n_lags=lags).groupBy("t").agg(F.sum("prob")).collect()
        assert len(got) == 4 and all(math.isclose(r[1], 1) for r in got)


def test_mixtures_and_normal_marginals(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 1.1), (2, -0.5)], "g int, y double")
    terms = lambda v: normal_logp(F.col("y"), float(v), 1.0)
    logp, p = df.select(marginal.mixture_logp([0.2, 0.8], terms), marginal.mixture_posterior([0.2, 0.8], terms)).head()
    f = lambda y, m: math.exp(-0.5 * (y - m) ** 2) / math.sqrt(2 * math.pi)
    assert math.isclose(math.exp(logp), 0.2 * f(0.3, 0) + 0.8 * f(0.3, 1)) and math.isclose(sum(p), 1)
    got = {r["g"]: r["logp"] for r in marginal.grouped_mixture_logp(df, ["g"], [0.2, 0.8], terms).collect()}
    assert math.isclose(math.exp(got[1]), 0.2 * f(0.3, 0) * f(1.1, 0) + 0.8 * f(0.3, 1) * f(1.1, 1))
    x = np.linspace(-30, 30, 60001)
    want = np.trapezoid(np.exp(-0.5 * (x / 2) ** 2) / 2 / math.sqrt(2 * math.pi) * np.exp(-0.5 * ((0.3 - 1 - 3 * x) / 1.5) ** 2) / 1.5 / math.sqrt(2 * math.pi), x)
    assert math.isclose(df.select(marginal.normal_normal_logp(F.col("y"), 0.0, 2.0, 1.5, 3.0, 1.0)).head()[0], math.log(want), rel_tol=1e-6)


def test_laplace_marginal_is_exact_for_gaussians():
    y = np.array([0.5, 1.5, 0.2])
    value = lambda x: (float(-0.5 * ((y - x[0]) ** 2).sum() - 1.5 * math.log(2 * math.pi)), np.array([(y - x[0]).sum()]), np.array([[-3.0]]))
    got, mode, tau = marginal.laplace_marginal(value, np.array([0.0]), np.array([[0.25]]))
    V = np.eye(3) + 4 * np.ones((3, 3))
    assert math.isclose(got, -0.5 * (3 * math.log(2 * math.pi) + np.linalg.slogdet(V)[1] + y @ np.linalg.solve(V, y))) and math.isclose(tau[0, 0], 3.25) and math.isclose(mode[0], y.sum() / 3.25)


MEAN, SD = np.array([1.0, -2.0]), np.array([0.5, 2.0])


def look(x):
    z = (np.asarray(x) - MEAN) / SD
    return float(-0.5 * z @ z - np.log(SD).sum() - math.log(2 * math.pi)), -z / SD


def gaussian():
    return inference.function_target(["a", "b"], lambda x: look(x)[0], lambda x: look(x)[1], lambda x: -np.diag(1 / SD**2))


@pytest.mark.parametrize("method", ["newton", "bfgs", "lbfgs"])
def test_modes(method):
    x, _, _ = inference.find_map(gaussian(), np.zeros(2), method=method)
    assert np.allclose(x, MEAN, atol=1e-5)


def test_gaussian_approximations():
    for fit in (inference.fit_laplace(gaussian(), np.zeros(2)), inference.fit_dadvi(gaussian(), np.zeros(2), n_fixed=60), inference.fit_advi(gaussian(), "full", steps=1500)):
        assert np.allclose(fit.mean, MEAN, atol=0.2) and np.allclose(np.sqrt(np.diag(fit.covariance)), SD, rtol=0.25)
    for kind in ("diagonal", "low_rank"):
        guide = inference.fit_advi(gaussian(), kind, steps=50).info["guide"]
        root = np.linalg.slogdet(guide.covariance())[1]
        assert np.isclose(guide.logq(guide.mean)[0], -0.5 * root - math.log(2 * math.pi))
    with pytest.raises(ValueError):
        inference.fit("other")


def test_table_target(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "y double")
    target = inference.table_target(df, E.normal(E.data("y"), E.param("m"), E.exp(E.param("s"))), E.normal(E.param("m"), 0.0, 10.0), ["m", "s"])
    value, g, h = target(np.array([2.0, 0.5]))
    up = target(np.array([2.0, 0.5 + 1e-5]))
    assert math.isclose((up[0] - value) / 1e-5, g[1], rel_tol=1e-3) and math.isclose((up[1][0] - g[0]) / 1e-5, h[0, 1], rel_tol=1e-3)


def test_pathfinder_and_resampling(spark):
    def here(x):  # sent by value: executors don't import tests
        z = (np.asarray(x) - np.array([1.0, -2.0])) / np.array([0.5, 2.0])
        return float(-0.5 * z @ z), -z / np.array([0.5, 2.0])

    got = inference.fit_pathfinder(spark, here, np.zeros(2), paths=3, draws_per_path=300, draws=200, seed=1)
    x = np.array([r["x"] for r in got.collect()])
    assert len(x) == 200 and np.allclose(x.mean(axis=0), MEAN, atol=0.5)
    path = inference.pathfinder_path(look, np.zeros(2), np.random.default_rng(0), draws=50)
    assert path.status == "CONVERGED" and inference.path_report([path]) == {"CONVERGED": 1}
    s = spark.createDataFrame([(i, 0.0 if i % 2 else float("nan"), 0.0) for i in range(50)], "i int, logp double, logq double")
    assert all(r["i"] % 2 for r in inference.importance_sampling(s, 30, method="psir").collect())
    assert inference.importance_sampling(s, 3, method=None).count() == 50
    with pytest.raises(ValueError):
        inference.importance_sampling(s.where("i % 2 = 0"), 3)
    with pytest.raises(ValueError):
        inference.importance_sampling(s, 3, method="other")


def test_resampling_goes_by_rows_and_seed_alone(spark):
    rng = np.random.default_rng(3)
    rows = [(i // 2, float(x), 0.0) for i, x in enumerate(np.repeat(rng.normal(size=150), 2))]  # every row twice
    s = spark.createDataFrame(rows, "i int, logp double, logq double")
    for method in ("psis", "psir", "identity"):
        got = [sorted((r.i, r.logp) for r in inference.importance_sampling(s.repartition(k), 120, method=method, seed=9).collect()) for k in (1, 7)]
        assert got[0] == got[1] and len(got[0]) == 120
        if method == "psis":
            assert max(got[0].count(x) for x in got[0]) <= 2
    with pytest.raises(ValueError, match="fewer than"):
        inference.importance_sampling(s, 301, method="psis")
    w = np.exp([r[1] for r in rows])
    share = spark.createDataFrame([(i, float(np.log(x)), 0.0) for i, x in enumerate((1.0, 2.0, 0.0, 5.0))], "i int, logp double, logq double")
    n = inference.importance_sampling(share, 20_000, method="identity", seed=2).groupBy("i").count().collect()
    assert {r.i for r in n} == {0, 1, 3} and all(abs(r["count"] / 20_000 - {0: 0.125, 1: 0.25, 3: 0.625}[r.i]) < 0.02 for r in n) and len(w) == 300


def test_pareto_tail():
    rng = np.random.default_rng(0)
    k, sigma = inference.fit_pareto(rng.pareto(2.0, 5000))
    assert abs(k - 0.5) < 0.1 and abs(sigma - 0.5) < 0.1


def test_systematic_copies(spark):
    df = spark.createDataFrame([(i, float(math.log(1 + i))) for i in range(100)], "i int, w double")
    got = {r[0]: r[1] for r in inference.weighted_resample(df, "i", "w", 1000, seed=1).collect()}
    assert sum(got.values()) == 1000 and all(abs(got[i] - 1000 * (1 + i) / 5050) <= 1 for i in range(100))


def test_particles_reach_the_target(spark):
    x, report = inference.fit_smc(spark, lambda r: r.normal(size=1) * 3, lambda v: float(-0.5 * (v / 3) @ (v / 3)), lambda v: float(-0.5 * ((v - 1) / 0.5) @ ((v - 1) / 0.5)), particles=150, moves=3, step=0.3, seed=1)
    assert abs(x.mean() - 9 / 9.25) < 0.2 and report["lambda"].iloc[-1] == 1.0


def test_splines_and_solvers(spark):
    x = np.linspace(0, 1, 21)
    B = numeric.np_bspline_basis(x, 8)
    assert np.allclose(B.sum(axis=1), 1) and (B >= 0).all()
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    got = np.array([list(r)[1:] for r in df.select("i", *numeric.bspline_basis(F.col("x"), 8)).orderBy("i").collect()])
    assert np.allclose(got, B)
    with pytest.raises(ValueError):
        numeric.bspline_interpolation(np.ones(8))
    A = np.array([[4.0, 1.0], [1.0, 3.0]])
    assert np.allclose(numeric.linear_cg(lambda v: A @ v, np.array([1.0, 2.0])), np.linalg.solve(A, [1, 2]))
    entries = spark.createDataFrame([(i, j, A[i, j].item()) for i in range(2) for j in range(2)], "i int, j int, v double")
    assert np.allclose(numeric.table_matvec(entries, 2)(np.array([1.0, 2.0])), A @ [1, 2])
    with pytest.raises(RuntimeError):
        numeric.linear_cg(lambda v: A @ v, np.array([1.0, 2.0]), steps=1, tol=1e-14)


def test_partial_orders(spark):
    order = numeric.PartialOrder([[0, 1, 1, 1], [0, 0, 0, 1], [0, 0, 0, 1], [0, 0, 0, 0]])
    v = np.random.default_rng(1).normal(size=(5, 4))
    x = order.backward(v)
    assert np.allclose(order.forward(x), v) and (x[:, 3] > x[:, 1:3].max(axis=1)).all() and np.allclose(order.log_jac_det(v), v[:, 1:].sum(axis=1))
    with pytest.raises(ValueError):
        numeric.PartialOrder([[0, 1], [1, 0]])
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    assert numeric.transitive_closure(edges).count() == 6


def test_low_rank_processes():
    x = np.linspace(0, 1, 6)[:, None]
    process = numeric.ProjectedProcess(x, lambda a, b: numeric.rbf(a, b, 0.5))
    mean, cov = process.conditional(x, np.sin(x[:, 0]))
    assert np.allclose(mean, np.sin(x[:, 0]), atol=1e-4) and np.abs(cov).max() < 1e-4
    w, v = numeric.karhunen_loeve(numeric.rbf(x, x, 0.5), variance_limit=0.99)
    assert w.sum() / np.trace(numeric.rbf(x, x, 0.5)) >= 0.99 and v.shape[1] == len(w)


def test_explained_variance_prior():
    rng = np.random.default_rng(0)
    made = [numeric.r2d2m2cp(2.0, np.array([1.0, 3.0]), 0.6, importance=np.array([0.5, 0.5]), rng=rng) for _ in range(4000)]
    share = np.mean([(b**2 * [1, 9]).sum() for _, b in made]) / 4
    assert abs(share - 0.6) < 0.05 and math.isclose(made[0][0], 2 * math.sqrt(0.4))
    with pytest.raises(TypeError):
        numeric.r2d2m2cp(1.0, np.ones(2), 0.5, importance=np.ones(2), importance_concentration=np.ones(2))


def test_impossible_values_leave_nothing_defined_behind_them(spark):
    df = spark.createDataFrame([(q, t, v) for q, ys in {"all": [1, 0], "last": [1, 7], "inside": [1, 7, 0]}.items() for t, v in enumerate(ys)], "q string, t int, y int")
    got = {r[0]: r[1] for r in markov.hmm_logp(df, "q", ["t"], "y", lambda v, j: F.when(v < 2, math.log(0.5)).otherwise(F.lit(float("-inf"))), [[0.5, 0.5], [0.3, 0.7]], [0.5, 0.5]).collect()}
    assert math.isclose(got["all"], math.log(0.25)) and got["last"] == float("-inf") and math.isnan(got["inside"])


def test_zero_values_are_no_missing_values(spark, tmp_path):
    """As in the query's SQL, where the logarithm of zero is -inf."""
    from sparkbayes.plans.catalog import QUERIES

    rows = [(i, u, "view", v) for i, (u, v) in enumerate([(1, 20.0), (1, 0.0), (1, 30.0), (2, 20.0), (2, 30.0), (3, 20.0), (3, 0.0)])]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r[0]: r[1] for r in QUERIES["hmm_forward_logp"](spark, str(tmp_path)).collect()}
    assert math.isnan(got[1]) and math.isfinite(got[2]) and got[3] == float("-inf")
