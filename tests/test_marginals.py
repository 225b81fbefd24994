"""Marginals of latents that span rows, chains and nested ones among them, against enumeration."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkbayes.operators import chains, markov
from sparkbayes.plans import dims as D
from sparkbayes.plans import marginal_tables as T
from sparkbayes.plans import model as M


def normal(y, mu, sigma):
    return math.exp(-0.5 * ((y - mu) / sigma) ** 2) / sigma / math.sqrt(2 * math.pi)


def paths(p, init, lags, length, varying):
    """Every path with its prior probability."""
    k = np.shape(p)[-1]
    init = np.broadcast_to(init, (lags, k))
    for path in itertools.product(range(k), repeat=length):
        w = math.prod(init[i][path[i]] for i in range(min(lags, length)))
        for t in range(lags, length):
            table = p[min(t - lags, len(p) - 1)] if varying else p
            w *= table[tuple(path[t - lags : t + 1])]
        yield path, w


def stochastic(rng, *shape):
    x = rng.uniform(0.1, 1, shape)
    return x / x.sum(-1, keepdims=True)


def nested(x):
    return tuple(nested(y) for y in x) if np.ndim(x) else float(x)


def chain_model(p, init, lags=1, mu=(-1.0, 0.5, 2.0)):
    k = np.shape(p)[-1]
    return M.Model((M.rv("s", "MarkovChain", p=nested(p), init=nested(init), n_lags=lags, dims=("g",), order=("at",)), M.rv("y", "Normal", mu=M.Pick("s", mu[:k]), sigma=0.7, observed="y", dims=("g", "at"))))


def test_a_known_value(spark):
    """Three emissions 0, 0, 1 of a chain of two states: 0.1344."""
    model = M.Model((M.rv("s", "MarkovChain", p=((0.5, 0.5), (0.3, 0.7)), init=(0.375, 0.625), dims=("g",), order=("at",)), M.rv("y", "Bernoulli", p=M.Pick("s", (0.2, 0.6)), observed="y", dims=("g", "at"))))
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 1)], "g int, at int, y int")
    assert math.isclose(math.exp(M.model_logp(M.marginalize(model, ["s"]), df)), 0.1344, abs_tol=5e-5)


@pytest.mark.parametrize("k,lags,varying", [(2, 1, False), (3, 1, True), (2, 2, False), (2, 3, True), (3, 2, True)])
def test_chains_of_any_order(spark, k, lags, varying):
    rng = np.random.default_rng(k * 10 + lags)
    p = stochastic(rng, *([2] if varying else []), *[k] * (lags + 1))
    init = stochastic(rng, lags, k)
    model = M.marginalize(chain_model(p, init, lags), ["s"])
    assert model.nodes[0].rule == "chain"
    series = {g: [None if rng.uniform() < 0.2 else float(rng.normal()) for _ in range(n)] for g, n in (("a", 5), ("b", 1), ("c", 6), (None, 2))}
    df = spark.createDataFrame([(g, i, y) for g, ys in series.items() for i, y in enumerate(ys)], "g string, at int, y double")
    want, probs = {}, {}
    for g, ys in series.items():
        total, each = 0.0, np.zeros((len(ys), k))
        for path, w in paths(p, init, lags, len(ys), varying):
            for t, y in enumerate(ys):
                w *= 1 if y is None else normal(y, (-1.0, 0.5, 2.0)[path[t]], 0.7)
            total += w
            for t, s in enumerate(path):
                each[t, s] += w
        want[g], probs[g] = math.log(total), each / total
    got = {r.g: r.logp for r in T.tree_logp(model.nodes[0], df).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[g], want[g], abs_tol=1e-9) for g in want)
    rows = T.conditional_table(model, df.where("g is not null"), "s").collect()
    assert len(rows) == 12 and all(np.allclose(r.prob, probs[r.g][r.t]) and r.t == r["at"] for r in rows)


def test_segments_change_nothing(spark):
    rng = np.random.default_rng(3)
    p, init, n = stochastic(rng, 2, 2, 2), stochastic(rng, 2), 1300
    ys = rng.normal(size=n)
    model = M.marginalize(chain_model(p, init, 2), ["s"])
    df = spark.createDataFrame([("a", i, float(y)) for i, y in enumerate(ys)] + [("b", i, float(y)) for i, y in enumerate(ys[:700])], "g string, at int, y double")
    logs = np.log([[normal(y, m, 0.7) for m in (-1.0, 0.5)] for y in ys])
    rows, keys = T.chain_rows(model.nodes[0], df, {}, [])
    for length in (1, 7, 512):
        got = {r.g: r.logp for r in chains.series_logp(rows, keys, "_t", "_w", 4, 2, length=length).collect()}
        for g, m in (("a", n), ("b", 700)):
            assert math.isclose(got[g], markov.hmm_kernel(logs[:m], p.reshape(4, 2), np.outer(init, init).ravel(), 2)[2], rel_tol=1e-9)
    alpha, beta, total = markov.hmm_kernel(logs, p.reshape(4, 2), np.outer(init, init).ravel(), 2)
    want = np.exp(alpha + beta - total).reshape(-1, 2, 2)
    got = np.array([r.prob for r in chains.smoothed(rows, keys, "_t", "_w", 4, 2).where("g = 'a'").orderBy("t").collect()])
    assert np.allclose(got[:-1], want.sum(2)) and np.allclose(got[-1], want[-1].sum(0))


def test_draws_of_paths(spark):
    rng = np.random.default_rng(8)
    p, init = stochastic(rng, 2, 2, 2), stochastic(rng, 2)
    model = M.marginalize(chain_model(p, init, 2), ["s"])
    ys = [0.1, -0.4, 0.8, 0.2, 0.3, -0.2]
    df = spark.createDataFrame([("a", i, y) for i, y in enumerate(ys)], "g string, at int, y double")
    weights = {path: w * math.prod(normal(y, (-1.0, 0.5)[s], 0.7) for y, s in zip(ys, path, strict=True)) for path, w in paths(p, init, 2, 6, False)}
    total = sum(weights.values())
    rows, keys = T.chain_rows(model.nodes[0], df, {}, [])
    for length in (2, 512):  # whole paths, across segments' ends too
        drawn = chains.draws(rows, keys, "_t", "_w", 4, 2, 20_000, seed=1, length=length).groupBy("draw").agg(F.array_sort(F.collect_list(F.struct("t", "state"))).alias("p"))
        share = {tuple(x.state for x in r.p): r["count"] / 20_000 for r in drawn.groupBy("p").count().collect()}
        assert all(abs(share.get(path, 0) - w / total) < 0.015 for path, w in weights.items())
    again = T.recover_table(model, df, "s", 50, seed=4)
    assert again.exceptAll(T.recover_table(model, df.repartition(5), "s", 50, seed=4)).isEmpty()


def group_model():
    return M.Model(
        (
            M.rv("z", "Bernoulli", p=0.4, dims=("g",)),
            M.rv("o", "Categorical", p=(M.Pick("z", (0.9, 0.5)), M.Pick("z", (0.1, 0.5))), dims=("g", "i")),
            M.rv("y", "Normal", mu=M.Pick("z", (0.0, 1.5)), sigma=M.Pick("o", (1.0, 4.0)), observed="y", dims=("g", "i")),
        )
    )


GROUPS = {1: [0.2, 1.9, -3.0], 2: [1.4], 3: [9.0, 2.0]}


def group_terms(ys):
    return [w * math.prod(sum(q * normal(y, m, s) for q, s in zip(qs, (1.0, 4.0), strict=True)) for y in ys) for w, m, qs in ((0.6, 0.0, (0.9, 0.1)), (0.4, 1.5, (0.5, 0.5)))]


def test_nested_marginals_in_either_order(spark):
    a, b = M.marginalize(group_model(), ["z", "o"]), M.marginalize(group_model(), ["o", "z"])
    assert M.equivalent(a, b) and a.nodes[0].absorbed() == ["z", "o"]
    assert M.equivalent(M.unmarginalize(a), group_model())
    df = spark.createDataFrame([(g, i, y) for g, ys in GROUPS.items() for i, y in enumerate(ys)], "g int, i int, y double")
    got = {r.g: r.logp for r in T.tree_logp(a.nodes[0], df).collect()}
    assert all(math.isclose(got[g], math.log(sum(group_terms(ys)))) for g, ys in GROUPS.items())
    assert math.isclose(M.model_logp(b, df), sum(math.log(sum(group_terms(ys))) for ys in GROUPS.values()))
    for r in T.conditional_table(a, df, "z").collect():
        t = group_terms(GROUPS[r.g])
        assert np.allclose(r.prob, np.array(t) / sum(t))
    inner = M.conditional(a, "o", {"z": 1.0})
    y, prob = df.select("y", inner["prob"]).head()
    assert math.isclose(prob[1], normal(y, 1.5, 4.0) / (normal(y, 1.5, 4.0) + normal(y, 1.5, 1.0)))
    back = M.unmarginalize(a, ["z"])  # what was absorbed with it stays marginal
    assert sorted((n.name, n.dist) for n in back.nodes) == [("o", "Marginal"), ("z", "Bernoulli")]
    share = {r.g: r.m for r in T.recover_table(a, df, "z", 4000).groupBy("g").agg(F.avg("state").alias("m")).collect()}
    assert all(abs(share[g] - group_terms(ys)[1] / sum(group_terms(ys))) < 0.03 for g, ys in GROUPS.items())


def test_three_levels_and_a_mixture_of_chains(spark):
    p = (((0.9, 0.1), (0.2, 0.8)), ((0.5, 0.5), (0.6, 0.4)))
    rows = tuple(tuple(M.Pick("z", (p[0][i][j], p[1][i][j])) for j in range(2)) for i in range(2))
    model = M.Model(
        (
            M.rv("r", "Bernoulli", p=0.3, dims=("a",)),
            M.rv("z", "Bernoulli", p=M.Pick("r", (0.2, 0.7)), dims=("a", "g")),
            M.rv("s", "MarkovChain", p=rows, init=(0.5, 0.5), dims=("a", "g"), order=("at",)),
            M.rv("y", "Normal", mu=M.Pick("s", (0.0, M.Pick("r", (1.0, 2.0)))), sigma=1.0, observed="y", dims=("a", "g", "at")),
        )
    )
    tree = M.marginalize(model, ["r", "s", "z"]).nodes[0]
    assert tree.absorbed() == ["r", "z", "s"] or tree.absorbed() == ["r", "s", "z"]
    data = {("x", 1): [0.1, 1.2, 0.7], ("x", 2): [2.2], ("w", 1): [-0.5, 0.4]}
    df = spark.createDataFrame([(a, g, i, y) for (a, g), ys in data.items() for i, y in enumerate(ys)], "a string, g int, at int, y double")
    want = {}
    for a in ("x", "w"):
        total = 0.0
        for r in (0, 1):
            w = (0.7, 0.3)[r]
            for (b, _), ys in data.items():
                if b == a:
                    w *= sum((((0.8, 0.2), (0.3, 0.7))[r][z]) * sum(u * math.prod(normal(y, (0.0, (1.0, 2.0)[r])[s], 1.0) for y, s in zip(ys, path, strict=True)) for path, u in paths(np.array(p[z]), (0.5, 0.5), 1, len(ys), False)) for z in (0, 1))
            total += w
        want[a] = math.log(total)
    assert {r.a: round(r.logp, 9) for r in T.tree_logp(tree, df).collect()} == {a: round(v, 9) for a, v in want.items()}


def test_dims_tell_what_may_be_summed_out():
    z = M.rv("z", "Bernoulli", p=0.5, dims=("g",))
    w = M.rv("w", "Normal", dims=("g", "k"))
    y = lambda mu, dims=("g", "i"): M.rv("y", "Normal", mu=mu, sigma=1.0, observed="y", dims=dims)
    legal = [M.Ref("z"), M.Pick("z", (0.0, 1.0)), M.Ref("z", 2.0, M.Total(M.Ref("w"), "k")), M.Pick("z", (M.At(M.Ref("w"), "k", 1), 1.0)), M.Pick("z", (0.0, M.Ref("z", 2.0, 1.0)))]
    for mu in legal:
        assert M.marginalize(M.Model((z, w, y(mu))), ["z"]).nodes[-1].rule == "finite"
    illegal = [M.Total(M.Ref("z"), "g"), M.At(M.Ref("z"), "g", 0), M.Ref("w", 1.0, M.Total(M.Ref("z"), "g")), M.Pick("z", (0.0, M.At(M.Ref("z"), "g", 2)))]
    for mu in illegal:
        with pytest.raises(D.ConnectionError):
            M.marginalize(M.Model((z, w, y(mu))), ["z"])
    with pytest.raises(D.ConnectionError):  # the dependent lacks the latent's dimension
        M.marginalize(M.Model((z, y(M.Ref("z"), ("i",)))), ["z"])
    with pytest.raises(ValueError):
        M.marginalize(M.Model((z, w, y(M.Ref("z", 1.0, M.Total(M.Ref("w"), "nope"))))), ["z"])
    assert D.connection(M.Model((z, y(M.Ref("z")))), z, [y(M.Ref("z"))]) == {"y": frozenset({"i"})}


def test_vectors_in_expressions(spark):
    mu = M.Pick("z", (M.At(M.Ref("w"), "k", 1), M.Total(M.Ref("w", 2.0, 1.0), "k")))
    model = M.Model((M.rv("z", "Bernoulli", p=0.25), M.rv("w", "Normal", dims=("k",)), M.rv("y", "Normal", mu=mu, sigma=1.0, observed="y")))
    logp = M.row_logp(M.marginalize(model, ["z"]), {"w": [0.5, -1.0, 2.0]})
    got = spark.createDataFrame([(0.3,)], "y double").select(logp).head()[0]
    assert math.isclose(got, math.log(0.75 * normal(0.3, -1.0, 1) + 0.25 * normal(0.3, 6.0, 1)))


def test_a_circle_is_refused():
    a, b = M.rv("a", "Bernoulli", p=M.Pick("b", (0.1, 0.2))), M.rv("b", "Bernoulli", p=M.Pick("a", (0.1, 0.2)))
    with pytest.raises(NotImplementedError):
        M.marginalize(M.Model((a, b)), ["a", "b"])
