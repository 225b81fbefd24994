"""Registered queries on inference, priors, models, numeric helpers and mini-batches."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import inference as I
from ..operators import numeric as N
from ..sources import loader
from . import model as M
from .builder import LinearModel
from .priors import Prior, align
from .queries_densities import r, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


@register(
    "laplace_gaussian_fit",
    """SELECT round((avg(l_quantity) * count(*) / 100.0::DOUBLE + 10 / 25.0::DOUBLE) / (count(*) / 100.0::DOUBLE + 1 / 25.0::DOUBLE), 6) AS mean, round(1 / (count(*) / 100.0::DOUBLE + 1 / 25.0::DOUBLE), 9) AS variance FROM lineitem""",
)
def laplace_gaussian_fit(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_quantity")
    target = I.table_target(df, E.normal(E.data("l_quantity"), E.param("mu"), 10.0), E.normal(E.param("mu"), 10.0, 5.0), ["mu"])
    fit = I.fit_laplace(target, np.array([0.0]))
    return spark.createDataFrame([(round(float(fit.mean[0]), 6), round(float(fit.covariance[0, 0]), 9))], "mean double, variance double")


@register("map_poisson_rate", "SELECT round(ln((sum(p_size) + 2.0::DOUBLE) / (count(*) + 0.1::DOUBLE)), 6) AS log_rate FROM part")
def map_poisson_rate(spark, sf_dir):
    """A Poisson rate with a gamma prior, its mode on the log scale; data enter as counts of each value."""
    bins = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    lam = E.param("log_rate")
    target = I.table_target(bins, E.data("n") * E.poisson(E.data("p_size"), lam), 2.0 * lam - 0.1 * E.exp(lam), ["log_rate"])
    x, _, _ = I.find_map(target, np.array([1.0]), method="newton")
    return spark.createDataFrame([(round(float(x[0]), 6),)], "log_rate double")


_NEWTON = """WITH RECURSIVE bins AS (SELECT (l_quantity - 25) / 15.0::DOUBLE AS x, sum((l_returnflag = 'N')::INT)::DOUBLE AS k, count(*)::DOUBLE AS n FROM lineitem GROUP BY l_quantity),
    f AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
      UNION ALL SELECT i + 1, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
        SELECT i, any_value(a) AS a, any_value(b) AS b, sum(k - n * p) - any_value(a) / 4 AS ga, sum(x * (k - n * p)) - any_value(b) / 4 AS gb,
          sum(n * p * (1 - p)) + 0.25::DOUBLE AS haa, sum(x * n * p * (1 - p)) AS hab, sum(x * x * n * p * (1 - p)) + 0.25::DOUBLE AS hbb
        FROM (SELECT i, a, b, x, k, n, 1 / (1 + exp(-a - b * x)) AS p FROM f, bins WHERE i < 15) GROUP BY i))
    SELECT 'a' AS param, round(a, 5) AS value FROM f WHERE i = 15 UNION ALL SELECT 'b', round(b, 5) FROM f WHERE i = 15"""


@register("logistic_map", _NEWTON)
def logistic_map(spark, sf_dir):
    """Two logistic coefficients by L-BFGS, each look one aggregate."""
    df = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "N").cast("int").alias("y"), ((F.col("l_quantity") - 25) / 15).alias("x"))
    target = I.table_target(df, E.bernoulli_logit(E.data("y"), E.param("a") + E.param("b") * E.data("x")), E.normal(E.param("a"), 0.0, 2.0) + E.normal(E.param("b"), 0.0, 2.0), ["a", "b"])
    x, _, _ = I.find_map(target, np.zeros(2), method="lbfgs", tol=1e-6)
    return spark.createDataFrame([("a", round(float(x[0]), 5)), ("b", round(float(x[1]), 5))], "param string, value double")


@register("linear_model_ols", "SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem")
def linear_model_ols(spark, sf_dir):
    a, b = N.ols(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(round(float(a), 3), round(float(b), 4))], "intercept double, slope double")


@register("linear_model_posterior")
def linear_model_posterior(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(((F.col("l_quantity") - 25) / 15).alias("input"), (F.col("l_extendedprice") / 10000).alias("output"))
    return LinearModel({"noise_sd": 5.0}, {"draws": 200, "seed": 1}).fit(df).posterior


def sizes(spark, sf_dir) -> tuple[float, float, float]:
    """How many parts there are, and mean and variance of their sizes in tens: all that a normal likelihood of them needs."""
    x = F.col("p_size") / 10
    return tuple(float(v) for v in table(spark, sf_dir, "part").agg(F.count(F.lit(1)), F.avg(x), F.var_pop(x)).head())


def normal_posterior(n: float, mean: float, variance: float):
    """Log density of (mean, log of the spread) given the rows' moments, with standard normal priors on both, and its slopes."""

    def look(x):
        m, s = float(x[0]), float(x[1])
        squares, sharp = n * (variance + (mean - m) ** 2), float(np.exp(np.clip(-2 * s, -700, 700)))
        value = -n * s - 0.5 * squares * sharp - 0.5 * n * math.log(2 * math.pi) - 0.5 * m * m - 0.5 * s * s
        return value, np.array([n * (mean - m) * sharp - m, -n + squares * sharp - s])

    return look


@register("pathfinder")
def pathfinder(spark, sf_dir):
    return I.fit_pathfinder(spark, normal_posterior(*sizes(spark, sf_dir)), np.array([2.0, 0.0]), paths=4, draws_per_path=200, draws=300, seed=3)


@register("dadvi_gaussian")
def dadvi_gaussian(spark, sf_dir):
    df = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    target = I.table_target(df, E.data("n") * E.poisson(E.data("p_size"), E.param("log_rate")), E.normal(E.param("log_rate"), 3.0, 1.0), ["log_rate"])
    fit = I.fit_dadvi(target, np.array([3.0]), n_fixed=6, steps=8)
    return spark.createDataFrame([(float(fit.mean[0]), float(np.sqrt(fit.covariance[0, 0])))], "mean double, sd double")


@register("advi_guides")
def advi_guides(spark, sf_dir):
    look = normal_posterior(*sizes(spark, sf_dir))
    target = I.function_target(["mean", "log_sd"], lambda x: look(x)[0], lambda x: look(x)[1])
    rows = [(kind, *map(float, fit.mean), *map(float, np.sqrt(np.diag(fit.covariance)))) for kind in ("diagonal", "full", "low_rank") for fit in [I.fit_advi(target, kind, steps=800, seed=2)]]
    return spark.createDataFrame(rows, "kind string, mean double, log_sd double, sd_mean double, sd_log_sd double")


@register("smc_bimodal", "SELECT 150::BIGINT AS particles, round(sqrt(avg(p_size / 50.0::DOUBLE)), 1) AS mode, true AS both_sides, true AS narrow FROM part")
def smc_bimodal(spark, sf_dir):
    """Part sizes around the square of a parameter: particles stay at both roots, the mass split between them."""
    from ..operators import smc

    df = table(spark, sf_dir, "part").select((F.col("p_size") / 50.0).alias("y"))
    a = E.param("a")
    x, _ = smc.fit_smc(df, E.normal(E.data("y"), a * a, 0.3), E.normal(a, 0.0, 1.0), ["a"], ["y"], lambda rng: rng.normal(size=1), particles=150, moves=1, step=0.05, depth=2, seed=4)
    found = spark.createDataFrame([(i, float(v[0])) for i, v in enumerate(x)], "particle int, a double")
    return found.agg(F.count(F.lit(1)).alias("particles"), r(F.avg(F.abs("a")), 1).alias("mode"), F.avg((F.col("a") > 0).cast("int")).between(0.1, 0.9).alias("both_sides"), (F.stddev(F.abs("a")) < 0.1).alias("narrow"))


# Years are independent given the spread: each one's mode by Newton steps of its own.
_INLA = """WITH RECURSIVE c AS (SELECT count(*)::DOUBLE AS y FROM orders GROUP BY year(o_orderdate)), g AS (SELECT unnest([0.05::DOUBLE, 0.1, 0.2, 0.4, 0.8]) AS sd),
    s AS (SELECT sd, y, row_number() OVER () AS id, (SELECT ln(avg(y)) FROM c) AS mu FROM c, g),
    f AS (SELECT id, 0 AS i, mu AS x FROM s
      UNION ALL SELECT f.id, i + 1, x + (y - exp(x) - (x - mu) / (sd * sd)) / (exp(x) + 1 / (sd * sd)) FROM f JOIN s ON f.id = s.id WHERE i < 60),
    l AS (SELECT sd, sum(y * x - exp(x) - (x - mu) * (x - mu) / (2 * sd * sd) - ln(sd) - 0.5::DOUBLE * ln(exp(x) + 1 / (sd * sd))) - sd AS logp FROM f JOIN s ON f.id = s.id WHERE i = 60 GROUP BY sd)
    SELECT sd, round(exp(logp - (SELECT max(logp) FROM l)) / (SELECT sum(exp(logp - (SELECT max(logp) FROM l))) FROM l), 6) AS weight FROM l"""


@register("inla_grid", _INLA)
def inla_grid(spark, sf_dir):
    """Yearly orders as Poisson counts of a latent level with unknown spread: the spread on a grid, the level by Laplace."""
    y = np.array([row[1] for row in table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).count().orderBy("y").collect()], dtype=float)  # one count a year

    def likelihood(at):
        return lambda x: (float((y * x - np.exp(x)).sum()), y - np.exp(x), -np.diag(np.exp(x)))

    got = I.fit_inla({"sd": np.array([0.05, 0.1, 0.2, 0.4, 0.8])}, lambda at: -at["sd"], lambda at: (np.full(len(y), math.log(y.mean())), np.eye(len(y)) / at["sd"] ** 2), likelihood)
    return spark.createDataFrame([(float(a), round(float(b), 6)) for a, b in zip(got["sd"], got["weight"], strict=True)], "sd double, weight double")


@register(
    "importance_weights",
    """WITH w AS (SELECT p_partkey, -0.5::DOUBLE * ((p_size - 25) / 10.0::DOUBLE) ** 2 + ln(50.0::DOUBLE) - ln(10 * sqrt(2 * pi())) AS w FROM part)
    SELECT round(sum(exp(w)) ** 2 / sum(exp(2 * w)), 4) AS ess, round(ln(avg(exp(w))), 6) AS log_evidence FROM w""",
)
def importance_weights(spark, sf_dir):
    """Part sizes as draws of a uniform proposal, weighed towards a normal target."""
    from ..functions.special import normal_logp

    w = table(spark, sf_dir, "part").select((normal_logp(F.col("p_size"), 25.0, 10.0) + math.log(50)).alias("w"))
    return w.agg(r(I.effective_size("w"), 4).alias("ess"), r(F.log(F.avg(F.exp("w")))).alias("log_evidence"))


@register("importance_resample")
def importance_resample(spark, sf_dir):
    from ..functions.special import normal_logp

    s = table(spark, sf_dir, "part").select("p_partkey", "p_size", normal_logp(F.col("p_size"), 25.0, 10.0).alias("logp"), F.lit(-math.log(50)).alias("logq"))
    return I.importance_sampling(s, 200, method="psis", seed=5)


@register("systematic_resample")
def systematic_resample(spark, sf_dir):
    from ..functions.special import normal_logp

    s = table(spark, sf_dir, "part").select("p_partkey", normal_logp(F.col("p_size"), 25.0, 10.0).alias("w"))
    return I.weighted_resample(s, "p_partkey", "w", 1000, seed=6)


@register(
    "mvn_prior_moments",
    """SELECT round(avg(l_quantity), 6) AS m1, round(avg(l_discount), 8) AS m2, round(sqrt(var_samp(l_quantity)), 6) AS c11, round(covar_samp(l_quantity, l_discount) / sqrt(var_samp(l_quantity)), 8) AS c21,
    round(sqrt(var_samp(l_discount) - covar_samp(l_quantity, l_discount) ** 2 / var_samp(l_quantity)), 8) AS c22 FROM lineitem""",
)
def mvn_prior_moments(spark, sf_dir):
    mean, root = N.prior_from_draws(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return spark.createDataFrame([(round(float(mean[0]), 6), round(float(mean[1]), 8), round(float(root[0, 0]), 6), round(float(root[1, 0]), 8), round(float(root[1, 1]), 8))], "m1 double, m2 double, c11 double, c21 double, c22 double")


@register(
    "bspline_basis",
    """WITH v AS (SELECT p_partkey, p_size, (p_size - 1) / 49.0::DOUBLE AS x FROM part)
    SELECT p_partkey, p_size, round((1 - x) ** 4, 6) AS b0, round(4 * x * (1 - x) ** 3, 6) AS b1, round(6 * x ** 2 * (1 - x) ** 2, 6) AS b2, round(4 * x ** 3 * (1 - x), 6) AS b3, round(x ** 4, 6) AS b4 FROM v""",
)
def bspline_basis(spark, sf_dir):
    """Five functions of degree four on one interval, which are Bernstein polynomials."""
    v = table(spark, sf_dir, "part").select("p_partkey", "p_size", ((F.col("p_size") - 1) / 49).alias("x"))
    return v.select("p_partkey", "p_size", *[r(b).alias(f"b{i}") for i, b in enumerate(N.bspline_basis(F.col("x"), 5, 4))])


@register("bspline_knots", "SELECT p_partkey, p_size, 1.0::DOUBLE AS total FROM part")
def bspline_knots(spark, sf_dir):
    v = table(spark, sf_dir, "part").select("p_partkey", "p_size", ((F.col("p_size") - 1) / 49).alias("x"))
    basis = N.bspline_basis(F.col("x"), 9, 3)
    return v.select("p_partkey", "p_size", r(sum(basis[1:], basis[0])).alias("total"))


@register("standard_scale", "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS z FROM customer")
def standard_scale(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return N.StandardScaler(["c_acctbal"]).fit_transform(df).select("c_custkey", r(F.col("c_acctbal")).alias("z"))


@register(
    "dims_alignment",
    """SELECT n_nationkey, r_regionkey, round(10.0 * n_nationkey + r_regionkey::DOUBLE + 0.5::DOUBLE, 6) AS total FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def dims_alignment(spark, sf_dir):
    """Tables with (region, nation), (region) and no dimension side by side."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), (10.0 * F.col("n_nationkey")).alias("a"))
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), F.col("r_regionkey").cast("double").alias("b"))
    one = spark.range(1).select(F.lit(0.5).alias("c"))
    got = align({"a": nation, "b": region, "c": one}, {"a": ("region", "nation"), "b": ("region",), "c": ()}, {"region": region.select("region"), "nation": nation.select("nation")})
    return got.select(F.col("nation").alias("n_nationkey"), F.col("region").alias("r_regionkey"), r(F.col("a") + F.col("b") + F.col("c")).alias("total"))


@register("prior_draws")
def prior_draws(spark, sf_dir):
    p = Prior("Normal", mu=Prior("Normal", mu=1.0, sigma=0.5), sigma=Prior("HalfNormal", sigma=1.0), dims=("g",), centered=False)
    names = [row[0] for row in table(spark, sf_dir, "region").select("r_name").orderBy("r_name").collect()]  # five
    return p.sample(spark, {"g": names}, draws=100, name="x", seed=7)


_MIX = M.Model((M.rv("z", "Bernoulli", p=0.7), M.rv("y", "Normal", mu=M.Pick("z", (10.0, 30.0)), sigma=8.0, observed="l_quantity")))


@register(
    "model_marginalized_logp",
    """SELECT l_returnflag, round(sum(ln(0.3::DOUBLE * exp(-0.5::DOUBLE * ((l_quantity - 10) / 8) ** 2) / (8 * sqrt(2 * pi())) + 0.7::DOUBLE * exp(-0.5::DOUBLE * ((l_quantity - 30) / 8) ** 2) / (8 * sqrt(2 * pi())))), 4) AS logp FROM lineitem GROUP BY l_returnflag""",
)
def model_marginalized_logp(spark, sf_dir):
    logp = M.row_logp(M.marginalize(_MIX, ["z"]))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r(F.sum(logp), 4).alias("logp"))


@register(
    "model_conditional_prob",
    """SELECT l_returnflag, round(avg(0.7::DOUBLE * exp(-0.5::DOUBLE * ((l_quantity - 30) / 8) ** 2) / (0.3::DOUBLE * exp(-0.5::DOUBLE * ((l_quantity - 10) / 8) ** 2) + 0.7::DOUBLE * exp(-0.5::DOUBLE * ((l_quantity - 30) / 8) ** 2))), 6) AS p FROM lineitem GROUP BY l_returnflag""",
)
def model_conditional_prob(spark, sf_dir):
    got = M.conditional(M.marginalize(_MIX, ["z"]), "z")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r(F.avg(F.get(got["prob"], F.lit(1)))).alias("p"))


@register("model_recover")
def model_recover(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("l_quantity"))
    draws = spark.range(3).select(F.col("id").alias("draw"))
    return M.recover(M.marginalize(_MIX, ["z"]), rows, draws, "z", "p_partkey")


@register("minibatch_sizes", "SELECT b::BIGINT AS batch, 256::BIGINT AS n FROM range((SELECT count(*) // 256 FROM lineitem)) t(b)")
def minibatch_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount")
    return loader.batches(rows, 256, seed=1, epoch=1).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@register("mask_missing", "SELECT event_id, CASE WHEN value < 400 THEN value END AS value FROM events")
def mask_missing(spark, sf_dir):
    v = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") < 400, F.col("value")).otherwise(F.lit(float("nan"))).alias("value"))
    return loader.mask_missing(v, ["value"])


@register(
    "partial_order",
    """SELECT p_partkey, round(a, 6) AS a, round(a + exp(b), 6) AS b, round(a + exp(c), 6) AS c, round(greatest(a + exp(b), a + exp(c)) + exp(d), 6) AS d
    FROM (SELECT p_partkey, p_size / 10.0::DOUBLE AS a, (p_size % 7) / 5.0::DOUBLE AS b, (p_size % 11) / 7.0::DOUBLE AS c, (p_size % 3) / 2.0::DOUBLE AS d FROM part)""",
)
def partial_order(spark, sf_dir):
    order = N.PartialOrder(np.array([[0, 1, 1, 1], [0, 0, 0, 1], [0, 0, 0, 1], [0, 0, 0, 0]]))
    x = F.col("p_size")
    made = order.backward_columns([x / 10.0, (x % 7) / 5.0, (x % 11) / 7.0, (x % 3) / 2.0])
    return table(spark, sf_dir, "part").select("p_partkey", *[r(c).alias(n) for c, n in zip(made, "abcd", strict=True)])


# One regressor after another, what the ones before explain taken out; then the coefficients backwards.
_LEAST_SQUARES = """WITH v AS (SELECT l_quantity / 50::DOUBLE AS q, l_discount * 10 AS d, l_tax * 10 AS t, l_extendedprice / 1e5::DOUBLE AS y FROM lineitem),
    m AS (SELECT avg(q) AS mq, avg(d) AS md, avg(t) AS mt, avg(y) AS my, var_pop(q) AS qq, covar_pop(q, d) AS qd, covar_pop(q, t) AS qt, covar_pop(q, y) AS qy,
      var_pop(d) AS dd, covar_pop(d, t) AS dt, covar_pop(d, y) AS dy, var_pop(t) AS tt, covar_pop(t, y) AS ty FROM v),
    e AS (SELECT *, dd - qd * qd / qq AS dd1, dt - qd * qt / qq AS dt1, dy - qd * qy / qq AS dy1, tt - qt * qt / qq AS tt1, ty - qt * qy / qq AS ty1 FROM m),
    c AS (SELECT *, (ty1 - dt1 * dy1 / dd1) / (tt1 - dt1 * dt1 / dd1) AS bt FROM e), c2 AS (SELECT *, (dy1 - dt1 * bt) / dd1 AS bd FROM c), c3 AS (SELECT *, (qy - qd * bd - qt * bt) / qq AS bq FROM c2)
    SELECT term, round(value, 6) AS value FROM (SELECT unnest(['one', 'q', 'd', 't']) AS term, unnest([my - bq * mq - bd * md - bt * mt, bq, bd, bt]) AS value FROM c3)"""


@register("linear_cg", _LEAST_SQUARES)
def linear_cg(spark, sf_dir):
    """Least squares of price on quantity, discount and tax by conjugate gradients on the normal equations, each product one aggregate."""
    xs = ["one", "q", "d", "t"]
    df = table(spark, sf_dir, "lineitem").select(F.lit(1.0).alias("one"), (F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), (F.col("l_tax") * 10).alias("t"), (F.col("l_extendedprice") / 1e5).alias("y"))
    b = np.array([float(v) for v in df.agg(*[F.avg(F.col(x) * F.col("y")) for x in xs]).head()])

    def times(v):
        fit = sum((F.col(x) * float(w) for x, w in zip(xs[1:], v[1:], strict=True)), F.col("one") * float(v[0]))
        return np.array([float(s) for s in df.agg(*[F.avg(F.col(x) * fit) for x in xs]).head()])

    got = N.linear_cg(times, b, tol=1e-12)
    return spark.createDataFrame([(x, round(float(v), 6)) for x, v in zip(xs, got, strict=True)], "term string, value double")


@register("gp_projected")
def gp_projected(spark, sf_dir):
    """Embeddings' inducing points by k-means, and a process' prior mean values at them."""
    e = table(spark, sf_dir, "embeddings").select(*[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(3)])
    z = N.inducing_points(e, ["x0", "x1", "x2"], 5, seed=1)
    f = N.ProjectedProcess(z, lambda a, b: N.rbf(a, b, 0.3)).prior(z, np.ones(len(z)))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(f)], "point int, value double")
