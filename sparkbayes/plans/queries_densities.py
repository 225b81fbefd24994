"""Registered queries on densities, histograms, chains and marginals, with DuckDB equivalents in other formulations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.special import normal_logp
from ..operators import histogram, marginal, markov

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x, digits: int = 6):
    return F.round(x, digits)


# --- distributions -----------------------------------------------------------------------------------------------


@register(
    "gev_logp_by_flag",
    """SELECT l_returnflag, count(*)::BIGINT AS n, round(sum(CASE WHEN 1 + 0.1::DOUBLE * z > 0 THEN -ln(10.0::DOUBLE) - (11.0::DOUBLE) * ln(1 + 0.1::DOUBLE * z) - pow(1 + 0.1::DOUBLE * z, -10.0::DOUBLE) END), 4) AS logp
    FROM (SELECT l_returnflag, (l_quantity - 20.0::DOUBLE) / 10.0::DOUBLE AS z FROM lineitem) GROUP BY l_returnflag""",
)
def gev_logp_by_flag(spark, sf_dir):
    logp = D.GenExtreme(20.0, 10.0, 0.1).logp(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.when(logp > float("-inf"), logp)), 4).alias("logp"))


@register(
    "genextreme",
    """WITH v AS (SELECT p_partkey, p_size AS x, (p_size - 20.0::DOUBLE) / 15.0::DOUBLE AS z FROM part)
    SELECT p_partkey, x, round(-ln(15.0::DOUBLE) - 6 * ln(1 + z / 5) - pow(1 + z / 5, -5.0::DOUBLE), 6) AS logp, round(-pow(1 + z / 5, -5.0::DOUBLE), 6) AS logcdf,
      round(20 + 15 * (pow(-ln((x + 0.0::DOUBLE) / 51), -0.2::DOUBLE) - 1) / 0.2::DOUBLE, 6) AS icdf, round(20 + 15 * (pow(1.2::DOUBLE, -0.2::DOUBLE) - 1) / 0.2::DOUBLE, 6) AS mode, round(-z - ln(15.0::DOUBLE) - exp(-z), 6) AS gumbel_logp FROM v""",
)
def genextreme(spark, sf_dir):
    d, x = D.GenExtreme(20.0, 15.0, 0.2), F.col("x")
    v = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("x"))
    return v.select("p_partkey", "x", r(d.logp(x)).alias("logp"), r(d.logcdf(x)).alias("logcdf"), r(d.icdf(x / 51)).alias("icdf"), r(d.support_point()).alias("mode"), r(D.GenExtreme(20.0, 15.0).logp(x)).alias("gumbel_logp"))


@register(
    "genpareto",
    """WITH v AS (SELECT p_partkey, p_size AS x, p_size / 12.0::DOUBLE AS z FROM part)
    SELECT p_partkey, x, round(-ln(12.0::DOUBLE) - (1 / 0.3::DOUBLE + 1) * ln(1 + 0.3::DOUBLE * z), 6) AS logp, round(ln(1 - pow(1 + 0.3::DOUBLE * z, -1 / 0.3::DOUBLE)), 6) AS logcdf,
      round(-ln(1 + 0.3::DOUBLE * z) / 0.3::DOUBLE, 6) AS logsf, round(12 * (pow(1 - x / 51.0::DOUBLE, -0.3::DOUBLE) - 1) / 0.3::DOUBLE, 6) AS icdf,
      round(12 * (pow(x / 51.0::DOUBLE, -0.3::DOUBLE) - 1) / 0.3::DOUBLE, 6) AS isf, round(ln(1 - exp(-z)), 6) AS exp_logcdf FROM v""",
)
def genpareto(spark, sf_dir):
    d, x = D.GenPareto(0.0, 12.0, 0.3), F.col("x")
    v = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("x"))
    return v.select("p_partkey", "x", r(d.logp(x)).alias("logp"), r(d.logcdf(x)).alias("logcdf"), r(d.logsf(x)).alias("logsf"), r(d.icdf(x / 51)).alias("icdf"), r(d.isf(x / 51)).alias("isf"), r(D.GenPareto(0.0, 12.0, 0.0).logcdf(x)).alias("exp_logcdf"))


@register(
    "extgenpareto",
    """WITH v AS (SELECT p_partkey, p_size AS x, 1 - pow(1 + 0.3::DOUBLE * p_size / 12.0::DOUBLE, -1 / 0.3::DOUBLE) AS h, -ln(12.0::DOUBLE) - (1 / 0.3::DOUBLE + 1) * ln(1 + 0.3::DOUBLE * p_size / 12.0::DOUBLE) AS l FROM part)
    SELECT p_partkey, x, round(ln(2.5::DOUBLE) + 1.5::DOUBLE * ln(h) + l, 6) AS logp, round(2.5::DOUBLE * ln(h), 6) AS logcdf, round(ln(1 - pow(h, 2.5::DOUBLE)), 6) AS logsf,
      round(12 * (pow(1 - pow(x / 51.0::DOUBLE, 0.4::DOUBLE), -0.3::DOUBLE) - 1) / 0.3::DOUBLE, 6) AS icdf, round(ln(pow(h, 2.5::DOUBLE) / (1 - pow(h, 2.5::DOUBLE))), 6) AS logit FROM v""",
)
def extgenpareto(spark, sf_dir):
    d, x = D.ExtGenPareto(0.0, 12.0, 0.3, 2.5), F.col("x")
    v = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("x"))
    return v.select("p_partkey", "x", r(d.logp(x)).alias("logp"), r(d.logcdf(x)).alias("logcdf"), r(d.logsf(x)).alias("logsf"), r(d.icdf(x / 51)).alias("icdf"), r(d.forward(x)).alias("logit"))


@register(
    "pareto_logit_transform",
    """SELECT p_partkey, p_size AS x, round((p_size - 25) / 10.0::DOUBLE, 6) AS forward_of_backward,
      round(12 * (pow(1 - 1 / (1 + exp(-(p_size - 25) / 10.0::DOUBLE)), -0.3::DOUBLE) - 1) / 0.3::DOUBLE, 6) AS backward FROM part""",
)
def pareto_logit_transform(spark, sf_dir):
    d, v = D.GenPareto(0.0, 12.0, 0.3), (F.col("x") - 25) / 10
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("x"))
    rows = rows.withColumn("b", d.backward(v))
    return rows.select("p_partkey", "x", r(d.forward(F.col("b"))).alias("forward_of_backward"), r(F.col("b")).alias("backward"))


_GAMMA_P = "least(1.0::DOUBLE, list_sum([exp(({a}) * ln({x}) - ({x}) + k * ln({x}) - lgamma(({a}) + k + 1)) FOR k IN range(0, 200)]))"


@register(
    "chi_maxwell",
    f"""WITH v AS (SELECT p_partkey, p_size AS s, p_size / 10.0::DOUBLE AS x FROM part)
    SELECT p_partkey, s, round((1 - 1.5::DOUBLE) * ln(2.0::DOUBLE) + 2 * ln(x) - x * x / 2 - lgamma(1.5::DOUBLE), 6) AS chi_logp, round(ln({_GAMMA_P.format(a="1.5::DOUBLE", x="x * x / 2")}), 6) AS chi_logcdf,
      round(0.5::DOUBLE * ln(2 / pi()) + 2 * ln(x) - x * x / 8 - 3 * ln(2.0::DOUBLE), 6) AS maxwell_logp, round(ln({_GAMMA_P.format(a="1.5::DOUBLE", x="x * x / 8")}), 6) AS maxwell_logcdf FROM v""",
)
def chi_maxwell(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("s"), (F.col("p_size") / 10.0).alias("x"))
    chi, maxwell = D.Chi(3.0), D.Maxwell(2.0)
    return rows.select("p_partkey", "s", r(chi.logp(F.col("x"))).alias("chi_logp"), r(chi.logcdf(F.col("x"))).alias("chi_logcdf"), r(maxwell.logp(F.col("x"))).alias("maxwell_logp"), r(maxwell.logcdf(F.col("x"))).alias("maxwell_logcdf"))


@register(
    "count_densities",
    """WITH v AS (SELECT p_partkey, p_size AS x FROM part)
    SELECT p_partkey, x, round(ln(12.0::DOUBLE) + (x - 1) * ln(12 + 0.4::DOUBLE * x) - (12 + 0.4::DOUBLE * x) - lgamma(x + 1.0::DOUBLE), 6) AS generalized_poisson,
      round(lgamma(5.0::DOUBLE + x) + lgamma(7.0::DOUBLE) - lgamma(12.0::DOUBLE + x) - lgamma(5.0::DOUBLE) - lgamma(3.0::DOUBLE) + lgamma(8.0::DOUBLE) + lgamma(x + 4.0::DOUBLE) - lgamma(x + 1.0::DOUBLE) - lgamma(4.0::DOUBLE), 6) AS beta_negative_binomial,
      round(x * ln(20.0::DOUBLE) - 20 - lgamma(x + 1.0::DOUBLE), 6) AS poisson FROM v""",
)
def count_densities(spark, sf_dir):
    rows, x = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("x")), F.col("x")
    return rows.select("p_partkey", "x", r(D.GeneralizedPoisson(12.0, 0.4).logp(x)).alias("generalized_poisson"), r(D.BetaNegativeBinomial(3.0, 4.0, 5.0).logp(x)).alias("beta_negative_binomial"), r(D.Poisson(20.0).logp(x)).alias("poisson"))


@register(
    "skellam",
    """WITH v AS (SELECT p_partkey, p_size - 25 AS x FROM part)
    SELECT p_partkey, x, round(ln(list_sum([exp(-11.0::DOUBLE + (greatest(x, 0) + k) * ln(7.0::DOUBLE) + (greatest(-x, 0) + k) * ln(4.0::DOUBLE) - lgamma(greatest(x, 0) + k + 1.0::DOUBLE) - lgamma(greatest(-x, 0) + k + 1.0::DOUBLE)) FOR k IN range(0, 120)])), 6) AS logp FROM v""",
)
def skellam(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") - 25).alias("x"))
    return rows.select("p_partkey", "x", r(D.Skellam(7.0, 4.0).logp(F.col("x"))).alias("logp"))


EVENT = ["click", "error", "purchase", "signup", "view"]


def states(spark, sf_dir) -> DataFrame:
    """Events with their type's number in order of names."""
    number = F.array_position(F.array(*[F.lit(e) for e in EVENT]), F.col("event_type")) - 1
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", number.cast("int").alias("state"), "value")


def log_values(spark, sf_dir) -> DataFrame:
    """``states`` with y, the log of the value: -inf at zero, which Spark's own log makes null."""
    return states(spark, sf_dir).withColumn("y", F.when(F.col("value") == 0, F.lit(float("-inf"))).otherwise(F.log("value")))


_STATES = "states AS (SELECT user_id, ts, event_id, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS state, value FROM events)"
_PAIR = np.array([[(1 + (3 * i + 5 * j) % 7) for j in range(5)] for i in range(5)], dtype=float)


@register(
    "joint_categorical",
    f"""WITH {_STATES}, pairs AS (SELECT user_id, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, state AS b FROM states),
    weights AS (SELECT i, j, 1 + (3 * i + 5 * j) % 7 AS w FROM range(0, 5) r(i), range(0, 5) s(j))
    SELECT a, b, count(*)::BIGINT AS n, round(sum(ln(w::DOUBLE / (SELECT sum(w) FROM weights))), 4) AS logp FROM pairs JOIN weights ON a = i AND b = j GROUP BY a, b""",
)
def joint_categorical(spark, sf_dir):
    d = D.JointCategorical.of(p=_PAIR / _PAIR.sum())
    pairs = markov.lags(states(spark, sf_dir), "user_id", ["ts", "event_id"], "state", 1).where("s_1 is not null")
    return pairs.groupBy(F.col("s_1").alias("a"), F.col("state").alias("b")).agg(F.count(F.lit(1)).alias("n"), r(F.sum(d.logp(F.col("s_1"), F.col("state"))), 4).alias("logp"))


@register("distribution_draws")
def distribution_draws(spark, sf_dir):
    """Seeded draws by row key: mean of each distribution's draws beside nothing else; the tests compare moments."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    key = F.col("o_orderkey")
    made = {
        "genextreme": D.GenExtreme(0.0, 1.0, 0.1), "genpareto": D.GenPareto(0.0, 1.0, 0.1), "extgenpareto": D.ExtGenPareto(0.0, 1.0, 0.1, 2.0),
        "generalized_poisson": D.GeneralizedPoisson(4.0, 0.2), "beta_negative_binomial": D.BetaNegativeBinomial(8.0, 4.0, 5.0), "skellam": D.Skellam(7.0, 4.0),
    }
    return rows.select("o_orderkey", *[d.draw(key, seed=3).alias(n) for n, d in made.items()])


@register("continuous_draws")
def continuous_draws(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.Chi(3.0).draw(key, 1).alias("chi"), D.Maxwell(2.0).draw(key, 2).alias("maxwell"), D.JointCategorical.of(p=_PAIR / _PAIR.sum()).draw(key, 3).alias("pair"))


# --- histograms --------------------------------------------------------------------------------------------------


@register(
    "quantile_histogram",
    """WITH e AS (SELECT quantile_cont(value, [i / 20.0 FOR i IN range(0, 21)]) AS q FROM events),
    b AS (SELECT i - 1 AS bin, q[i] AS lower, q[i + 1] AS upper FROM e, range(1, 21) r(i))
    SELECT bin::BIGINT AS bin, round(lower, 6) AS lower, round(upper, 6) AS upper, count(*)::BIGINT AS count FROM events JOIN b ON value >= lower AND (value < upper OR (bin = 19 AND value <= upper)) GROUP BY bin, lower, upper""",
)
def quantile_histogram(spark, sf_dir):
    return histogram.quantile_histogram(table(spark, sf_dir, "events"), "value", 21).select("bin", r(F.col("lower")).alias("lower"), r(F.col("upper")).alias("upper"), "count")


@register(
    "zero_inflated_histogram",
    """WITH v AS (SELECT CASE WHEN event_type = 'view' THEN 0.0::DOUBLE ELSE value END AS v FROM events), e AS (SELECT quantile_cont(v, [i / 10.0 FOR i IN range(0, 11)]) AS q FROM v WHERE v > 0),
    b AS (SELECT i AS bin, q[i] AS lower, q[i + 1] AS upper FROM e, range(1, 11) r(i))
    SELECT bin::BIGINT AS bin, round(lower, 6) AS lower, count(*)::BIGINT AS count FROM v JOIN b ON v > 0 AND v >= lower AND (v < upper OR (bin = 10 AND v <= upper)) GROUP BY bin, lower
    UNION ALL SELECT 0::BIGINT, 0.0::DOUBLE, count(*)::BIGINT FROM v WHERE v = 0""",
)
def zero_inflated_histogram(spark, sf_dir):
    v = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("value")).alias("v"))
    return histogram.quantile_histogram(v, "v", 11, zero_inflation=True).select("bin", r(F.col("lower")).alias("lower"), "count")


@register(
    "discrete_histogram_min_count",
    """WITH c AS (SELECT p_size AS mid, count(*) AS n FROM part GROUP BY p_size), k AS (SELECT mid, lead(mid) OVER (ORDER BY mid) AS next FROM c WHERE n >= 40)
    SELECT mid, sum(n)::BIGINT AS count FROM (SELECT k.mid, c.n FROM k JOIN c ON c.mid >= k.mid AND (k.next IS NULL OR c.mid < k.next)) GROUP BY mid""",
)
def discrete_histogram_min_count(spark, sf_dir):
    return histogram.discrete_histogram(table(spark, sf_dir, "part"), "p_size", 40)


@register(
    "histogram_weighted_logp",
    """WITH e AS (SELECT quantile_cont(value, [i / 50.0 FOR i IN range(0, 51)]) AS q FROM events), b AS (SELECT i AS bin, q[i] AS lower, q[i + 1] AS upper FROM e, range(1, 51) r(i)),
    h AS (SELECT (lower + upper) / 2 AS mid, count(*) AS n FROM events JOIN b ON value >= lower AND (value < upper OR (bin = 50 AND value <= upper)) GROUP BY lower, upper),
    d AS (SELECT p_size AS mid, count(*) AS n FROM part GROUP BY p_size)
    SELECT (SELECT round(sum(n * (-0.5::DOUBLE * ((mid - 100) / 80) ** 2 - ln(80.0::DOUBLE) - 0.5::DOUBLE * ln(2 * pi()))), 3) FROM h) AS normal_logp, (SELECT round(sum(n * (mid * ln(25.0::DOUBLE) - 25 - lgamma(mid + 1.0::DOUBLE))), 3) FROM d) AS poisson_logp""",
)
def histogram_weighted_logp(spark, sf_dir):
    a = histogram.histogram_approximation(table(spark, sf_dir, "events"), "value", D.Normal(100.0, 80.0).logp, n_quantiles=51)
    b = histogram.histogram_approximation(table(spark, sf_dir, "part"), "p_size", D.Poisson(25.0).logp)
    return a.select(r(F.col("logp"), 3).alias("normal_logp")).crossJoin(F.broadcast(b.select(r(F.col("logp"), 3).alias("poisson_logp"))))  # one row each


# --- chains ------------------------------------------------------------------------------------------------------


@register(
    "markov_transition_matrix",
    f"""WITH {_STATES}, p AS (SELECT lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, state AS b FROM states), c AS (SELECT a, b, count(*) AS n FROM p WHERE a IS NOT NULL GROUP BY a, b)
    SELECT a, b, n::BIGINT AS n, round(n / sum(n) OVER (PARTITION BY a)::DOUBLE, 6) AS p FROM c""",
)
def markov_transition_matrix(spark, sf_dir):
    got = markov.transition_counts(states(spark, sf_dir), "user_id", ["ts", "event_id"], "state")
    return got.select(F.col("s_1").alias("a"), F.col("state").alias("b"), "n", r(F.col("p")).alias("p"))


_P = np.array([[(2 + (i + 2 * j) % 5) for j in range(5)] for i in range(5)], dtype=float)
_P = _P / _P.sum(axis=1, keepdims=True)
_P2 = np.array([[[(1 + (i + 3 * j + 2 * k) % 6) for k in range(5)] for j in range(5)] for i in range(5)], dtype=float)
_P2 = _P2 / _P2.sum(axis=-1, keepdims=True)


@register(
    "markov_logp",
    f"""WITH {_STATES}, p AS (SELECT user_id, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, state AS b FROM states), w AS (SELECT i, j, (2 + (i + 2 * j) % 5) AS w FROM range(0, 5) r(i), range(0, 5) s(j)),
    t AS (SELECT i, j, w::DOUBLE / sum(w) OVER (PARTITION BY i) AS p FROM w)
    SELECT user_id, round(sum(CASE WHEN a IS NULL THEN ln(0.2::DOUBLE) ELSE ln(t.p) END), 4) AS logp FROM p LEFT JOIN t ON a = i AND b = j GROUP BY user_id""",
)
def markov_logp(spark, sf_dir):
    got = markov.chain_logp(states(spark, sf_dir), "user_id", ["ts", "event_id"], "state", p=_P)
    return got.select("user_id", r(F.col("logp"), 4).alias("logp"))


@register(
    "markov_logp_lag2",
    f"""WITH {_STATES}, p AS (SELECT user_id, lag(state, 2) OVER w AS a, lag(state) OVER w AS b, state AS c FROM states WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    w AS (SELECT i, j, k, 1 + (i + 3 * j + 2 * k) % 6 AS w FROM range(0, 5) r(i), range(0, 5) s(j), range(0, 5) u(k)), t AS (SELECT i, j, k, w::DOUBLE / sum(w) OVER (PARTITION BY i, j) AS p FROM w)
    SELECT user_id, round(sum(CASE WHEN a IS NULL THEN ln(0.2::DOUBLE) ELSE ln(t.p) END), 4) AS logp FROM p LEFT JOIN t ON a = i AND b = j AND c = k GROUP BY user_id""",
)
def markov_logp_lag2(spark, sf_dir):
    got = markov.chain_logp(states(spark, sf_dir), "user_id", ["ts", "event_id"], "state", p=_P2, n_lags=2)
    return got.select("user_id", r(F.col("logp"), 4).alias("logp"))


@register(
    "markov_time_varying_logp",
    f"""WITH {_STATES}, p AS (SELECT user_id, row_number() OVER w - 2 AS t, lag(state) OVER w AS a, state AS b FROM states WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    w AS (SELECT i, j, (2 + (i + 2 * j) % 5) AS w FROM range(0, 5) r(i), range(0, 5) s(j)), t AS (SELECT i, j, w::DOUBLE / sum(w) OVER (PARTITION BY i) AS p FROM w)
    SELECT user_id, round(sum(CASE WHEN a IS NULL THEN ln(0.2::DOUBLE) ELSE ln(CASE WHEN p.t >= 9 THEN t.p ELSE (1 - (p.t + 1) / 10.0::DOUBLE) * 0.2::DOUBLE + (p.t + 1) / 10.0::DOUBLE * t.p END) END), 4) AS logp
    FROM p LEFT JOIN t ON a = i AND b = j GROUP BY user_id""",
)
def markov_time_varying_logp(spark, sf_dir):
    steps = np.stack([(1 - (t + 1) / 10) * 0.2 + (t + 1) / 10 * _P for t in range(10)])
    got = markov.chain_logp(states(spark, sf_dir), "user_id", ["ts", "event_id"], "state", p=steps, time_varying=True)
    return got.select("user_id", r(F.col("logp"), 4).alias("logp"))


@register("markov_simulate")
def markov_simulate(spark, sf_dir):
    """As many chains as there are users, by the shares with which their events follow one another."""
    rows = states(spark, sf_dir)
    counts = np.ones((len(EVENT), len(EVENT)))  # one of each, so that every state goes on
    for row in markov.transition_counts(rows, "user_id", ["ts", "event_id"], "state").collect():  # a row for each pair of states
        counts[row["s_1"], row["state"]] += row["n"]
    p = counts / counts.sum(axis=1, keepdims=True)
    return markov.simulate(spark, rows.select("user_id").distinct().count(), 50, p, counts.sum(axis=1) / counts.sum(), seed=4)


@register("markov_gibbs_step")
def markov_gibbs_step(spark, sf_dir):
    rows = states(spark, sf_dir).select("user_id", "event_id", "state")
    return markov.gibbs_step(rows, "user_id", "event_id", "state", _P, proposal="proportional", seed=5)


# --- marginals ---------------------------------------------------------------------------------------------------


@register(
    "mixture_marginal_logp",
    """SELECT l_returnflag, round(sum(ln(0.3::DOUBLE * exp(-0.5::DOUBLE * ((l_quantity - 10) / 8) ** 2) / (8 * sqrt(2 * pi())) + 0.7::DOUBLE * exp(-0.5::DOUBLE * ((l_quantity - 30) / 8) ** 2) / (8 * sqrt(2 * pi())))), 4) AS logp FROM lineitem GROUP BY l_returnflag""",
)
def mixture_marginal_logp(spark, sf_dir):
    means = [10.0, 30.0]
    logp = marginal.mixture_logp([0.3, 0.7], lambda v: normal_logp(F.col("l_quantity"), means[v], 8.0))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r(F.sum(logp), 4).alias("logp"))


@register(
    "mixture_posterior_prob",
    """SELECT l_returnflag, round(avg(0.7::DOUBLE * exp(-0.5::DOUBLE * ((l_quantity - 30) / 8) ** 2) / (0.3::DOUBLE * exp(-0.5::DOUBLE * ((l_quantity - 10) / 8) ** 2) + 0.7::DOUBLE * exp(-0.5::DOUBLE * ((l_quantity - 30) / 8) ** 2))), 6) AS p FROM lineitem GROUP BY l_returnflag""",
)
def mixture_posterior_prob(spark, sf_dir):
    means = [10.0, 30.0]
    p = marginal.mixture_posterior([0.3, 0.7], lambda v: normal_logp(F.col("l_quantity"), means[v], 8.0))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r(F.avg(F.get(p, F.lit(1)))).alias("p"))


@register(
    "grouped_mixture_posterior",
    """WITH s AS (SELECT o_orderpriority, sum(-0.5::DOUBLE * ((o_totalprice / 1000 - 200) / 500) ** 2) AS a, sum(-0.5::DOUBLE * ((o_totalprice / 1000 - 210) / 500) ** 2) AS b, count(*) AS n FROM orders GROUP BY o_orderpriority)
    SELECT o_orderpriority, round(0 - n * (ln(500.0::DOUBLE) + 0.5::DOUBLE * ln(2 * pi())) + greatest(a, b) + ln(0.5::DOUBLE * exp(a - greatest(a, b)) + 0.5::DOUBLE * exp(b - greatest(a, b))), 3) AS logp, round(1 / (1 + exp(a - b)), 6) AS p FROM s""",
)
def grouped_mixture_posterior(spark, sf_dir):
    means = [200.0, 210.0]
    got = marginal.grouped_mixture_logp(table(spark, sf_dir, "orders"), ["o_orderpriority"], marginal.bernoulli(0.5), lambda v: normal_logp(F.col("o_totalprice") / 1000, means[v], 500.0))
    return got.select("o_orderpriority", r(F.col("logp"), 3).alias("logp"), r(F.get("posterior", F.lit(1))).alias("p"))


@register(
    "switch_point_posterior",
    """WITH d AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT DISTINCT y AS s FROM d), m AS (SELECT avg(n) AS mean FROM d),
    l AS (SELECT s, sum(n * ln(CASE WHEN y < s THEN 1.1::DOUBLE * mean ELSE 0.9::DOUBLE * mean END) - CASE WHEN y < s THEN 1.1::DOUBLE * mean ELSE 0.9::DOUBLE * mean END) AS l FROM d, k, m GROUP BY s), t AS (SELECT max(l) AS top FROM l)
    SELECT s::INT AS s, round(exp(l - top) / (SELECT sum(exp(l - top)) FROM l, t), 6) AS p FROM l, t""",
)
def switch_point_posterior(spark, sf_dir):
    """A change of rate between years, with the year of change summed over: yearly counts, then one aggregate."""
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    lo, hi, mean = years.agg(F.min("y"), F.max("y"), F.avg("n")).head()
    prior, domain = marginal.discrete_uniform(lo, hi)
    rate = lambda s: F.when(F.col("y") < s, 1.1 * mean).otherwise(0.9 * mean)
    got = marginal.grouped_mixture_logp(years.withColumn("one", F.lit(1)), ["one"], prior, lambda s: F.col("n") * F.log(rate(s)) - rate(s), domain)
    return got.select(F.posexplode("posterior").alias("i", "p")).select((F.col("i") + lo).cast("int").alias("s"), r(F.col("p")).alias("p"))


@register(
    "normal_normal_marginal",
    """SELECT l_returnflag, round(sum(-0.5::DOUBLE * (l_quantity - (5 + 2 * 10)) ** 2 / (36 + 4 * 9) - 0.5::DOUBLE * ln(2 * pi() * (36 + 4 * 9))), 4) AS logp FROM lineitem GROUP BY l_returnflag""",
)
def normal_normal_marginal(spark, sf_dir):
    logp = marginal.normal_normal_logp(F.col("l_quantity"), 10.0, 3.0, 6.0, 2.0, 5.0)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r(F.sum(logp), 4).alias("logp"))


@register(
    "normal_normal_conditional",
    """SELECT l_returnflag, round(avg((10 / 9.0::DOUBLE + 2 * (l_quantity - 5) / 36.0::DOUBLE) / (1 / 9.0::DOUBLE + 4 / 36.0::DOUBLE)), 6) AS mean, round(avg(sqrt(1 / (1 / 9.0::DOUBLE + 4 / 36.0::DOUBLE))), 6) AS sd FROM lineitem GROUP BY l_returnflag""",
)
def normal_normal_conditional(spark, sf_dir):
    mean, sd = marginal.normal_normal_conditional(F.col("l_quantity"), 10.0, 3.0, 6.0, 2.0, 5.0)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r(F.avg(mean)).alias("mean"), r(F.avg(sd)).alias("sd"))


@register(
    "normal_group_posterior",
    """SELECT c_mktsegment, count(*)::BIGINT AS n, round((4000 / 1000.0::DOUBLE ** 2 + sum(c_acctbal) / 3000.0::DOUBLE ** 2) / (1 / 1000.0::DOUBLE ** 2 + count(*) / 3000.0::DOUBLE ** 2), 5) AS mean, round(1 / sqrt(1 / 1000.0::DOUBLE ** 2 + count(*) / 3000.0::DOUBLE ** 2), 6) AS sd FROM customer GROUP BY c_mktsegment""",
)
def normal_group_posterior(spark, sf_dir):
    got = marginal.normal_group_posterior(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", 4000.0, 1000.0, 3000.0)
    return got.select("c_mktsegment", "n", r(F.col("mean"), 5).alias("mean"), r(F.col("sd")).alias("sd"))


_HMM = """e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, ln(value) AS y FROM events),
    b AS (SELECT user_id, t, exp(-0.5::DOUBLE * (y - 3) ** 2) / sqrt(2 * pi()) AS b0, exp(-0.5::DOUBLE * (y - 5) ** 2) / sqrt(2 * pi()) AS b1 FROM e),
    f AS (SELECT user_id, t, 0.6::DOUBLE * b0 / (0.6::DOUBLE * b0 + 0.4::DOUBLE * b1) AS a0, 0.4::DOUBLE * b1 / (0.6::DOUBLE * b0 + 0.4::DOUBLE * b1) AS a1, ln(0.6::DOUBLE * b0 + 0.4::DOUBLE * b1) AS l FROM b WHERE t = 1
      UNION ALL SELECT user_id, t, n0 / (n0 + n1), n1 / (n0 + n1), l + ln(n0 + n1) FROM (
        SELECT b.user_id, b.t, (a0 * 0.9::DOUBLE + a1 * 0.2::DOUBLE) * b0 AS n0, (a0 * 0.1::DOUBLE + a1 * 0.8::DOUBLE) * b1 AS n1, l FROM f JOIN b ON b.user_id = f.user_id AND b.t = f.t + 1))"""


@register("hmm_forward_logp", f"WITH RECURSIVE {_HMM} SELECT user_id, round(max_by(l, t), 4) AS logp FROM f GROUP BY user_id")
def hmm_forward_logp(spark, sf_dir):
    means = [3.0, 5.0]
    rows = log_values(spark, sf_dir)
    got = markov.hmm_logp(rows, "user_id", ["ts", "event_id"], "y", lambda v, j: normal_logp(v, means[j], 1.0), [[0.9, 0.1], [0.2, 0.8]], [0.6, 0.4])
    return got.select("user_id", r(F.col("logp"), 4).alias("logp"))


@register(
    "hmm_smoothed_prob",
    f"""WITH RECURSIVE {_HMM}, z AS (SELECT user_id, max(t) AS m FROM e GROUP BY user_id),
    g AS (SELECT f.user_id, t, a0 AS s0, a1 AS s1 FROM f JOIN z ON f.user_id = z.user_id AND t = m
      UNION ALL SELECT f.user_id, f.t, a0 * (0.9::DOUBLE * s0 / (a0 * 0.9::DOUBLE + a1 * 0.2::DOUBLE) + 0.1::DOUBLE * s1 / (a0 * 0.1::DOUBLE + a1 * 0.8::DOUBLE)), a1 * (0.2::DOUBLE * s0 / (a0 * 0.9::DOUBLE + a1 * 0.2::DOUBLE) + 0.8::DOUBLE * s1 / (a0 * 0.1::DOUBLE + a1 * 0.8::DOUBLE))
      FROM g JOIN f ON f.user_id = g.user_id AND f.t = g.t - 1)
    SELECT user_id, (t - 1)::INT AS t, round(s1, 6) AS prob FROM g""",
)
def hmm_smoothed_prob(spark, sf_dir):
    rows = log_values(spark, sf_dir)
    logs = lambda y: -0.5 * (y[:, None] - np.array([3.0, 5.0])) ** 2 - 0.5 * math.log(2 * math.pi)
    got = markov.hmm_smoothed(rows, "user_id", ["ts", "event_id"], "y", logs, [[0.9, 0.1], [0.2, 0.8]], [0.6, 0.4])
    return got.where("state = 1").select("user_id", "t", r(F.col("prob")).alias("prob"))


@register("hmm_path_draws")
def hmm_path_draws(spark, sf_dir):
    rows = log_values(spark, sf_dir)
    logs = lambda y: -0.5 * (y[:, None] - np.array([3.0, 5.0])) ** 2 - 0.5 * math.log(2 * math.pi)
    return markov.hmm_draws(rows, "user_id", ["ts", "event_id"], "y", logs, [[0.9, 0.1], [0.2, 0.8]], [0.6, 0.4], 3, seed=1)


@register(
    "windowed_events",
    """SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM events GROUP BY 1, 2""",
)
def windowed_events(spark, sf_dir):
    """Hourly statistics by event type; the same operator runs on a stream."""
    from ..streaming import online

    got = online.windowed(table(spark, sf_dir, "events"), "ts", "value", size="1 hour", keys=["event_type"])
    return got.select(F.col("window.start").alias("start"), "event_type", "n", r(F.col("mean")).alias("mean"), r(F.col("sd")).alias("sd"))


@register(
    "laplace_poisson_rate",
    """SELECT round(ln(sum(dx * exp(l - top))) + max(top), 4) AS logp FROM (SELECT *, max(l) OVER () AS top FROM (
      SELECT 0.0001::DOUBLE AS dx, n * avg_x * x - n * exp(x) - g - 0.5::DOUBLE * ((x - 2) / 2) ** 2 - ln(2 * sqrt(2 * pi())) AS l
      FROM (SELECT count(*) AS n, avg(p_size)::DOUBLE AS avg_x, sum(lgamma(p_size + 1.0::DOUBLE)) AS g FROM part), (SELECT 3.0::DOUBLE + i * 0.0001::DOUBLE AS x FROM range(0, 5000) r(i))))""",
)
def laplace_poisson_rate(spark, sf_dir):
    """A log rate integrated out by its mode and curvature; the oracle integrates on a grid. Their difference is of the order of 1 / rows."""
    logp, mode, precision = marginal.laplace_marginal(marginal.poisson_log_rate(table(spark, sf_dir, "part"), "p_size"), np.array([2.0]), np.array([[0.25]]))
    return spark.createDataFrame([(round(float(logp), 4),)], "logp double")


