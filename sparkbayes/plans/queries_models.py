"""Registered queries on models whose latents or likelihoods span rows, with DuckDB equivalents written out by hand."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import forecasting
from ..operators import inference as I
from ..operators import statespace as S
from ..operators import statespace_gradient as G
from . import marginal_tables as T
from . import model as M
from .queries_densities import r, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TIME = ["ts", "event_id"]


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def events(spark, sf_dir):
    """A value for each event, unknown for errors."""
    return table(spark, sf_dir, "events").select("user_id", *TIME, F.when(F.col("event_type") != "error", F.col("value")).alias("y"))


_EVENTS = "e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, CASE WHEN event_type <> 'error' THEN value END AS y FROM events)"


def _density(mu: float, sd: float) -> str:
    return f"coalesce(exp(-0.5::DOUBLE * ((y - {mu}) / {sd}) ** 2) / ({sd} * sqrt(2 * pi())), 1.0::DOUBLE)"


# --- hidden chains -------------------------------------------------------------------------------------------------------

#: Second order, two states; the first transition has a table of its own.
_TABLES = ((((0.7, 0.3), (0.4, 0.6)), ((0.5, 0.5), (0.1, 0.9))), (((0.8, 0.2), (0.35, 0.65)), ((0.6, 0.4), (0.15, 0.85))))
_CHAIN2 = M.Model(
    (
        M.rv("s", "MarkovChain", p=_TABLES, init=((0.6, 0.4), (0.3, 0.7)), n_lags=2, dims=("user_id",), order=("ts", "event_id")),
        M.rv("y", "Normal", mu=M.Pick("s", (120.0, 350.0)), sigma=90.0, observed="y", dims=("user_id", "ts", "event_id")),
    )
)


@register(
    "hidden_chain_logp",
    f"""WITH RECURSIVE {_EVENTS}, d AS (SELECT user_id, t, least(t, 4) AS phase, {_density(120.0, 90.0)} AS e0, {_density(350.0, 90.0)} AS e1 FROM e),
    p AS (FROM (VALUES (2, 0.3, 0.7, 0.3, 0.7, 0.3, 0.7, 0.3, 0.7), (3, 0.7, 0.3, 0.4, 0.6, 0.5, 0.5, 0.1, 0.9), (4, 0.8, 0.2, 0.35, 0.65, 0.6, 0.4, 0.15, 0.85)) v(phase, p000, p001, p010, p011, p100, p101, p110, p111)),
    f AS (SELECT user_id, t, 0.6::DOUBLE * e0 / (0.6::DOUBLE * e0 + 0.4::DOUBLE * e1) AS a00, 0.4::DOUBLE * e1 / (0.6::DOUBLE * e0 + 0.4::DOUBLE * e1) AS a01, 0.0::DOUBLE AS a10, 0.0::DOUBLE AS a11, ln(0.6::DOUBLE * e0 + 0.4::DOUBLE * e1) AS ll FROM d WHERE t = 1
      UNION ALL SELECT user_id, t, b00 / b, b01 / b, b10 / b, b11 / b, ll + ln(b) FROM (SELECT *, b00 + b01 + b10 + b11 AS b FROM (
        SELECT d.user_id, d.t, ll, (a00 * p000 + a10 * p100)::DOUBLE * e0 AS b00, (a00 * p001 + a10 * p101)::DOUBLE * e1 AS b01, (a01 * p010 + a11 * p110)::DOUBLE * e0 AS b10, (a01 * p011 + a11 * p111)::DOUBLE * e1 AS b11
        FROM f JOIN d ON d.user_id = f.user_id AND d.t = f.t + 1 JOIN p ON p.phase = d.phase)))
    SELECT user_id, round(max_by(ll, t), 5) AS logp FROM f GROUP BY user_id""",
)
def hidden_chain_logp(spark, sf_dir):
    """A chain of second order over each user's events, its first transition a special one, summed out of the model."""
    tree = M.marginalize(_CHAIN2, ["s"]).nodes[0]
    return T.tree_logp(tree, events(spark, sf_dir)).select("user_id", r(F.col("logp"), 5).alias("logp"))


_CHAIN1 = M.Model(
    (
        M.rv("s", "MarkovChain", p=(((0.5, 0.5), (0.2, 0.8)), ((0.9, 0.1), (0.25, 0.75))), init=(0.6, 0.4), dims=("user_id",), order=("ts", "event_id")),
        M.rv("y", "Normal", mu=M.Pick("s", (120.0, 350.0)), sigma=90.0, observed="y", dims=("user_id", "ts", "event_id")),
    )
)


@register(
    "hidden_chain_prob",
    f"""WITH RECURSIVE {_EVENTS}, d AS (SELECT user_id, t, {_density(120.0, 90.0)} AS e0, {_density(350.0, 90.0)} AS e1,
      CASE WHEN t = 2 THEN [0.5, 0.5, 0.2, 0.8] ELSE [0.9, 0.1, 0.25, 0.75] END::DOUBLE[] AS p FROM e),
    f AS (SELECT user_id, t, 0.6::DOUBLE * e0 / (0.6::DOUBLE * e0 + 0.4::DOUBLE * e1) AS a FROM d WHERE t = 1
      UNION ALL SELECT user_id, t, b0 / (b0 + b1) FROM (SELECT d.user_id, d.t, (a * p[1] + (1 - a) * p[3]) * e0 AS b0, (a * p[2] + (1 - a) * p[4]) * e1 AS b1 FROM f JOIN d ON d.user_id = f.user_id AND d.t = f.t + 1)),
    g AS (SELECT user_id, max(t) AS t, 0.5::DOUBLE AS b FROM d GROUP BY user_id
      UNION ALL SELECT user_id, t, b0 / (b0 + b1) FROM (SELECT g.user_id, g.t - 1 AS t, p[1] * e0 * b + p[2] * e1 * (1 - b) AS b0, p[3] * e0 * b + p[4] * e1 * (1 - b) AS b1 FROM g JOIN d ON d.user_id = g.user_id AND d.t = g.t WHERE g.t > 1))
    SELECT user_id, t - 1 AS t, round((1 - a) * (1 - b) / (a * b + (1 - a) * (1 - b)), 5) AS prob FROM f JOIN g USING (user_id, t)""",
)
def hidden_chain_prob(spark, sf_dir):
    """Probability of the second state at each event given all of its user's."""
    found = T.conditional_table(M.marginalize(_CHAIN1, ["s"]), events(spark, sf_dir), "s")
    return found.select("user_id", F.col("t").cast("long").alias("t"), r(F.get("prob", F.lit(1)), 5).alias("prob"))


# --- latents inside one another ---------------------------------------------------------------------------------------------

_NESTED = M.Model(
    (
        M.rv("z", "Bernoulli", p=0.4, dims=("l_orderkey",)),
        M.rv("o", "Categorical", p=(M.Pick("z", (0.9, 0.6)), M.Pick("z", (0.1, 0.4))), dims=("l_orderkey", "l_linenumber")),
        M.rv("y", "Normal", mu=M.Pick("z", (20.0, 30.0)), sigma=M.Pick("o", (8.0, 20.0)), observed="l_quantity", dims=("l_orderkey", "l_linenumber")),
    )
)


def _line(mu: float, q: float) -> str:
    return f"ln({1 - q} * exp(-0.5::DOUBLE * ((l_quantity - {mu}) / 8) ** 2) / (8 * sqrt(2 * pi())) + {q} * exp(-0.5::DOUBLE * ((l_quantity - {mu}) / 20) ** 2) / (20 * sqrt(2 * pi())))"


_ORDERS = f"o AS (SELECT l_orderkey, ln(0.6::DOUBLE) + sum({_line(20.0, 0.1)}) AS l0, ln(0.4::DOUBLE) + sum({_line(30.0, 0.4)}) AS l1 FROM lineitem GROUP BY l_orderkey)"


@register("nested_marginal_logp", f"WITH {_ORDERS} SELECT l_orderkey % 100 AS part, round(sum(greatest(l0, l1) + ln(1 + exp(-abs(l0 - l1)))), 3) AS logp FROM o GROUP BY 1")
def nested_marginal_logp(spark, sf_dir):
    """A kind of each order, and inside it whether each line is an outlier; named in either order."""
    tree = M.marginalize(_NESTED, ["z", "o"]).nodes[0]
    return T.tree_logp(tree, table(spark, sf_dir, "lineitem")).groupBy((F.col("l_orderkey") % 100).alias("part")).agg(r(F.sum("logp"), 3).alias("logp"))


@register("nested_marginal_prob", f"WITH {_ORDERS} SELECT l_orderkey, round(1 / (1 + exp(l0 - l1)), 5) AS prob FROM o")
def nested_marginal_prob(spark, sf_dir):
    found = T.conditional_table(M.marginalize(_NESTED, ["o", "z"]), table(spark, sf_dir, "lineitem"), "z")
    return found.select("l_orderkey", r(F.get("prob", F.lit(1)), 5).alias("prob"))


# --- state space -------------------------------------------------------------------------------------------------------------


def trend(h: float, q: float, s: float) -> S.StateSpace:
    return S.StateSpace(T=[[1.0, 1.0], [0.0, 1.0]], Z=[[1.0, 0.0]], R=np.eye(2), H=[[h]], Q=np.diag([q, s]), x0=[100.0, 0.0], P0=np.diag([10000.0, 100.0]))


def _trend_sql(grid: str) -> str:
    """Log likelihood of all users under each line (i, h, q, s) of a grid: a local linear trend, missing values left out."""
    return f"""{_EVENTS}, grid AS ({grid}), f AS (
    SELECT i, h, q, s, user_id, 0 AS t, 100.0::DOUBLE AS a, 0.0::DOUBLE AS b, 10000.0::DOUBLE AS p, 0.0::DOUBLE AS w, 100.0::DOUBLE AS v, 0.0::DOUBLE AS ll FROM (SELECT DISTINCT user_id FROM e), grid
    UNION ALL SELECT i, h, q, s, user_id, t, a1 + b1, b1, p1 + 2 * w1 + v1 + q, w1 + v1, v1 + s, ll FROM (
      SELECT i, h, q, s, e.user_id, e.t, a + p / (p + h) * coalesce(y - a, 0) AS a1, b + w / (p + h) * coalesce(y - a, 0) AS b1, p - CASE WHEN y IS NULL THEN 0 ELSE p * p / (p + h) END AS p1,
        w - CASE WHEN y IS NULL THEN 0 ELSE p * w / (p + h) END AS w1, v - CASE WHEN y IS NULL THEN 0 ELSE w * w / (p + h) END AS v1,
        ll + CASE WHEN y IS NULL THEN 0 ELSE -0.5::DOUBLE * (ln(2 * pi()) + ln(p + h) + (y - a) * (y - a) / (p + h)) END AS ll FROM f JOIN e ON e.user_id = f.user_id AND e.t = f.t + 1)),
    g AS (SELECT i, sum(ll) AS ll FROM (SELECT i, user_id, max_by(ll, t) AS ll FROM f GROUP BY i, user_id) GROUP BY i)"""


_LOGS = "7.0::DOUBLE AS h, 4.0::DOUBLE AS q, -1.0::DOUBLE AS s"


@register(
    "statespace_gradient",
    f"""WITH RECURSIVE {_trend_sql(f"SELECT i, exp(h + CASE i WHEN 1 THEN 1e-3 WHEN 2 THEN -1e-3 ELSE 0 END::DOUBLE) AS h, exp(q + CASE i WHEN 3 THEN 1e-3 WHEN 4 THEN -1e-3 ELSE 0 END::DOUBLE) AS q, exp(s + CASE i WHEN 5 THEN 1e-3 WHEN 6 THEN -1e-3 ELSE 0 END::DOUBLE) AS s FROM range(7) t(i), (SELECT {_LOGS})")}
    SELECT what, round(value, 2) AS value FROM (SELECT unnest(['loglike', 'h', 'q', 's']) AS what, unnest([v[1], (v[2] - v[3]) / 2e-3, (v[4] - v[5]) / 2e-3, (v[6] - v[7]) / 2e-3]) AS value FROM (SELECT list(ll ORDER BY i) AS v FROM g))""",
)
def statespace_gradient(spark, sf_dir):
    """Log likelihood of a local linear trend in each user's events, and its slopes in the logs of the three variances."""
    target = G.SeriesTarget(G.gathered(events(spark, sf_dir), "user_id", TIME, ["y"]), lambda p: trend(math.exp(p["h"]), math.exp(p["q"]), math.exp(p["s"])), ["h", "q", "s"])
    value, slopes = target.sums([np.array([7.0, 4.0, -1.0])])[0]
    return spark.createDataFrame([(k, round(float(v), 2)) for k, v in zip(("loglike", "h", "q", "s"), [value, *slopes], strict=True)], "what string, value double")


def _level_sql(k: int, before: str, step: float) -> str:
    """One round of a search: all points of 11 x 11 around the last best one, with their log posteriors."""
    return f"""c{k} AS (SELECT row_number() OVER () AS i, h + {step}::DOUBLE * x AS h, q + {step}::DOUBLE * y AS q FROM ({before}), range(-5, 6) a(x), range(-5, 6) b(y)),
    f{k} AS (SELECT i, exp(h) AS h, exp(q) AS q, user_id, 0 AS t, 100.0::DOUBLE AS a, 10000.0::DOUBLE AS p, 0.0::DOUBLE AS ll FROM c{k}, (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT i, h, q, e.user_id, e.t, a + p / (p + h) * coalesce(y - a, 0), CASE WHEN y IS NULL THEN p ELSE p * h / (p + h) END + q,
        ll + CASE WHEN y IS NULL THEN 0 ELSE -0.5::DOUBLE * (ln(2 * pi()) + ln(p + h) + (y - a) * (y - a) / (p + h)) END FROM f{k} f JOIN e ON e.user_id = f.user_id AND e.t = f.t + 1),
    g{k} AS (SELECT c.h, c.q, s.ll - 0.5::DOUBLE * ((c.h - 9) / 2) ** 2 - 0.5::DOUBLE * ((c.q - 5) / 2) ** 2 - 2 * ln(2.0::DOUBLE) - ln(2 * pi()) AS lp
      FROM (SELECT i, sum(ll) AS ll FROM (SELECT i, user_id, max_by(ll, t) AS ll FROM f{k} GROUP BY i, user_id) GROUP BY i) s JOIN c{k} c USING (i) ORDER BY lp DESC LIMIT 1)"""


@register(
    "statespace_map",
    f"""WITH RECURSIVE {_EVENTS}, {_level_sql(1, 'SELECT 8.0::DOUBLE AS h, 3.0::DOUBLE AS q', 2.0)}, {_level_sql(2, 'SELECT h, q FROM g1', 0.5)}, {_level_sql(3, 'SELECT h, q FROM g2', 0.12)}, {_level_sql(4, 'SELECT h, q FROM g3', 0.03)}, {_level_sql(5, 'SELECT h, q FROM g4', 0.006)}
    SELECT round(lp, 2) AS log_posterior FROM g5""",
)
def statespace_map(spark, sf_dir):
    """The mode of both log variances of a level model of all users' events; as SQL, by a grid around the best point so far that is made finer four times."""
    model = M.Model((M.rv("h", "Normal", mu=9.0, sigma=2.0), M.rv("q", "Normal", mu=5.0, sigma=2.0)))
    build = lambda p: S.StateSpace(T=[[1.0]], Z=[[1.0]], R=[[1.0]], H=[[math.exp(p["h"])]], Q=[[math.exp(p["q"])]], x0=[100.0], P0=[[10000.0]])
    model = M.with_statespace(model, "y", build, ["h", "q"], series="user_id", time=TIME, observed=["y"])
    _, seen, _ = I.find_map(M.statespace_target(model, events(spark, sf_dir)), np.array([9.0, 5.0]))
    return spark.createDataFrame([(round(float(seen[0]), 2),)], "log_posterior double")


@register(
    "trend_smoother",
    f"""WITH RECURSIVE {_EVENTS}, f AS (
      SELECT user_id, 0 AS t, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS p, 0.0::DOUBLE AS w, 0.0::DOUBLE AS v, 100.0::DOUBLE AS a2, 0.0::DOUBLE AS b2, 10000.0::DOUBLE AS p2, 0.0::DOUBLE AS w2, 100.0::DOUBLE AS v2 FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT user_id, t, a, b, p, w, v, a + b, b, p + 2 * w + v + 100, w + v, v + 1 FROM (
        SELECT e.user_id, e.t, a2 + p2 / (p2 + 2000) * coalesce(y - a2, 0) AS a, b2 + w2 / (p2 + 2000) * coalesce(y - a2, 0) AS b, p2 - CASE WHEN y IS NULL THEN 0 ELSE p2 * p2 / (p2 + 2000) END AS p,
          w2 - CASE WHEN y IS NULL THEN 0 ELSE p2 * w2 / (p2 + 2000) END AS w, v2 - CASE WHEN y IS NULL THEN 0 ELSE w2 * w2 / (p2 + 2000) END AS v FROM f JOIN e ON e.user_id = f.user_id AND e.t = f.t + 1)),
    k AS (SELECT *, ((p + w) * v2 - w * w2) / n AS g11, (w * p2 - (p + w) * w2) / n AS g12, ((w + v) * v2 - v * w2) / n AS g21, (v * p2 - (w + v) * w2) / n AS g22 FROM (SELECT *, p2 * v2 - w2 * w2 AS n FROM f WHERE t > 0)),
    s AS (SELECT user_id, t, a AS sa, b AS sb, p AS sp, w AS sw, v AS sv FROM k WHERE (user_id, t) IN (SELECT user_id, max(t) FROM e GROUP BY user_id)
      UNION ALL SELECT k.user_id, k.t, a + g11 * (sa - a2) + g12 * (sb - b2), b + g21 * (sa - a2) + g22 * (sb - b2), p + g11 * g11 * (sp - p2) + 2 * g11 * g12 * (sw - w2) + g12 * g12 * (sv - v2),
        w + g11 * g21 * (sp - p2) + (g11 * g22 + g12 * g21) * (sw - w2) + g12 * g22 * (sv - v2), v + g21 * g21 * (sp - p2) + 2 * g21 * g22 * (sw - w2) + g22 * g22 * (sv - v2) FROM s JOIN k ON k.user_id = s.user_id AND k.t = s.t - 1)
    SELECT user_id, (s.t - 1)::INT AS t, round(k.a, 4) AS filtered, round(k.v, 4) AS filtered_slope_var, round(sa, 4) AS level, round(sb, 4) AS slope, round(sp, 4) AS level_var, round(sw, 4) AS covariance FROM s JOIN k USING (user_id, t)""",
)
def trend_smoother(spark, sf_dir):
    """Filtered and smoothed states of a local linear trend, two states each."""
    got = S.filter_series(events(spark, sf_dir), trend(2000.0, 100.0, 1.0), "user_id", TIME, ["y"], smoothed=True)
    at = lambda c, i: r(F.get(c, F.lit(i)), 4)
    return got.select("user_id", "t", at("filtered", 0).alias("filtered"), at("filtered_cov", 3).alias("filtered_slope_var"), at("smoothed", 0).alias("level"), at("smoothed", 1).alias("slope"), at("smoothed_cov", 0).alias("level_var"), at("smoothed_cov", 1).alias("covariance"))


@register(
    "forecast_scenario",
    f"""WITH RECURSIVE d AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS t, value AS y, (event_type = 'purchase')::INT::DOUBLE AS x FROM events),
    f AS (SELECT user_id, 0 AS t, 100.0::DOUBLE AS a, 0.0::DOUBLE AS b, 10000.0::DOUBLE AS p, 0.0::DOUBLE AS w, 900.0::DOUBLE AS v FROM (SELECT DISTINCT user_id FROM d)
      UNION ALL SELECT user_id, t, a + k1 * e, b + k2 * e, p - k1 * k1 * n + 100, w - k1 * k2 * n, v - k2 * k2 * n FROM (
        SELECT *, (p + w * x) / n AS k1, (w + v * x) / n AS k2 FROM (SELECT d.user_id, d.t, a, b, p, w, v, x, y - a - b * x AS e, p + 2 * w * x + v * x * x + 2000 AS n FROM f JOIN d ON d.user_id = f.user_id AND d.t = f.t + 1))),
    z AS (SELECT user_id, max_by(f, t) AS f FROM f GROUP BY user_id)
    SELECT user_id, step::INT AS step, round(f.a + f.b * x, 4) AS mean, round(f.p + 100 * (step - 1) + 2 * f.w * x + f.v * x * x + 2000, 4) AS var FROM z, (VALUES (1, 1.0::DOUBLE), (2, 0.0::DOUBLE), (3, 0.5::DOUBLE)) s(step, x)""",
)
def forecast_scenario(spark, sf_dir):
    """Three values after each user's last event if the first is a purchase, the second isn't and the third is one in two cases."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("y"), (F.col("event_type") == "purchase").cast("double").alias("x"))
    ahead = spark.createDataFrame([(1.0, 1), (0.0, 2), (0.5, 3)], "x double, k long").select("x", (F.col("k") + (1 << 60)).alias("event_id"))

    def build(_, X):
        return S.StateSpace(T=np.eye(2), Z=np.stack([np.ones(len(X)), X[:, 0]], axis=1)[:, None, :], R=[[1.0], [0.0]], H=[[2000.0]], Q=[[100.0]], x0=[100.0, 0.0], P0=np.diag([10000.0, 900.0]))

    got = forecasting.forecasts(rows, build, "user_id", "event_id", ["y"], regressors=["x"], scenario=ahead)
    return got.select("user_id", "step", r(F.get("mean", F.lit(0)), 4).alias("mean"), r(F.get("cov", F.lit(0)), 4).alias("var"))


# --- modes within bounds ------------------------------------------------------------------------------------------------------

_BOUNDED = """WITH RECURSIVE bins AS (SELECT (l_quantity - 25) / 15.0::DOUBLE AS x, sum((l_returnflag = 'N')::INT)::DOUBLE AS k, count(*)::DOUBLE AS n FROM lineitem GROUP BY l_quantity),
    f AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
      UNION ALL SELECT i + 1, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
        SELECT i, any_value(a) AS a, any_value(b) AS b, sum(k - n * p) - any_value(a) / 4 AS ga, sum(x * (k - n * p)) - any_value(b) / 4 AS gb,
          sum(n * p * (1 - p)) + 0.25::DOUBLE AS haa, sum(x * n * p * (1 - p)) AS hab, sum(x * x * n * p * (1 - p)) + 0.25::DOUBLE AS hbb
        FROM (SELECT i, a, b, x, k, n, 1 / (1 + exp(-a - b * x)) AS p FROM f, bins WHERE i < 15) GROUP BY i)),
    c AS (SELECT 0 AS i, 0.0::DOUBLE AS a, (SELECT greatest(b, 0.1) FROM f WHERE i = 15) AS b
      UNION ALL SELECT i + 1, a + ga / haa, b FROM (
        SELECT i, any_value(a) AS a, any_value(b) AS b, sum(k - n * p) - any_value(a) / 4 AS ga, sum(n * p * (1 - p)) + 0.25::DOUBLE AS haa
        FROM (SELECT i, a, b, x, k, n, 1 / (1 + exp(-a - b * x)) AS p FROM c, bins WHERE i < 15) GROUP BY i))
    SELECT 'a' AS param, round(a, 5) AS value, round(b, 5) AS slope FROM c WHERE i = 15 UNION ALL SELECT 'free a', round(a, 5), round(b, 5) FROM f WHERE i = 15"""


@register("logistic_bounded", _BOUNDED)
def logistic_bounded(spark, sf_dir):
    """Two logistic coefficients, the slope at least 0.1, by projected Newton steps; and both free, by Hessian-vector products."""
    df = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "N").cast("int").alias("y"), ((F.col("l_quantity") - 25) / 15).alias("x"))
    target = I.table_target(df, E.bernoulli_logit(E.data("y"), E.param("a") + E.param("b") * E.data("x")), E.normal(E.param("a"), 0.0, 2.0) + E.normal(E.param("b"), 0.0, 2.0), ["a", "b"])
    bound, _, _ = I.find_map(target, np.zeros(2), bounds=[(None, None), (0.1, None)], tol=1e-10)
    free, _, _ = I.find_map(target, np.zeros(2), method="trust-ncg", tol=1e-10)
    return spark.createDataFrame([(k, round(float(a), 5), round(float(b), 5)) for k, (a, b) in (("a", bound), ("free a", free))], "param string, value double, slope double")


# --- batches -------------------------------------------------------------------------------------------------------------------


@register(
    "minibatch_content",
    """WITH t AS (SELECT count(*) AS n, avg(o_orderkey) AS m, stddev_pop(o_orderkey) AS s FROM orders)
    SELECT n // 256 AS batches, 256 * (n // 256) AS n_rows, 256 * (n // 256) AS n_keys, 0::BIGINT AS unknown, 0::BIGINT AS changed, true AS mixed, true AS centred FROM t""",
)
def minibatch_content(spark, sf_dir):
    """Shuffled batches of orders: every row once and as it is in the table, each batch a fair sample of all."""
    from ..sources import loader

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    got = loader.batches(orders, 256, seed=1, epoch=1)
    joined = got.join(orders.select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit(1).alias("there")), "o_orderkey", "left")
    counts = joined.agg(F.countDistinct("batch").alias("batches"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_orderkey").alias("n_keys"), F.count_if(F.col("there").isNull()).alias("unknown"), F.count_if(~F.col("o_totalprice").eqNullSafe(F.col("price"))).alias("changed"))
    means = got.groupBy("batch").agg(F.avg("o_orderkey").alias("m")).agg(F.stddev("m").alias("spread"), F.avg("m").alias("centre"))
    whole = orders.agg(F.stddev_pop("o_orderkey").alias("s"), F.avg("o_orderkey").alias("m"))
    fair = means.crossJoin(whole).select((F.col("spread") * 16 / F.col("s")).between(0.4, 1.8).alias("mixed"), (F.abs(F.col("centre") - F.col("m")) < F.col("s") / 10).alias("centred"))  # one row each
    return counts.crossJoin(fair)
