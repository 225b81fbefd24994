"""Registered state-space queries: one series per user of the events table, and one of daily orders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import statespace as S
from . import statespace_models as M
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


def events(spark, sf_dir, missing: bool = False) -> DataFrame:
    y = F.when(F.col("event_type") != "error", F.col("value")) if missing else F.col("value")
    return table(spark, sf_dir, "events").select("user_id", *TIME, y.alias("y"))


def _rows(y: str = "value") -> str:
    return f"e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, {y} AS y FROM events)"


def _level(y: str = "value", phi: str = "1.0", h: str = "2000.0", q: str = "100.0") -> str:
    """Recursive filter: a, p before each observation; fa, fp after it."""
    step = """SELECT e.user_id, e.t, {a} AS a, {p} AS p, CASE WHEN y IS NULL THEN {a} ELSE {a} + {p} / ({p} + NOISE) * (y - {a}) END AS fa, CASE WHEN y IS NULL THEN {p} ELSE {p} * NOISE / ({p} + NOISE) END AS fp,
        {ll} + CASE WHEN y IS NULL THEN 0.0 ELSE -0.5::DOUBLE * (ln(2 * pi()) + ln({p} + NOISE) + (y - {a}) * (y - {a}) / ({p} + NOISE)) END AS ll"""
    first = step.format(a="100.0::DOUBLE", p="10000.0::DOUBLE", ll="0.0::DOUBLE").replace("NOISE", f"{h}::DOUBLE")
    then = step.format(a=f"({phi}::DOUBLE * f.fa)", p=f"({phi}::DOUBLE * {phi}::DOUBLE * f.fp + {q}::DOUBLE)", ll="f.ll").replace("NOISE", f"{h}::DOUBLE")
    return f"{_rows(y)}, f AS ({first} FROM e WHERE t = 1 UNION ALL {then} FROM f JOIN e ON e.user_id = f.user_id AND e.t = f.t + 1)"


@register("kalman_local_level", f"WITH RECURSIVE {_level()} SELECT user_id, round(max_by(fa, t), 4) AS level, round(max_by(ll, t), 4) AS loglike FROM f GROUP BY user_id")
def kalman_local_level(spark, sf_dir):
    got = S.series_array(events(spark, sf_dir), "user_id", TIME, "y").select("user_id", S.local_level_fold(F.col("ys"), 100.0, 10000.0, 2000.0, 100.0).alias("f"))
    return got.select("user_id", r(F.col("f.a"), 4).alias("level"), r(F.col("f.ll"), 4).alias("loglike"))


_MISSING = "CASE WHEN event_type <> 'error' THEN value END"


@register("kalman_missing", f"WITH RECURSIVE {_level(_MISSING)} SELECT user_id, round(max_by(fa, t), 4) AS level, round(max_by(ll, t), 4) AS loglike FROM f GROUP BY user_id")
def kalman_missing(spark, sf_dir):
    got = S.series_array(events(spark, sf_dir, True), "user_id", TIME, "y").select("user_id", S.local_level_fold(F.col("ys"), 100.0, 10000.0, 2000.0, 100.0).alias("f"))
    return got.select("user_id", r(F.col("f.a"), 4).alias("level"), r(F.col("f.ll"), 4).alias("loglike"))


@register("ar1_kalman", f"WITH RECURSIVE {_level(phi='0.8', q='900.0')} SELECT user_id, round(0.8::DOUBLE * max_by(fa, t), 4) AS next, round(max_by(ll, t), 4) AS loglike FROM f GROUP BY user_id")
def ar1_kalman(spark, sf_dir):
    got = S.series_array(events(spark, sf_dir), "user_id", TIME, "y").select("user_id", S.local_level_fold(F.col("ys"), 100.0, 10000.0, 2000.0, 900.0, 0.8).alias("f"))
    return got.select("user_id", r(F.col("f.a"), 4).alias("next"), r(F.col("f.ll"), 4).alias("loglike"))


def level_model(h: float = 2000.0, q: float = 100.0) -> S.StateSpace:
    return S.StateSpace(T=[[1.0]], Z=[[1.0]], R=[[1.0]], H=[[h]], Q=[[q]], x0=[100.0], P0=[[10000.0]])


@register("kalman_filter_outputs", f"WITH RECURSIVE {_level(_MISSING)} SELECT user_id, (t - 1)::INT AS t, round(fa, 4) AS filtered, round(fp, 4) AS filtered_var, round(a, 4) AS predicted, round(p + 2000, 4) AS observed_var FROM f")
def kalman_filter_outputs(spark, sf_dir):
    got = S.filter_series(events(spark, sf_dir, True), level_model(), "user_id", TIME, ["y"])
    one = lambda c: r(F.get(c, F.lit(0)), 4)
    return got.select("user_id", "t", one("filtered").alias("filtered"), one("filtered_cov").alias("filtered_var"), one("predicted").alias("predicted"), one("observed_cov").alias("observed_var"))


@register(
    "kalman_smoother",
    f"""WITH RECURSIVE {_level()}, z AS (SELECT user_id, max(t) AS m FROM e GROUP BY user_id),
    g AS (SELECT f.user_id, f.t, fa AS s, fp AS sp FROM f JOIN z ON f.user_id = z.user_id AND f.t = m
      UNION ALL SELECT f.user_id, f.t, f.fa + f.fp / (f.fp + 100) * (g.s - f.fa), f.fp + (f.fp / (f.fp + 100)) ** 2 * (g.sp - f.fp - 100) FROM g JOIN f ON f.user_id = g.user_id AND f.t = g.t - 1)
    SELECT user_id, (t - 1)::INT AS t, round(s, 4) AS mean, round(sp, 4) AS var FROM g""",
)
def kalman_smoother(spark, sf_dir):
    got = S.filter_series(events(spark, sf_dir), level_model(), "user_id", TIME, ["y"], smoothed=True)
    return got.select("user_id", "t", r(F.get("smoothed", F.lit(0)), 4).alias("mean"), r(F.get("smoothed_cov", F.lit(0)), 4).alias("var"))


@register(
    "kalman_forecast",
    f"""WITH RECURSIVE {_level()}, z AS (SELECT user_id, max_by(fa, t) AS a, max_by(fp, t) AS p FROM f GROUP BY user_id)
    SELECT user_id, s::INT AS step, round(a, 4) AS mean, round(p + 100 * s + 2000, 4) AS var FROM z, range(1, 6) q(s)""",
)
def kalman_forecast(spark, sf_dir):
    got = S.forecast_series(events(spark, sf_dir), level_model(), "user_id", TIME, ["y"], 5)
    return got.select("user_id", "step", r(F.get("mean", F.lit(0)), 4).alias("mean"), r(F.get("cov", F.lit(0)), 4).alias("var"))


_TREND = f"""WITH RECURSIVE {_rows()}, f AS (
    SELECT user_id, 0 AS t, 100.0::DOUBLE AS a, 0.0::DOUBLE AS b, 10000.0::DOUBLE AS p, 0.0::DOUBLE AS q, 100.0::DOUBLE AS s, 0.0::DOUBLE AS ll FROM (SELECT DISTINCT user_id FROM e)
    UNION ALL SELECT user_id, t, a1 + b1, b1, p1 + 2 * q1 + s1 + 100, q1 + s1, s1 + 1, ll FROM (
      SELECT e.user_id, e.t, a + p / (p + 2000) * (y - a) AS a1, b + q / (p + 2000) * (y - a) AS b1, p - p * p / (p + 2000) AS p1, q - p * q / (p + 2000) AS q1, s - q * q / (p + 2000) AS s1,
        ll - 0.5::DOUBLE * (ln(2 * pi()) + ln(p + 2000) + (y - a) * (y - a) / (p + 2000)) AS ll FROM f JOIN e ON e.user_id = f.user_id AND e.t = f.t + 1))
    SELECT user_id, round(max_by(ll, t), 3) AS loglike, '{{kind}}' AS kind FROM f GROUP BY user_id"""


def trend_model() -> S.StateSpace:
    return S.StateSpace(T=[[1.0, 1.0], [0.0, 1.0]], Z=[[1.0, 0.0]], R=np.eye(2), H=[[2000.0]], Q=np.diag([100.0, 1.0]), x0=[100.0, 0.0], P0=np.diag([10000.0, 100.0]))


@register("kalman_filter_kinds", " UNION ALL ".join(f"({_TREND.format(kind=k)})" for k in ("cholesky", "standard", "univariate")))
def kalman_filter_kinds(spark, sf_dir):
    """A local linear trend by three filters, side by side on each series."""
    got = S.loglikes(events(spark, sf_dir), trend_model(), "user_id", TIME, ["y"], ["cholesky", "standard", "univariate"])
    return got.select("user_id", r(F.col("loglike"), 3).alias("loglike"), "kind")


@register("kalman_convergent", f"SELECT user_id, loglike FROM ({_TREND.format(kind='convergent')})")
def kalman_convergent(spark, sf_dir):
    """The local linear trend again, by the filter that keeps its gain once it has settled."""
    got = S.loglike(events(spark, sf_dir), trend_model(), "user_id", TIME, ["y"], kind="convergent")
    return got.select("user_id", r(F.col("loglike"), 3).alias("loglike"))


@register(
    "ets_simple",
    f"""WITH RECURSIVE {_rows()}, f AS (SELECT user_id, t, y::DOUBLE AS level, 0.0::DOUBLE AS sse FROM e WHERE t = 1
      UNION ALL SELECT e.user_id, e.t, level + 0.3::DOUBLE * (y - level), sse + (y - level) * (y - level) FROM f JOIN e ON e.user_id = f.user_id AND e.t = f.t + 1)
    SELECT user_id, round(max_by(level, t), 4) AS level, round(max_by(sse, t), 2) AS sse FROM f GROUP BY user_id""",
)
def ets_simple(spark, sf_dir):
    got = S.series_array(events(spark, sf_dir), "user_id", TIME, "y").select("user_id", S.exponential_smoothing_fold(F.col("ys"), 0.3).alias("f"))
    return got.select("user_id", r(F.col("f.level"), 4).alias("level"), r(F.col("f.sse"), 2).alias("sse"))


@register(
    "ets_holt_damped",
    f"""WITH RECURSIVE {_rows()}, f AS (SELECT user_id, t, y::DOUBLE AS level, 0.0::DOUBLE AS trend FROM e WHERE t = 1
      UNION ALL SELECT e.user_id, e.t, 0.3::DOUBLE * y + 0.7::DOUBLE * (level + 0.9::DOUBLE * trend), 0.9::DOUBLE * trend + 0.03::DOUBLE * (y - level - 0.9::DOUBLE * trend) FROM f JOIN e ON e.user_id = f.user_id AND e.t = f.t + 1)
    SELECT user_id, round(max_by(level, t), 4) AS level, round(max_by(trend, t), 5) AS trend FROM f GROUP BY user_id""",
)
def ets_holt_damped(spark, sf_dir):
    got = S.series_array(events(spark, sf_dir), "user_id", TIME, "y").select("user_id", S.exponential_smoothing_fold(F.col("ys"), 0.3, 0.1, 0.9).alias("f"))
    return got.select("user_id", r(F.col("f.level"), 4).alias("level"), r(F.col("f.trend"), 5).alias("trend"))


@register(
    "impulse_response",
    """WITH v AS (SELECT event_type, value AS y, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS x FROM events), p AS (SELECT event_type, regr_slope(y, x) AS phi FROM v GROUP BY event_type)
    SELECT event_type, i::INT AS step, round(2 * pow(phi, i), 6) AS response FROM p, range(0, 20) r(i)""",
)
def impulse_response(spark, sf_dir):
    """What becomes of a shock of two in each type of event, if a value follows the user's last one of that type."""
    lag = F.lag("value").over(Window.partitionBy("user_id", "event_type").orderBy(*TIME))
    fits = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("y"), lag.alias("x")).groupBy("event_type").agg(F.regr_slope("y", "x").alias("phi"))

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for kind, phi in zip(b["event_type"], b["phi"], strict=True):
                model = S.StateSpace(T=[[phi]], Z=[[1.0]], R=[[1.0]], H=[[0.0]], Q=[[1.0]], x0=[0.0], P0=[[1.0]])
                out += [(kind, i, float(x)) for i, x in enumerate(S.impulse_response(model, 20, shock_size=[2.0])[:, 0])]
            yield pd.DataFrame(out, columns=["event_type", "step", "response"])

    got = fits.mapInPandas(run, "event_type string, step int, response double")
    return got.select("event_type", "step", r(F.col("response")).alias("response"))


def monthly(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return rows.withColumn("series", F.lit("orders"))


@register("structural_components")
def structural_components(spark, sf_dir):
    """Trend and season of monthly orders: smoothed components per month."""
    model = (M.level_trend(2, [5.0, 0.5]) + M.time_seasonality(12, 1.0) + M.measurement_error(20.0)).build()

    def kernel(y):
        import pandas as pd

        a, _ = S.smooth(model, S.kalman(model, y))
        parts = M.extract(model, a)
        return pd.DataFrame({"t": range(len(y)), **{k: v[:, 0] for k, v in parts.items()}})

    return S.per_series(monthly(spark, sf_dir), "series", ["m"], ["y"], kernel, "t int, trend double, season double")


def _filled(m: int, n: int, entries: dict[tuple[int, int], float]) -> np.ndarray:
    out = np.zeros((m, n))
    for at, v in entries.items():
        out[at] = v
    return out


def _turned(*angles: float, damp: float = 1.0) -> dict[tuple[int, int], float]:
    """Entries of rotations of the states 1, 2 and 3, 4 and so on."""
    out = {}
    for j, a in enumerate(angles):
        i = 1 + 2 * j
        out |= {(i, i): damp * np.cos(a), (i, i + 1): damp * np.sin(a), (i + 1, i): -damp * np.sin(a), (i + 1, i + 1): damp * np.cos(a)}
    return out


_VAGUE = 1e6
_SHARES = np.array([1 - 0.3 - 0.7 * 0.2, 0.3, 0.3 * 0.1, 0.7 * 0.2, *[0.0] * 11])  # what an innovation adds to itself, level, trend and season
_V22 = 1 / (1 - 0.3**2)  # moments of the stationary pair y = A y + e with A = [[.5, .1], [0, .3]]
_V12 = (0.2 + 0.1 * 0.3 * _V22) / (1 - 0.5 * 0.3)
_V11 = (1 + 2 * 0.5 * 0.1 * _V12 + 0.1**2 * _V22) / (1 - 0.5**2)

#: The models' matrices written out by hand: T, V (of the states' shocks), Z, the variances of the measurement errors, and P0; x0 is zero.
_BY_HAND: dict[str, tuple] = {
    # level (running sum), twelve lags of the differenced series, the differenced twice series and its moving average
    "sarimax_loglike": (
        _filled(15, 15, {(0, 0): 1, (0, 12): 1, (0, 13): 1, (1, 12): 1, (1, 13): 1, **{(i, i - 1): 1 for i in range(2, 13)}, (13, 13): 0.4, (13, 14): 1}),
        _filled(15, 15, {(13, 13): 400, (13, 14): 120, (14, 13): 120, (14, 14): 36}), _filled(1, 15, {(0, 0): 1, (0, 12): 1, (0, 13): 1}), [0.0],
        _filled(15, 15, {**{(i, i): _VAGUE for i in range(13)}, (13, 13): 400 * (1 + 2 * 0.4 * 0.3 + 0.3**2) / (1 - 0.4**2), (13, 14): 120, (14, 13): 120, (14, 14): 36}),
    ),
    # innovation, level, damped trend, twelve seasons in turn
    "ets_seasonal_loglike": (
        _filled(15, 15, {(1, 1): 1, (1, 2): 0.95, (2, 2): 0.95, (3, 14): 1, **{(i, i - 1): 1 for i in range(4, 15)}}), 400 * np.outer(_SHARES, _SHARES), _filled(1, 15, {(0, 0): 1, (0, 1): 1, (0, 3): 1}), [0.0], _VAGUE * np.eye(15),
    ),
    "cycle_loglike": (_filled(3, 3, {(0, 0): 1, **_turned(2 * np.pi / 18, damp=0.95)}), np.diag([25.0, 4.0, 4.0]), np.array([[1.0, 1.0, 0.0]]), [400.0], _VAGUE * np.eye(3)),
    # level, three harmonics of a year, an autoregression
    "frequency_season_loglike": (
        _filled(8, 8, {(0, 0): 1, **_turned(np.pi / 6, np.pi / 3, np.pi / 2), (7, 7): 0.5}), np.diag([25.0, *[1.0] * 6, 9.0]), np.array([[1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0]]), [400.0], _VAGUE * np.eye(8),
    ),
    "varmax_loglike": (np.array([[0.5, 0.1], [0.0, 0.3]]), np.array([[1.0, 0.2], [0.2, 1.0]]), np.eye(2), [0.0, 0.0], np.array([[_V11, _V12], [_V12, _V22]])),
    "dynamic_factor_loglike": (np.array([[0.7]]), np.array([[1.0]]), np.array([[1.0], [0.5]]), [1.0, 1.0], np.array([[1 / (1 - 0.49)]])),
}


def _likelihood_sql(T: np.ndarray, V: np.ndarray, Z: np.ndarray, noise: list[float], P0: np.ndarray, series: str, observed: list[str]) -> str:
    """A filter over lists: each observation of a month updates the state by itself, which uncorrelated measurement errors allow."""
    listed = lambda a: "[" + ", ".join(listed(x) if np.ndim(x) else repr(float(x)) for x in np.asarray(a)) + "]"
    m = len(T)
    each, other = f"FOR i IN range(1, {m + 1})", f"FOR k IN range(1, {m + 1})"
    inner = "SELECT f.t, x, p, ll, c, e.* EXCLUDE (t) FROM f JOIN e ON e.t = f.t, k"
    for j, name in enumerate(observed):
        inner = f"SELECT *, c.z[{j + 1}] AS z FROM ({inner})"
        inner = f"SELECT *, [list_dot_product(p[i], z) {each}] AS g FROM ({inner})"
        inner = f"SELECT *, list_dot_product(g, z) + c.h[{j + 1}] AS s, {name} - list_dot_product(x, z) AS v FROM ({inner})"
        inner = f"SELECT * EXCLUDE (x, p, ll, z, g, s, v), [x[i] + g[i] / s * v {each}] AS x, [[p[i][k] - g[i] * g[k] / s {other}] {each}] AS p, ll - 0.5::DOUBLE * (ln(2 * pi()) + ln(s) + v * v / s) AS ll FROM ({inner})"
    inner = f"SELECT t, ll, c, [list_dot_product(c.t[i], x) {each}] AS x, [[list_dot_product(c.t[i], p[k]) {other}] {each}] AS w FROM ({inner})"
    return f"""WITH RECURSIVE k AS (SELECT {{'t': {listed(T)}::DOUBLE[][], 'v': {listed(V)}::DOUBLE[][], 'z': {listed(Z)}::DOUBLE[][], 'h': {listed(noise)}::DOUBLE[]}} AS c),
    e AS (SELECT row_number() OVER (ORDER BY m) AS t, * EXCLUDE (m) FROM ({series})),
    f AS (SELECT 1::BIGINT AS t, {listed(np.zeros(m))}::DOUBLE[] AS x, {listed(P0)}::DOUBLE[][] AS p, 0.0::DOUBLE AS ll
      UNION ALL SELECT t + 1, x, [[list_dot_product(w[i], c.t[k]) + c.v[i][k] {other}] {each}], ll FROM ({inner}))
    SELECT 'orders' AS series, round(ll, 3) AS loglike FROM f WHERE t = (SELECT count(*) + 1 FROM e)"""


_MONTHLY = "SELECT date_trunc('month', o_orderdate) AS m, count(*)::DOUBLE AS y FROM orders GROUP BY 1"
_PAIRS = "SELECT date_trunc('month', o_orderdate) AS m, (count(*) - 180) / 50::DOUBLE AS a, (avg(o_totalprice) - 250000) / 20000::DOUBLE AS b FROM orders GROUP BY 1"


def pairs(spark, sf_dir) -> DataFrame:
    """Monthly orders and their mean price, standardised."""
    rows = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(((F.count(F.lit(1)) - 180) / 50).alias("a"), ((F.avg("o_totalprice") - 250000) / 20000).alias("b"))
    return rows.withColumn("series", F.lit("orders"))


def _built(name: str, model: S.StateSpace, source=monthly, sql: str = _MONTHLY, observed: tuple[str, ...] = ("y",)):
    @register(name, _likelihood_sql(*_BY_HAND[name], sql, [*observed]))
    def q(spark, sf_dir):
        return S.loglike(source(spark, sf_dir), model, "series", ["m"], [*observed]).select("series", r(F.col("loglike"), 3).alias("loglike"))

    return q


_built("sarimax_loglike", M.sarimax((1, 1, 1), ar=[0.4], ma=[0.3], seasonal_order=(0, 1, 0, 12), sigma=20.0))
_built("ets_seasonal_loglike", M.ets(("A", "Ad", "A"), alpha=0.3, beta=0.1, gamma=0.2, phi=0.95, seasonal_periods=12, sigma=20.0))
_built("cycle_loglike", (M.level_trend(1, [5.0]) + M.cycle(18.0, 2.0, damping=0.95) + M.measurement_error(20.0)).build())
_built("frequency_season_loglike", (M.level_trend(1, [5.0]) + M.frequency_seasonality(12.0, 3, 1.0) + M.autoregressive([0.5], 3.0) + M.measurement_error(20.0)).build())
_built("varmax_loglike", M.varmax([np.array([[0.5, 0.1], [0.0, 0.3]])], cov=np.array([[1.0, 0.2], [0.2, 1.0]])), pairs, _PAIRS, ("a", "b"))
_built("dynamic_factor_loglike", M.dynamic_factor(np.array([[1.0], [0.5]]), [np.array([[0.7]])]), pairs, _PAIRS, ("a", "b"))


@register("statespace_simulate")
def statespace_simulate(spark, sf_dir):
    """Series as noisy as the events' values, whose level moves a tenth as much."""
    spread = float(table(spark, sf_dir, "events").agg(F.var_pop("value")).head()[0])
    return S.simulate_table(spark, level_model(spread, spread / 100), 50, 20, seed=1)


@register("simulation_smoother")
def simulation_smoother(spark, sf_dir):
    return S.smoothed_draws(monthly(spark, sf_dir), level_model(400.0, 25.0), "series", ["m"], ["y"], 20, seed=2)


@register("statespace_posterior_draws")
def statespace_posterior_draws(spark, sf_dir):
    """Filtered, predicted, smoothed and forecast draws of monthly orders under draws of the two variances."""
    draws = spark.range(10).select(F.col("id").alias("draw"), (400.0 + 20 * F.col("id")).alias("h"), (25.0 + F.col("id")).alias("q"))
    return S.posterior_outputs(monthly(spark, sf_dir), draws, lambda p: level_model(p["h"], p["q"]), "series", ["m"], ["y"], steps=6, seed=3)
