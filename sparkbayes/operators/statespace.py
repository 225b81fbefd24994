"""Linear-Gaussian state-space models: filters, smoothing, simulation, forecasts and impulse responses.

A model is nine matrices: x0, P0, c, d, T, Z, R, H, Q, of which all but x0 and P0 may carry a leading time axis.

    y_t = d + Z x_t + e_t, e ~ N(0, H)        x_{t+1} = c + T x_t + R w_t, w ~ N(0, Q)

Kernels are numpy over one series. Tables of many series run them with one shuffle by series, ordered inside each, or
filter and smooth batches of series side by side (``side_by_side``); scalar models also exist as Column folds, which never
leave the JVM. Missing observations are nulls or NaNs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import side_by_side as B

LN_2PI = math.log(2 * math.pi)
MATRICES = ("x0", "P0", "c", "d", "T", "Z", "R", "H", "Q")
AXES = {"x0": 1, "P0": 2, "c": 1, "d": 1, "T": 2, "Z": 2, "R": 2, "H": 2, "Q": 2}


@dataclass(frozen=True)
class StateSpace:
    T: np.ndarray
    Z: np.ndarray
    R: np.ndarray
    H: np.ndarray
    Q: np.ndarray
    x0: np.ndarray
    P0: np.ndarray
    c: np.ndarray | None = None
    d: np.ndarray | None = None
    states: tuple[str, ...] = ()
    observed: tuple[str, ...] = ()
    shocks: tuple[str, ...] = ()
    name: str = "model"
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        for k in MATRICES:
            if getattr(self, k) is not None:
                put(k, np.asarray(getattr(self, k), dtype=float))
        put("c", np.zeros(self.m) if self.c is None else self.c)
        put("d", np.zeros(self.p) if self.d is None else self.d)
        m, p, r = self.m, self.p, self.R.shape[-1]
        want = {"x0": (m,), "P0": (m, m), "c": (m,), "d": (p,), "T": (m, m), "Z": (p, m), "R": (m, r), "H": (p, p), "Q": (r, r)}
        for k, shape in want.items():
            value = getattr(self, k)
            if value.shape[-len(shape) :] != shape or value.ndim > len(shape) + (k not in ("x0", "P0")):
                raise ValueError(f"{k} has shape {value.shape}, not {shape}")
        put("states", self.states or tuple(f"state_{i}" for i in range(m)))
        put("observed", self.observed or tuple(f"y_{i}" for i in range(p)))
        put("shocks", self.shocks or tuple(f"shock_{i}" for i in range(r)))

    @property
    def m(self) -> int:
        return self.T.shape[-1]

    @property
    def p(self) -> int:
        return self.Z.shape[-2]

    def at(self, key: str, t: int) -> np.ndarray:
        value = getattr(self, key)
        return value[min(t, len(value) - 1)] if value.ndim > AXES[key] else value

    @property
    def time_varying(self) -> bool:
        return any(getattr(self, k).ndim > n for k, n in AXES.items())


def symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


@dataclass
class Filtered:
    filtered: np.ndarray
    filtered_cov: np.ndarray
    predicted: np.ndarray
    predicted_cov: np.ndarray
    observed: np.ndarray
    observed_cov: np.ndarray
    loglike: np.ndarray
    next_state: np.ndarray
    next_cov: np.ndarray


def update_joint(a, P, y, d, Z, H, jitter):
    """Joseph-form update with the rows of y that are there; the log density counts ln 2 pi once for each of them."""
    there = ~np.isnan(y)
    if not there.any():
        return a, P, 0.0
    Zs, v = Z[there], y[there] - d[there] - Z[there] @ a
    F_ = symmetric(Zs @ P @ Zs.T + H[np.ix_(there, there)] + jitter * np.eye(there.sum()))
    K = np.linalg.solve(F_, Zs @ P).T
    J = np.eye(len(a)) - K @ Zs
    out = symmetric(J @ P @ J.T + K @ H[np.ix_(there, there)] @ K.T) + jitter * np.eye(len(a))
    ll = -0.5 * (there.sum() * LN_2PI + np.linalg.slogdet(F_)[1] + v @ np.linalg.solve(F_, v))
    return a + K @ v, out, float(ll)


def update_univariate(a, P, y, d, Z, H, jitter):
    """One observed value after another; H's diagonal only. Values without variance say nothing."""
    ll = 0.0
    for i in range(len(y)):
        z, f = Z[i], float(Z[i] @ P @ Z[i] + H[i, i])
        if np.isnan(y[i]) or not f > 1e-12:
            continue
        v, K = y[i] - d[i] - z @ a, P @ z / f
        a = a + K * v
        P = symmetric(P - np.outer(K, K) * f)
        ll += -0.5 * (LN_2PI + math.log(f) + v * v / f)
    return a, P + jitter * np.eye(len(a)), ll


def update_root(a, S, y, d, Z, H, jitter):
    """Update of a Cholesky factor S of the covariance by one orthogonal triangularisation."""
    there = ~np.isnan(y)
    if not there.any():
        return a, S, 0.0
    Zs, k, m = Z[there], int(there.sum()), len(a)
    Hr = np.linalg.cholesky(H[np.ix_(there, there)] + jitter * np.eye(k)) if k else H[:0, :0]
    joint = np.block([[Hr, Zs @ S], [np.zeros((m, k)), S]])
    tri = np.linalg.qr(joint.T, mode="r").T
    tri = tri * np.where(np.diag(tri) < 0, -1.0, 1.0)[None, :]
    Fr, Kr, out = tri[:k, :k], tri[k:, :k], tri[k:, k:]
    v = y[there] - d[there] - Zs @ a
    u = np.linalg.solve(Fr, v)
    return a + Kr @ u, out, float(-0.5 * (k * LN_2PI + 2 * np.log(np.abs(np.diag(Fr))).sum() + u @ u))


def kalman(model: StateSpace, y: np.ndarray, kind: str = "standard", *, jitter: float = 0.0, tol: float = 1e-10) -> Filtered:
    """Filter one series (time x p, NaN where missing).

    kind: standard, cholesky, univariate, or convergent: without missing values and time axes the gain is kept once
    the covariance moves less than tol, so the rest of the series costs matrix-vector products only.
    """
    y = np.asarray(y, dtype=float).reshape(-1, model.p)
    n, m, p = len(y), model.m, model.p
    if kind not in FILTERS:
        raise ValueError(f"filter {kind!r}, not one of {sorted(FILTERS)}")
    if kind == "convergent" and (model.time_varying or np.isnan(y).any()):
        raise ValueError("the convergent filter needs constant matrices and no missing values")
    if kind == "standard" and m == p == 1 and not jitter and not model.time_varying:
        return kalman_of_numbers(model, y[:, 0])
    out = Filtered(*(np.empty(s) for s in ((n, m), (n, m, m), (n, m), (n, m, m), (n, p), (n, p, p), (n,))), np.empty(m), np.empty((m, m)))
    a, P = model.x0.copy(), model.P0.copy()
    root = kind == "cholesky"
    if root:
        P = np.linalg.cholesky(P + 1e-300 * np.eye(m)) if np.linalg.eigvalsh(P)[0] > 0 else psd_root(P)
    steady = None
    for t in range(n):
        d, Z, H, c, T, R, Q = (model.at(k, t) for k in ("d", "Z", "H", "c", "T", "R", "Q"))
        cov = P @ P.T if root else P
        out.predicted[t], out.predicted_cov[t] = a, cov
        out.observed[t], out.observed_cov[t] = d + Z @ a, Z @ cov @ Z.T + H
        if steady is not None:
            K, Fi, det, Pf = steady
            v = y[t] - d - Z @ a
            af, out.loglike[t] = a + K @ v, -0.5 * (p * LN_2PI + det + v @ Fi @ v)
        else:
            af, Pf, out.loglike[t] = FILTERS[kind](a, P, y[t], d, Z, H, jitter)
        out.filtered[t], out.filtered_cov[t] = af, Pf @ Pf.T if root else Pf
        a = c + T @ af
        if root:
            tri = np.linalg.qr(np.hstack([T @ Pf, R @ psd_root(Q)]).T, mode="r").T
            P = np.zeros((m, m))
            P[:, : tri.shape[1]] = tri
        elif steady is None:
            new = symmetric(T @ Pf @ T.T + R @ Q @ R.T)
            if kind == "convergent" and np.linalg.norm(new - P) < tol:
                F_ = symmetric(Z @ new @ Z.T + H + jitter * np.eye(p))
                Fi = np.linalg.inv(F_)
                steady = (new @ Z.T @ Fi, Fi, np.linalg.slogdet(F_)[1], update_joint(a, new, y[t], d, Z, H, jitter)[1])
            P = new
    out.next_state, out.next_cov = a, P @ P.T if root else P
    return out


def kalman_of_numbers(model: StateSpace, y: np.ndarray) -> Filtered:
    """The filter where state and observation are one number each."""
    d, z, h, c, t, q = (float(np.ravel(x)[0]) for x in (model.d, model.Z, model.H, model.c, model.T, model.R @ model.Q @ model.R.T))
    a, p, rows = float(model.x0[0]), float(model.P0[0, 0]), []
    for v in y.tolist():
        f = z * p * z + h
        if v != v:
            row = (a, p, a, p, d + z * a, f, 0.0)
        else:
            e, k = v - d - z * a, p * z / f
            row = (a + k * e, (1 - k * z) ** 2 * p + k * k * h, a, p, d + z * a, f, -0.5 * (LN_2PI + math.log(f) + e * e / f))
        rows.append(row)
        a, p = c + t * row[0], t * row[1] * t + q
    got = np.array(rows).reshape(len(y), 7)
    cube = lambda j: got[:, j].reshape(-1, 1, 1)
    return Filtered(got[:, 0:1], cube(1), got[:, 2:3], cube(3), got[:, 4:5], cube(5), got[:, 6], np.array([a]), np.array([[p]]))


FILTERS: dict[str, Callable] = {"standard": update_joint, "univariate": update_univariate, "cholesky": update_root, "convergent": update_joint}


def psd_root(a: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh(symmetric(np.atleast_2d(a)))
    return v * np.sqrt(np.clip(w, 0, None))


def gain(cov: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The solution of cov x = to; the least one where cov is singular."""
    try:
        out = np.linalg.solve(cov, to)
        if np.isfinite(out).all() and np.abs(cov @ out - to).max(initial=0.0) <= 1e-9 * max(1.0, np.abs(to).max(initial=0.0)) and np.abs(out).max(initial=0.0) < 1e6:
            return out
    except np.linalg.LinAlgError:
        pass
    return np.linalg.pinv(cov) @ to


def smooth(model: StateSpace, f: Filtered) -> tuple[np.ndarray, np.ndarray]:
    """Rauch-Tung-Striebel: means and covariances given the whole series."""
    a, P = f.filtered.copy(), f.filtered_cov.copy()
    if model.m == 1 and not model.time_varying:
        t, rows = float(model.T[0, 0]), [*zip(f.filtered[:, 0].tolist(), f.filtered_cov[:, 0, 0].tolist(), f.predicted[:, 0].tolist(), f.predicted_cov[:, 0, 0].tolist(), strict=True)]
        for i in range(len(rows) - 2, -1, -1):
            (mean, var, _, _), (_, _, ahead, spread) = rows[i], rows[i + 1]
            g = t * var / spread if spread > 0 else 0.0
            a[i, 0], P[i, 0, 0] = mean + g * (a[i + 1, 0] - ahead), var + g * g * (P[i + 1, 0, 0] - spread)
        return a, P
    for t in range(len(a) - 2, -1, -1):
        T, ahead = model.at("T", t), f.predicted_cov[t + 1]
        G = gain(ahead, T @ f.filtered_cov[t]).T
        a[t] = f.filtered[t] + G @ (a[t + 1] - f.predicted[t + 1])
        P[t] = symmetric(f.filtered_cov[t] + G @ (P[t + 1] - ahead) @ G.T)
    return a, P


def simulate(model: StateSpace, steps: int, rng: np.random.Generator, *, x0=None, P0=None, append_x0: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """States and observations of ``steps`` times, with the initial state as the first or left out."""
    x = (model.x0 if x0 is None else np.asarray(x0)) + psd_root(model.P0 if P0 is None else P0) @ rng.standard_normal(model.m)
    states, seen = [], []
    for t in range(steps + (not append_x0)):
        states.append(x)
        seen.append(model.at("d", t) + model.at("Z", t) @ x + psd_root(model.at("H", t)) @ rng.standard_normal(model.p))
        Q = model.at("Q", t)
        x = model.at("c", t) + model.at("T", t) @ x + model.at("R", t) @ (psd_root(Q) @ rng.standard_normal(len(Q)))
    lo = 0 if append_x0 else 1
    return np.array(states[lo:]), np.array(seen[lo:])


def simulation_smoother(model: StateSpace, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A draw of the states given the series: an unconditional draw corrected by the difference of the two smoothed means."""
    y = np.asarray(y, dtype=float).reshape(-1, model.p)
    states, seen = simulate(model, len(y), rng)
    seen = np.where(np.isnan(y), np.nan, seen)
    return states - smooth(model, kalman(model, seen))[0] + smooth(model, kalman(model, y))[0]


def forecast(model: StateSpace, x: np.ndarray, P: np.ndarray, steps: int, *, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of the observations of the ``steps`` times after a state (x, P) at time ``start``."""
    mean, cov = [], []
    for t in range(start, start + steps):
        T, R, Q = (model.at(k, t) for k in ("T", "R", "Q"))
        x, P = model.at("c", t) + T @ x, symmetric(T @ P @ T.T + R @ Q @ R.T)
        Z = model.at("Z", t + 1)
        mean.append(model.at("d", t + 1) + Z @ x)
        cov.append(Z @ P @ Z.T + model.at("H", t + 1))
    return np.array(mean), np.array(cov)


def impulse_response(model: StateSpace, steps: int, *, shock_size=None, shock_cov=None, shock_trajectory=None, orthogonalize: bool = False, rng=None) -> np.ndarray:
    """States after a shock at the first step (all steps with a trajectory); without one, drawn from Q or ``shock_cov``."""
    if sum(x is not None for x in (shock_size, shock_cov, shock_trajectory)) > 1:
        raise ValueError("at most one of shock_size, shock_cov and shock_trajectory")
    r = model.R.shape[-1]
    shocks = np.zeros((steps, r))
    if shock_trajectory is not None:
        shocks[: len(shock_trajectory)] = shock_trajectory
    elif shock_size is not None:
        shocks[0] = shock_size
        if orthogonalize:
            root = np.linalg.cholesky(model.at("Q", 0))
            shocks[0] = (root / np.diag(root)[None, :]) @ shocks[0]
    else:
        root = psd_root(model.at("Q", 0) if shock_cov is None else np.asarray(shock_cov, dtype=float))
        shocks[0] = root @ (rng or np.random.default_rng(0)).standard_normal(r)
    x, out = np.zeros(model.m), []
    for t in range(steps):
        x = model.at("T", t) @ x + model.at("R", t) @ shocks[t] + (model.at("c", t) if t else 0)
        out.append(x)
    return np.array(out)


def direct_logp(model: StateSpace, y: np.ndarray) -> float:
    """Log density of a whole series as one multivariate normal, for tests."""
    y = np.asarray(y, dtype=float).reshape(-1, model.p)
    n, m, p = len(y), model.m, model.p
    mean, cov, x, P = np.zeros(n * p), np.zeros((n * p, n * p)), model.x0, model.P0
    covs = []
    for t in range(n):
        Z = model.at("Z", t)
        mean[t * p : (t + 1) * p] = model.at("d", t) + Z @ x
        covs.append(P)
        step, at = np.eye(m), P
        for s in range(t, n):
            cov[s * p : (s + 1) * p, t * p : (t + 1) * p] = model.at("Z", s) @ step @ at @ Z.T
            step = model.at("T", s) @ step
        cov[t * p : (t + 1) * p, t * p : (t + 1) * p] += model.at("H", t)
        x, P = model.at("c", t) + model.at("T", t) @ x, model.at("T", t) @ P @ model.at("T", t).T + model.at("R", t) @ model.at("Q", t) @ model.at("R", t).T
    cov = np.tril(cov) + np.tril(cov, -1).T
    there = ~np.isnan(y.ravel())
    v, cov = (y.ravel() - mean)[there], cov[np.ix_(there, there)]
    return float(-0.5 * (len(v) * LN_2PI + np.linalg.slogdet(cov)[1] + v @ np.linalg.solve(cov, v)))


# --- tables of series --------------------------------------------------------------------------------------------


def kind_of(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def per_series(df: DataFrame, series: str, time: list[str], observed: list[str], kernel: Callable[[np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Run a kernel on each series' observations in order of time; ``schema`` is of what it returns."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(time)
        out = kernel(group[observed].to_numpy(dtype=float))
        out.insert(0, series, group[series].iloc[0])
        return out

    return df.select(series, *time, *observed).groupBy(series).applyInPandas(run, f"{series} {kind_of(df, series)}, {schema}")


def filter_series(df: DataFrame, model: StateSpace, series: str, time: list[str], observed: list[str], *, kind: str = "standard", smoothed: bool = False) -> DataFrame:
    """(series, t, filtered, filtered_cov, predicted, predicted_cov, observed, observed_cov, loglike[, smoothed, smoothed_cov]); matrices as flat arrays."""
    names = ["filtered", "filtered_cov", "predicted", "predicted_cov", "observed", "observed_cov"]

    def kernel(sizes: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, list]:
        f = B.filtered(model, sizes, ys, kind)
        out = [f[k] for k in names]
        if smoothed:
            out += B.smoothed(model, sizes, f)
        rows, t = np.nonzero(np.arange(ys.shape[1])[None] < sizes[:, None])
        told = [B.lists(x[rows if len(x) > 1 else 0, t]) for x in out]
        return rows, [pa.array(t.astype(np.int32)), *told[: len(names)], pa.array(f["loglike"][rows, t]), *told[len(names) :]]

    arrays = ", ".join(f"{k} array<double>" for k in names)
    return B.mapped(B.gathered(df, series, time, observed), series, model.p, model.m, kernel, f"t int, {arrays}, loglike double" + ", smoothed array<double>, smoothed_cov array<double>" * smoothed)


def loglikes(df: DataFrame, model: StateSpace, series: str, time: list[str], observed: list[str], kinds: list[str]) -> DataFrame:
    """(series, kind, loglike) by several filters, side by side on each series."""

    def kernel(sizes: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, list]:
        found = [B.filtered(model, sizes, ys, k, keep=False)["loglike"] for k in kinds]
        return np.tile(np.arange(len(sizes)), len(kinds)), [pa.array(np.repeat(kinds, len(sizes)).tolist(), pa.string()), pa.array(np.concatenate(found))]

    return B.mapped(B.gathered(df, series, time, observed), series, model.p, model.m, kernel, "kind string, loglike double")


def loglike(df: DataFrame, model: StateSpace, series: str, time: list[str], observed: list[str], *, kind: str = "standard") -> DataFrame:
    """(series, loglike)"""
    return loglikes(df, model, series, time, observed, [kind]).drop("kind")


def forecast_series(df: DataFrame, model: StateSpace, series: str, time: list[str], observed: list[str], steps: int) -> DataFrame:
    """(series, step, mean, cov): from the last filtered state of each series."""

    def kernel(y: np.ndarray) -> pd.DataFrame:
        f = kalman(model, y)
        mean, cov = forecast(model, f.filtered[-1], f.filtered_cov[-1], steps, start=len(y) - 1)
        return pd.DataFrame({"step": np.arange(1, steps + 1), "mean": list(mean), "cov": [x.ravel() for x in cov]})

    return per_series(df, series, time, observed, kernel, "step int, mean array<double>, cov array<double>")


def smoothed_draws(df: DataFrame, model: StateSpace, series: str, time: list[str], observed: list[str], draws: int, *, seed: int = 0) -> DataFrame:
    """(series, draw, t, state): states drawn given each series."""

    def kernel(y: np.ndarray) -> pd.DataFrame:
        rng = np.random.default_rng([seed, len(y), int(np.nansum(np.abs(y)) * 1000) % (1 << 32)])
        made = [(k, t, x) for k in range(draws) for t, x in enumerate(simulation_smoother(model, y, rng))]
        return pd.DataFrame(made, columns=["draw", "t", "state"])

    return per_series(df, series, time, observed, kernel, "draw int, t int, state array<double>")


def posterior_outputs(df: DataFrame, draws: DataFrame, build: Callable[[dict], StateSpace], series: str, time: list[str], observed: list[str], *, outputs: tuple[str, ...] = ("filtered", "predicted", "smoothed"), steps: int = 0, seed: int = 0) -> DataFrame:
    """(series, draw, output, t, state, observed): states drawn under each row of parameters, and with ``steps`` a forecast path.

    draws: a column ``draw`` and the parameters that ``build`` turns into a model; as many rows as the posterior has.
    Each series meets every draw, which is what is asked for: series times draws are dealt over the tasks.
    """
    params = [c for c in draws.columns if c != "draw"]
    rows = F.sort_array(F.collect_list(F.struct(*[F.col(t) for t in time], F.array(*[F.col(o).cast("double") for o in observed]).alias("_y"))))
    whole = df.groupBy(series).agg(rows.alias("_r")).select(series, F.transform("_r", lambda x: x["_y"]).alias("ys"))
    pairs = whole.crossJoin(draws).repartition(F.col(series), F.col("draw"))

    def run(batches):
        for b in batches:
            out = []
            for i in range(len(b)):
                model = build({k: float(b[k].iloc[i]) for k in params})
                y = np.array([np.asarray(v, dtype=float) for v in b["ys"].iloc[i]])
                rng = np.random.default_rng([seed, int(b["draw"].iloc[i]), len(y)])
                f = kalman(model, y)
                made = {"filtered": (f.filtered, f.filtered_cov), "predicted": (f.predicted, f.predicted_cov)}
                for name in outputs:
                    x = simulation_smoother(model, y, rng) if name == "smoothed" else np.array([a + psd_root(P) @ rng.standard_normal(model.m) for a, P in zip(*made[name], strict=True)])
                    seen = [model.at("d", t) + model.at("Z", t) @ v + psd_root(model.at("H", t)) @ rng.standard_normal(model.p) for t, v in enumerate(x)]
                    out += [(b[series].iloc[i], int(b["draw"].iloc[i]), name, t, v, w) for t, (v, w) in enumerate(zip(x, seen, strict=True))]
                if steps:
                    x, seen = simulate(model, steps, rng, x0=f.filtered[-1], P0=f.filtered_cov[-1], append_x0=False)
                    out += [(b[series].iloc[i], int(b["draw"].iloc[i]), "forecast", len(y) + t, v, w) for t, (v, w) in enumerate(zip(x, seen, strict=True))]
            yield pd.DataFrame(out, columns=[series, "draw", "output", "t", "state", "observed"])

    return pairs.mapInPandas(run, f"{series} {kind_of(df, series)}, draw long, output string, t int, state array<double>, observed array<double>")


def sample_matrices(draws: DataFrame, build: Callable[[dict], StateSpace], names: tuple[str, ...] = ("x0", "P0", "c", "d", "T", "Z", "R", "H", "Q")) -> DataFrame:
    """(draw, matrix, shape, entries): the matrices of the model that ``build`` makes of each row of parameters, entries row by row."""
    unknown = [k for k in names if k not in MATRICES and k not in ("x0", "P0")]
    if unknown:
        raise ValueError(f"{unknown} are no matrices of a model")
    params = [c for c in draws.columns if c != "draw"]

    def run(batches):
        for b in batches:
            out = []
            for i in range(len(b)):
                model = build({k: float(b[k].iloc[i]) for k in params})
                out += [(int(b["draw"].iloc[i]), k, list(getattr(model, k).shape), getattr(model, k).ravel().tolist()) for k in names]
            yield pd.DataFrame(out, columns=["draw", "matrix", "shape", "entries"])

    return draws.mapInPandas(run, "draw long, matrix string, shape array<int>, entries array<double>")


def sample_filter_outputs(df: DataFrame, draws: DataFrame, build: Callable[[dict], StateSpace], series: str, time: list[str], observed: list[str], *, smoothed: bool = True) -> DataFrame:
    """(series, draw, t, output, mean, cov): what filter and smoother say under each row of parameters, without drawing states."""
    params = [c for c in draws.columns if c != "draw"]
    rows = F.sort_array(F.collect_list(F.struct(*[F.col(t) for t in time], F.array(*[F.col(o).cast("double") for o in observed]).alias("_y"))))
    whole = df.groupBy(series).agg(rows.alias("_r")).select(series, F.transform("_r", lambda x: x["_y"]).alias("ys"))
    # Each series meets every draw, as asked for.
    pairs = whole.crossJoin(draws).repartition(F.col(series), F.col("draw"))

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                model = build({k: float(b[k].iloc[i]) for k in params})
                f = kalman(model, np.array([np.asarray(v, dtype=float) for v in b["ys"].iloc[i]]))
                made = {"filtered": (f.filtered, f.filtered_cov), "predicted": (f.predicted, f.predicted_cov), "observed": (f.observed, f.observed_cov)}
                if smoothed:
                    made["smoothed"] = smooth(model, f)
                out = [(b[series].iloc[i], int(b["draw"].iloc[i]), t, k, a.tolist(), P.ravel().tolist()) for k, (means, covs) in made.items() for t, (a, P) in enumerate(zip(means, covs, strict=True))]
                yield pd.DataFrame(out, columns=[series, "draw", "t", "output", "mean", "cov"])

    return pairs.mapInPandas(run, f"{series} {kind_of(df, series)}, draw long, t int, output string, mean array<double>, cov array<double>")


def sequence_mvn_logp(means: np.ndarray, covs: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log density of each time's values under its own normal; missing values are left out, a time without any says nothing."""
    out = np.zeros(len(y))
    for t, (m, S, v) in enumerate(zip(means, covs, np.asarray(y, dtype=float).reshape(len(means), -1), strict=True)):
        there = ~np.isnan(v)
        if there.any():
            e, part = v[there] - m[there], S[np.ix_(there, there)]
            out[t] = -0.5 * (there.sum() * LN_2PI + np.linalg.slogdet(part)[1] + e @ gain(part, e))
    return out


def sequence_mvn_draws(means: np.ndarray, covs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A draw of each time's values from its own normal, by the symmetric root, so singular covariances are fine."""
    return np.array([m + psd_root(S) @ rng.standard_normal(len(m)) for m, S in zip(means, covs, strict=True)])


def model_tables(spark, model: StateSpace) -> dict[str, DataFrame]:
    """A model described by tables: ``matrices`` (matrix, shape, time_varying, free entries), ``coords`` (dimension, place, label) and ``info`` (what, value)."""
    axes = {"x0": 1, "P0": 2} | AXES
    matrices = [(k, list(v.shape), v.ndim > axes[k], int(np.count_nonzero(v))) for k in ("x0", "P0", "c", "d", "T", "Z", "R", "H", "Q") for v in [np.asarray(getattr(model, k))]]
    coords = [(name, i, label) for name, labels in (("state", model.states), ("observed", model.observed), ("shock", model.shocks)) for i, label in enumerate(labels)]
    info = [("name", model.name), ("states", str(model.m)), ("observed", str(model.p)), ("shocks", str(model.R.shape[-1])), ("time_varying", str(model.time_varying).lower())]
    return {
        "matrices": spark.createDataFrame(matrices, "matrix string, shape array<int>, time_varying boolean, entries int"),
        "coords": spark.createDataFrame(coords, "dimension string, place int, label string"),
        "info": spark.createDataFrame(info, "what string, value string"),
    }


def simulate_table(spark, model: StateSpace, draws: int, steps: int, *, seed: int = 0) -> DataFrame:
    """(draw, t, state, observed): unconditional draws, one generator for each."""

    def run(batches):
        for batch in batches:
            rows = []
            for k in batch["id"]:
                x, y = simulate(model, steps, np.random.default_rng([seed, int(k)]))
                rows += [(int(k), t, a, b) for t, (a, b) in enumerate(zip(x, y, strict=True))]
            yield pd.DataFrame(rows, columns=["draw", "t", "state", "observed"])

    return spark.range(draws).mapInPandas(run, "draw long, t int, state array<double>, observed array<double>")


# --- scalar models as folds --------------------------------------------------------------------------------------


def series_array(df: DataFrame, series: str, time: list[str], value: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(*[F.col(t) for t in time], F.col(value).alias("_y"))))
    return df.groupBy(series).agg(rows.alias("_r")).select(series, F.transform("_r", lambda x: x["_y"]).alias("ys"))


def local_level_fold(ys: Column, a0: float, P0: float, H: float, Q: float, phi: float = 1.0) -> Column:
    """Struct (a, P, ll) after a scalar filter of state a' = phi a + w; null observations are passed over."""
    start = F.struct(F.lit(a0).alias("a"), F.lit(P0).alias("P"), F.lit(0.0).alias("ll"))

    def step(s: Column, y: Column) -> Column:
        f = s["P"] + H
        v, k = y - s["a"], s["P"] / f
        seen = y.isNotNull()
        a = F.when(seen, s["a"] + k * v).otherwise(s["a"])
        P = F.when(seen, s["P"] * (1 - k)).otherwise(s["P"])
        ll = s["ll"] + F.when(seen, -0.5 * (LN_2PI + F.log(f) + v * v / f)).otherwise(F.lit(0.0))
        return F.struct((phi * a).alias("a"), (phi * phi * P + Q).alias("P"), ll.alias("ll"))

    return F.aggregate(ys, start, step)


def exponential_smoothing_fold(ys: Column, alpha: float, beta: float | None = None, phi: float = 1.0) -> Column:
    """Struct (level, trend, sse) after (damped) additive smoothing from the first value; without beta there is no trend."""
    start = F.struct(F.get(ys, F.lit(0)).cast("double").alias("level"), F.lit(0.0).alias("trend"), F.lit(0.0).alias("sse"))

    def step(s: Column, y: Column) -> Column:
        e = y - s["level"] - phi * s["trend"]
        trend = phi * s["trend"] + (alpha * beta * e if beta is not None else F.lit(0.0)) if beta is not None else F.lit(0.0)
        return F.struct((s["level"] + phi * s["trend"] + alpha * e).alias("level"), trend.alias("trend"), (s["sse"] + e * e).alias("sse"))

    return F.aggregate(F.slice(ys, F.lit(2), F.greatest(F.size(ys) - 1, F.lit(0))), start, step)


def with_initial(model: StateSpace, x0: np.ndarray, P0: np.ndarray) -> StateSpace:
    return replace(model, x0=x0, P0=P0)
