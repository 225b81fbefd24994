"""Posterior approximation: point estimates, Gaussian and variational approximations, paths of quasi-Newton steps, particles.

Every optimizer sees a ``Target``: value and derivatives of an unnormalised log posterior at a point. Over a table each
look is one aggregate with all derivatives as sums; what many paths or particles do on small data runs as tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as E

LN_2PI = math.log(2 * math.pi)


@dataclass
class Target:
    """Log density over a vector of named parameters: ``value``, ``gradient`` and ``hessian`` at a point."""

    names: list[str]
    look: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]
    looks: int = 0
    many: Callable[[list[np.ndarray]], list[tuple[float, np.ndarray, np.ndarray]]] | None = None
    slopes: Callable[[np.ndarray], tuple[float, np.ndarray]] | None = None  # value and gradient alone
    product: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None  # the Hessian at a point times a vector

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        self.looks += 1
        return self.look(np.asarray(x, dtype=float))

    def at_all(self, points: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Several points in one pass over the data where the target can do that."""
        if self.many is None:
            return [self(p) for p in points]
        self.looks += 1
        return self.many(points)


def derivatives(e: E.Expr, names: list[str]) -> tuple[list[E.Expr], list[list[E.Expr]]]:
    first = [E.derivative(e, n) for n in names]
    return first, [[E.derivative(first[i], names[j]) for j in range(i + 1)] for i in range(len(names))]


def table_target(df: DataFrame, likelihood: E.Expr, prior: E.Expr, names: list[str]) -> Target:
    """Sum of a row expression over a table plus a prior of the parameters. The table's columns should be few or cached: each look scans them once."""
    g, h = derivatives(likelihood, names)
    pg, ph = derivatives(prior, names)
    k = len(names)

    terms = [likelihood, *g, *[h[i][j] for i in range(k) for j in range(i + 1)]]

    def many(points: list[np.ndarray]):
        values = [dict(zip(names, np.asarray(x, dtype=float).tolist(), strict=True)) for x in points]
        row = df.agg(*[F.sum(E.column(t, at)).alias(f"s{n}_{i}") for n, at in enumerate(values) for i, t in enumerate(terms)]).head()
        sums, out = [float(v) if v is not None else 0.0 for v in row], []
        for n, at in enumerate(values):
            own = sums[n * len(terms) : (n + 1) * len(terms)]
            hess, at_h = np.zeros((k, k)), iter(own[1 + k :])
            for i in range(k):
                for j in range(i + 1):
                    hess[i, j] = hess[j, i] = next(at_h) + float(E.evaluate(ph[i][j], at))
            out.append((own[0] + float(E.evaluate(prior, at)), np.array([own[1 + i] + float(E.evaluate(pg[i], at)) for i in range(k)]), hess))
        return out

    def summed(exprs: list[E.Expr], at: dict[str, float]) -> np.ndarray:
        row = df.agg(*[F.sum(E.column(t, at)).alias(f"s{i}") for i, t in enumerate(exprs)]).head()
        return np.array([float(v) if v is not None else 0.0 for v in row])

    def slopes(x: np.ndarray) -> tuple[float, np.ndarray]:
        at = dict(zip(names, np.asarray(x, dtype=float).tolist(), strict=True))
        got = summed([likelihood, *g], at) + np.array([float(E.evaluate(e, at)) for e in (prior, *pg)])
        return float(got[0]), got[1:]

    # The slope along a direction is an expression again; its derivatives are the Hessian times that direction, k sums instead of k squared.
    along = [f"_along_{n}" for n in names]
    lines = [[E.derivative(sum((d * E.param(v) for d, v in zip(first, along, strict=True)), E.const(0.0)), n) for n in names] for first in (g, pg)]

    def product(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        at = dict(zip([*names, *along], [*np.asarray(x, dtype=float).tolist(), *np.asarray(v, dtype=float).tolist()], strict=True))
        return summed(lines[0], at) + np.array([float(E.evaluate(e, at)) for e in lines[1]])

    return Target(names, lambda x: many([x])[0], many=many, slopes=slopes, product=product)


def function_target(names: list[str], value: Callable[[np.ndarray], float], gradient: Callable[[np.ndarray], np.ndarray], hessian: Callable[[np.ndarray], np.ndarray] | None = None) -> Target:
    def look(x):
        return float(value(x)), np.asarray(gradient(x), dtype=float), hessian(x) if hessian else numeric_hessian(gradient, x)

    return Target(names, look)


def numeric_hessian(gradient: Callable, x: np.ndarray, h: float = 1e-5) -> np.ndarray:
    rows = [(np.asarray(gradient(x + h * e)) - np.asarray(gradient(x - h * e))) / (2 * h) for e in np.eye(len(x))]
    return (np.array(rows) + np.array(rows).T) / 2


@dataclass
class Fit:
    names: list[str]
    mean: np.ndarray
    covariance: np.ndarray
    value: float
    info: dict = field(default_factory=dict)

    def draws(self, spark: SparkSession, n: int, *, seed: int = 0) -> DataFrame:
        """(draw, one column per parameter) from the Gaussian approximation."""
        root, names, mean = np.linalg.cholesky(nearest_psd(self.covariance)), self.names, self.mean

        def run(batches):
            for b in batches:
                z = np.array([np.random.default_rng([seed, int(i)]).standard_normal(len(mean)) for i in b["id"]]).reshape(-1, len(mean))
                yield pd.DataFrame({"draw": b["id"], **dict(zip(names, (mean + z @ root.T).T, strict=True))})

        return spark.range(n).mapInPandas(run, "draw long, " + ", ".join(f"`{k}` double" for k in names))


def nearest_psd(a: np.ndarray, least: float = 1e-12) -> np.ndarray:
    w, v = np.linalg.eigh((a + a.T) / 2)
    return (v * np.maximum(w, least)) @ v.T


def uphill(a: np.ndarray) -> np.ndarray:
    """A positive definite matrix with the eigenvectors of ``a`` and the sizes of its eigenvalues."""
    w, v = np.linalg.eigh((a + a.T) / 2)
    w = np.abs(w)
    return (v * np.maximum(w, 1e-8 * max(w.max(), 1e-8))) @ v.T


def search(target: Target, x: np.ndarray, direction: np.ndarray, value: float, gradient: np.ndarray):
    """A step up along a direction: halved until it gives a hundredth of what the slope promises."""
    size, slope = 1.0, float(gradient @ direction)
    while size > 1e-10:
        got = target(x + size * direction)
        if np.isfinite(got[0]) and np.isfinite(got[1]).all() and np.isfinite(got[2]).all() and got[0] >= value + 0.01 * size * slope:
            return x + size * direction, got
        size /= 2
    return x, None


def find_map(target: Target, start: np.ndarray, *, method: str = "newton", steps: int = 100, tol: float = 1e-8, memory: int = 10, bounds=None, **kw) -> tuple[np.ndarray, tuple, dict]:
    """The point of highest density; (point, what was seen there, info).

    method: newton, bfgs or lbfgs; trust-ncg, by Hessian-vector products; basinhopping, over many modes. With ``bounds``, a pair
    (lower, upper) for each parameter with None for no limit, newton, lbfgs and basinhopping stay inside.
    """
    if method in ("trust-ncg", "basinhopping") or bounds is not None:
        from . import optimize

        if method == "basinhopping":
            return optimize.basin_hopping(target, start, bounds=bounds, steps=steps, tol=tol, **kw)
        if method == "trust-ncg":
            if bounds is not None:
                raise ValueError("trust-ncg knows no bounds")
            x, _, info = optimize.trust_region(target, start, steps=steps, tol=tol, **kw)
            return x, target(x), info
        return optimize.find_bounded(target, start, bounds, method=method, steps=steps, tol=tol, memory=memory, **kw)
    x = np.asarray(start, dtype=float)
    seen = target(x)
    S: list[np.ndarray] = []
    Y: list[np.ndarray] = []
    H = np.eye(len(x))
    for step in range(steps):
        value, g, h = seen
        if np.max(np.abs(g)) < tol * max(1.0, abs(value)):
            break
        if method == "newton":
            direction = np.linalg.solve(uphill(-h), g)
        elif method == "bfgs":
            direction = H @ g
        elif method == "lbfgs":
            direction = two_loops(g, S, Y)
        else:
            raise ValueError(f"method {method!r}, not newton, bfgs, lbfgs, trust-ncg or basinhopping")
        new, got = search(target, x, direction, value, g)
        if got is None:
            break
        s, y = new - x, g - got[1]
        if s @ y > 1e-12 * (y @ y):
            if method == "bfgs":
                r = 1 / (s @ y)
                V = np.eye(len(x)) - r * np.outer(s, y)
                H = V @ H @ V.T + r * np.outer(s, s)
            S, Y = [*S, s][-memory:], [*Y, y][-memory:]
        done = abs(got[0] - value) < 1e-14 * max(1.0, abs(value))
        x, seen = new, got
        if done:
            break
    return x, seen, {"steps": step + 1, "looks": target.looks, "inverse_hessian": H}


def two_loops(g: np.ndarray, S: list[np.ndarray], Y: list[np.ndarray]) -> np.ndarray:
    q, a = g.copy(), []
    for s, y in zip(reversed(S), reversed(Y), strict=True):
        a.append((s @ q) / (s @ y))
        q = q - a[-1] * y
    if S:
        q = q * (S[-1] @ Y[-1]) / (Y[-1] @ Y[-1])
    for s, y, b in zip(S, Y, reversed(a), strict=True):
        q = q + s * (b - (y @ q) / (s @ y))
    return q


def fit_laplace(target: Target, start: np.ndarray, **kw) -> Fit:
    """Gaussian at the mode with the inverse of minus the Hessian as covariance."""
    x, seen, info = find_map(target, start, **kw)
    return Fit(target.names, x, np.linalg.inv(nearest_psd(-seen[2], 1e-12)), seen[0], info)


def fit_dadvi(target: Target, start: np.ndarray, *, n_fixed: int = 30, seed: int = 0, steps: int = 200, tol: float = 1e-6) -> Fit:
    """Mean-field Gaussian by a deterministic objective: the mean density over fixed standard normal draws plus the log scales."""
    k = len(start)
    Z = np.random.default_rng(seed).standard_normal((n_fixed // 2 or 1, k))
    Z = np.vstack([Z, -Z])

    def look(v):
        mu, rho = v[:k], v[k:]
        scale, total, gm, gr = np.exp(rho), 0.0, np.zeros(k), np.zeros(k)
        hess = np.zeros((2 * k, 2 * k))
        for z, (value, g, h) in zip(Z, target.at_all([mu + scale * z for z in Z]), strict=True):
            total, gm, gr = total + value, gm + g, gr + g * z * scale
            J = np.hstack([np.eye(k), np.diag(scale * z)])
            hess += J.T @ h @ J
            hess[k:, k:] += np.diag(g * z * scale)
        n = len(Z)
        return total / n + rho.sum(), np.concatenate([gm / n, gr / n + 1]), hess / n

    inner = Target([*target.names, *[f"log_sd_{n}" for n in target.names]], look)
    x, seen, info = find_map(inner, np.concatenate([start, np.full(k, -1.0)]), steps=steps, tol=tol)
    return Fit(target.names, x[:k], np.diag(np.exp(2 * x[k:])), seen[0], info)


# --- guides of variational inference -----------------------------------------------------------------------------


@dataclass
class Guide:
    """A Gaussian over the parameters: diagonal, full or diagonal plus low rank."""

    mean: np.ndarray
    scale: np.ndarray  # standard deviations of the diagonal part
    factor: np.ndarray  # k x r, or k x 0

    @staticmethod
    def make(kind: str, k: int, rank: int | None = None) -> Guide:
        r = {"diagonal": 0, "full": k, "low_rank": rank or max(1, round(math.sqrt(k)))}[kind]
        return Guide(np.zeros(k), np.full(k, 0.1), np.zeros((k, r)) + 0.01 * np.eye(k, r))

    def covariance(self) -> np.ndarray:
        return np.diag(self.scale**2) + self.factor @ self.factor.T

    def logq(self, x: np.ndarray) -> np.ndarray:
        root = np.linalg.cholesky(self.covariance())
        u = np.linalg.solve(root, (np.atleast_2d(x) - self.mean).T)
        return -0.5 * (u * u).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * len(self.mean) * LN_2PI


def fit_advi(target: Target, kind: str = "diagonal", *, steps: int = 500, draws: int = 4, rate: float = 0.05, seed: int = 0, rank: int | None = None) -> Fit:
    """Stochastic ascent of the evidence bound; the entropy's gradient is taken in closed form."""
    k = len(target.names)
    guide, rng = Guide.make(kind, k, rank), np.random.default_rng(seed)
    r = guide.factor.shape[1]
    rho = np.log(guide.scale)
    state = np.concatenate([guide.mean, rho, guide.factor.ravel()])
    m, v = np.zeros_like(state), np.zeros_like(state)
    for t in range(1, steps + 1):
        mu, scale, B = state[:k], np.exp(state[k : 2 * k]), state[2 * k :].reshape(k, r)
        g = np.zeros_like(state)
        for _ in range(draws):
            e, f = rng.standard_normal(k), rng.standard_normal(r)
            slope = target(mu + scale * e + B @ f)[1] / draws
            g[:k] += slope
            g[k : 2 * k] += slope * e * scale
            g[2 * k :] += np.outer(slope, f).ravel()
        inverse = np.linalg.inv(np.diag(scale**2) + B @ B.T)
        g[k : 2 * k] += np.diag(inverse) * scale**2
        g[2 * k :] += (inverse @ B).ravel()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        state = state + rate * min(1.0, 10 / math.sqrt(t)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    guide = Guide(state[:k], np.exp(state[k : 2 * k]), state[2 * k :].reshape(k, r))
    return Fit(target.names, guide.mean, guide.covariance(), float("nan"), {"guide": guide})


# --- pathfinder --------------------------------------------------------------------------------------------------


@dataclass
class Path:
    """What one path gave. ``status`` is the search's; ``chosen`` tells how its Gaussian was picked."""

    status: str
    draws: np.ndarray
    logp: np.ndarray
    logq: np.ndarray
    elbo: float
    steps: int
    updates: int = 0
    chosen: str = "SUCCESS"


def inverse_hessian(alpha: np.ndarray, S: list[np.ndarray], Y: list[np.ndarray]) -> np.ndarray:
    """Dense inverse Hessian of quasi-Newton pairs from a diagonal start, in compact form."""
    H = np.diag(alpha)
    for s, y in zip(S, Y, strict=True):
        r = 1 / (s @ y)
        V = np.eye(len(alpha)) - r * np.outer(s, y)
        H = V @ H @ V.T + r * np.outer(s, s)
    return H


def next_alpha(alpha: np.ndarray, s: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The diagonal after one more pair."""
    a, b, c = z @ (alpha * z), z @ s, s @ (s / alpha)
    return 1 / (a / (b * alpha) + z * z / b - a * s * s / (b * c * alpha * alpha))


def search_status(updates: int, steps: int, ended: str) -> str:
    """How a search ended, by how many of its steps gave a pair: too few mean that its curvature can't be trusted."""
    if updates <= 1:
        return "INIT_FAILED_LOW_UPDATE_PCT" if steps >= 3 else "INIT_FAILED"
    if ended != "CONVERGED":
        return ended
    return "LOW_UPDATE_PCT" if 3 * updates < steps else "CONVERGED"


def pathfinder_path(logp_grad: Callable[[np.ndarray], tuple[float, np.ndarray]], base: np.ndarray, rng: np.random.Generator, *, jitter: float = 2.0, draws: int = 1000, elbo_draws: int = 10, memory: int | None = None, steps: int = 200, eps: float = 1e-8, retries: int = 10) -> Path:
    """One path: quasi-Newton steps up from a jittered start; the Gaussian of the step with the best bound gives the draws.

    Covariances are a diagonal plus a low rank throughout, so thousands of parameters are no matter. A start that gives no
    usable pair is tried again elsewhere. Draws are there if any step gave a Gaussian, whatever the status.
    """
    from .low_rank import LowRank

    k = len(base)
    memory = memory or max(math.ceil(3 * math.log(max(k, 2))), 5)
    for _ in range(retries):
        x = base + rng.uniform(-jitter, jitter, k)
        value, g = logp_grad(x)
        if not np.isfinite(value) or not np.isfinite(g).all():
            continue
        alpha, S, Y, best, ended, updates, step = np.ones(k), [], [], None, "MAX_ITER_REACHED", 0, -1
        for step in range(steps):
            direction = two_loops(g, S, Y)
            size, new, finite = 1.0, None, False
            while size > 1e-10:
                at = x + size * direction
                v2, g2 = logp_grad(at)
                good = bool(np.isfinite(v2) and np.isfinite(g2).all())
                finite = finite or good
                if good and v2 >= value + 1e-4 * size * (g @ direction):
                    new = at
                    break
                size /= 2
            if new is None:
                ended = "CONVERGED" if finite else "NON_FINITE"
                break
            s, z = new - x, g - g2
            if s @ z >= eps * (z @ z) and s @ z > 0:
                alpha, updates = next_alpha(alpha, s, z), updates + 1
                S, Y = [*S, s][-memory:], [*Y, z][-memory:]
            done = abs(v2 - value) < 1e-10 * max(1.0, abs(value)) or np.max(np.abs(g2)) < 1e-6
            x, value, g = new, v2, g2
            try:
                H = LowRank(alpha, S, Y)
            except np.linalg.LinAlgError:
                H = None
            if H is not None:
                mean, u = x + H.times(g), rng.standard_normal((elbo_draws, k))
                lp = np.array([logp_grad(v)[0] for v in mean + H.moved(u)])
                elbo = float(np.mean(lp - H.logq(u))) if np.isfinite(lp).all() else -np.inf
                if best is None or elbo > best[0]:
                    best = (elbo, mean, H, step)
            if done:
                ended = "CONVERGED"
                break
        if best is None:
            continue
        elbo, mean, H, at_step = best
        u = rng.standard_normal((draws, k))
        made = mean + H.moved(u)
        logp = np.array([logp_grad(v)[0] for v in made])
        chosen = "INVALID_LOGP" if not np.isfinite(logp).any() else "ELBO_ARGMAX_AT_ZERO" if at_step == 0 else "SUCCESS"
        return Path(search_status(updates, step + 1, ended), made, logp, H.logq(u), elbo, step + 1, updates, chosen)
    return Path("INIT_FAILED", np.zeros((0, k)), np.zeros(0), np.zeros(0), -np.inf, 0, 0, "LBFGS_FAILED")


def run_paths(spark: SparkSession, logp_grad: Callable[[np.ndarray], tuple[float, np.ndarray]], base: np.ndarray, *, paths: int = 4, draws_per_path: int = 1000, seed: int = 0, **kw) -> DataFrame:
    """(path, status, chosen, steps, updates, elbo, k, x, logp, logq): one task for each path.

    A path's first row, k = -1 without x, is there whether it has draws or not.
    """
    base = np.asarray(base, dtype=float)

    def run(batches):
        for b in batches:
            for i in b["id"]:
                try:
                    p = pathfinder_path(logp_grad, base, np.random.default_rng([seed, int(i)]), draws=draws_per_path, **kw)
                except np.linalg.LinAlgError:
                    p = Path("PATH_FAILED", np.zeros((0, len(base))), np.zeros(0), np.zeros(0), -np.inf, 0, 0, "PATH_FAILED")
                yield pd.DataFrame({"path": int(i), "status": p.status, "chosen": p.chosen, "steps": p.steps, "updates": p.updates, "elbo": p.elbo, "k": [-1, *range(len(p.draws))], "x": [None, *p.draws], "logp": [None, *p.logp], "logq": [None, *p.logq]})

    return spark.range(paths).repartition(paths).mapInPandas(run, "path long, status string, chosen string, steps int, updates int, elbo double, k int, x array<double>, logp double, logq double")


def fit_pathfinder(spark: SparkSession, logp_grad: Callable[[np.ndarray], tuple[float, np.ndarray]], base: np.ndarray, *, paths: int = 4, draws_per_path: int = 1000, draws: int = 1000, method: str | None = "psis", seed: int = 0, **kw) -> DataFrame:
    """(draw, path, x, logp, logq, ..): paths side by side, then importance resampling over all of them."""
    found = run_paths(spark, logp_grad, base, paths=paths, draws_per_path=draws_per_path, seed=seed, **kw)
    return importance_sampling(found.where("k >= 0").select("path", "status", "k", "x", "logp", "logq"), draws, method=method, seed=seed)


def path_report(paths: list[Path] | DataFrame) -> dict[str, int]:
    """How many paths ended with each status, of paths or of the table of ``run_paths``."""
    if isinstance(paths, DataFrame):
        return {r.status: r["count"] for r in paths.where("k = -1").groupBy("status").count().collect()}
    return dict(Counter(p.status for p in paths))


# --- importance resampling ---------------------------------------------------------------------------------------


def fit_pareto(x: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto sample, by the posterior mean over a grid of profile likelihoods."""
    x = np.sort(x)
    n = len(x)
    m = 30 + int(math.sqrt(n))
    b = 1 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))
    b = b / (3 * x[max(int(n / 4 + 0.5) - 1, 0)]) + 1 / x[-1]
    k = np.log1p(-b[:, None] * x).mean(axis=1)
    profile = n * (np.log(-b / k) - k - 1)
    w = 1 / np.exp(profile - profile[:, None]).sum(axis=1)
    w = np.where(w < 10 * np.finfo(float).eps, 0, w)
    b = float((b * w).sum() / w.sum())
    k = float(np.log1p(-b * x).mean())
    sigma = -k / b
    return (n * k + 5) / (n + 10), sigma


def pareto_smoothed(logw: np.ndarray) -> tuple[np.ndarray, float]:
    """Log weights whose largest are replaced by quantiles of a Pareto tail, and the tail's shape."""
    logw = logw - np.max(logw)
    n = len(logw)
    tail = min(int(0.2 * n), int(3 * math.sqrt(n)))
    if tail < 5:
        return logw, float("inf")
    order = np.argsort(logw)
    cut = logw[order[-tail - 1]]
    over = np.exp(logw[order[-tail:]]) - math.exp(cut)
    if over[-1] - over[0] < 1e-12 or over[0] <= 0:
        return logw, float("inf")
    k, sigma = fit_pareto(over)
    p = (np.arange(tail) + 0.5) / tail
    new = sigma * np.expm1(-k * np.log1p(-p)) / k if abs(k) > 1e-12 else -sigma * np.log1p(-p)
    out = logw.copy()
    out[order[-tail:]] = np.minimum(np.log(new + math.exp(cut)), 0)
    return out, k


def smoothed_tail(rows: DataFrame, n: int) -> dict[int, float]:
    """Smoothed log weights by key of the largest of ``n`` rows (_key, _w): a few times the root of n numbers come to the driver."""
    size = min(int(0.2 * n), int(3 * math.sqrt(n)))
    top = [(r[0], r[1]) for r in rows.select("_w", "_key").orderBy(F.desc("_w"), "_key").limit(size + 1).collect()] if size >= 5 else []
    if len(top) < size + 1 or size < 5:
        return {}
    most, cut = top[0][0], math.exp(top[-1][0] - top[0][0])
    over = np.exp(np.array([w - most for w, _ in top[:-1]][::-1])) - cut
    if over[-1] - over[0] < 1e-12 or over[0] <= 0:
        return {}
    k, sigma = fit_pareto(over)
    p = (np.arange(size) + 0.5) / size
    new = sigma * np.expm1(-k * np.log1p(-p)) / k if abs(k) > 1e-12 else -sigma * np.log1p(-p)
    smooth = np.minimum(np.log(new + cut), 0) + most
    by: dict[int, list[float]] = {}
    for (_, key), w in zip(reversed(top[:-1]), smooth.tolist(), strict=True):
        by.setdefault(key, []).append(w)
    return {key: float(np.mean(w)) for key, w in by.items()}


def importance_sampling(samples: DataFrame, n: int, *, method: str | None = "psis", logp: str = "logp", logq: str = "logq", seed: int = 0) -> DataFrame:
    """``n`` of the rows by their weights exp(logp - logq), with a ``draw`` number.

    psis: smoothed weights, without replacement; psir: smoothed, with replacement; identity: raw weights with
    replacement; None: all rows as they are. Without replacement is the n largest of log weight plus a Gumbel
    variable, and needs n rows of finite weight; with replacement meets n evenly drawn numbers with the cumulative
    weights, block by block. Only the weights of the Pareto tail come to the driver. Rows and seed alone decide: equal rows
    are numbered among themselves, so partitions don't matter.
    """
    if method is None:
        return samples.withColumn("draw", F.monotonically_increasing_id())
    if method not in ("psis", "psir", "identity"):
        raise ValueError(f"method {method!r}")
    raw = F.col(logp) - F.col(logq)
    rows = samples.withColumn("_w", F.when(F.abs(raw) < float("inf"), raw).otherwise(F.lit(float("-inf")))).where(F.col("_w") > float("-inf"))
    rows = rows.where(~F.isnan("_w")).withColumn("_key", F.xxhash64(*samples.columns))
    size, most = rows.agg(F.count(F.lit(1)), F.max("_w")).head()
    if not size:
        raise ValueError("no draw has a finite weight")
    spark = samples.sparkSession
    tail = smoothed_tail(rows, size) if method != "identity" else {}
    if tail:
        new = spark.createDataFrame([*tail.items()], "_key long, _new double")
        rows = rows.join(new, "_key", "left").withColumn("_w", F.coalesce("_new", "_w")).drop("_new")
    if method == "psis":
        if size < n:
            raise ValueError(f"{size} rows of finite weight, fewer than the {n} to draw without replacement")
        rows = rows.withColumn("_same", F.row_number().over(Window.partitionBy("_key").orderBy("_w")))
        u = (F.pmod(F.xxhash64("_key", "_same", F.lit(seed)), F.lit((1 << 53) - 1)) + 1) / float(1 << 53)
        best = rows.withColumn("_g", F.col("_w") - F.log(-F.log(u))).orderBy(F.desc("_g"), "_key").limit(n)
        return best.withColumn("draw", F.monotonically_increasing_id()).drop("_g", "_w", "_key", "_same")
    placed = cumulated(rows.withColumn("_w", F.exp(F.col("_w") - float(most))), "_key", size)
    ends = sorted((r[1], r[0]) for r in placed.groupBy("_b").agg(F.max("_hi")).collect())  # a row a block
    drawn = np.sort(ends[-1][0] * (1 - np.random.default_rng(seed).uniform(size=n)))  # above 0, up to the whole
    block = np.searchsorted([e for e, _ in ends], drawn, side="left")
    draws = spark.createDataFrame([(i, int(ends[j][1]), float(x)) for i, (j, x) in enumerate(zip(block, drawn.tolist(), strict=True))], "draw long, _b long, _x double")
    return draws.join(placed, "_b").where((F.col("_x") > F.col("_lo")) & (F.col("_x") <= F.col("_hi"))).drop("_b", "_x", "_lo", "_hi", "_w", "_key")


def cumulated(rows: DataFrame, key: str, size: int, per_block: int = 100_000) -> DataFrame:
    """``rows`` with _lo and _hi, the running sum of _w before and behind each one, in an order by blocks of a hash.

    A row's _lo is the very number that the row before it has as _hi, also from block to block, so nothing lies between.
    """
    blocks = max(64, size // per_block)
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long"))
    inside = Window.partitionBy("_b").orderBy(key, "_w")
    rows = rows.withColumn("_c", F.sum("_w").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    sums = rows.groupBy("_b").agg(F.max("_c").alias("_s"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_a"))  # over one row a block
    at = rows.withColumn("_p", F.coalesce(F.lag("_c").over(inside), F.lit(0.0))).join(ahead, "_b")
    return at.withColumn("_hi", F.col("_a") + F.col("_c")).withColumn("_lo", F.col("_a") + F.col("_p")).drop("_a", "_c", "_p")


def weighted_resample(df: DataFrame, key: str, logw: str, n: int, *, seed: int = 0) -> DataFrame:
    """Systematic resampling inside Spark: (key, copies) by cumulative weights; for tables of particles too large for the driver."""
    size, top = df.agg(F.count(F.lit(1)), F.max(logw)).head()
    rows = df.select(key, F.exp(F.col(logw) - F.lit(float(top or 0.0))).alias("_w"))
    total = rows.agg(F.sum("_w")).head()[0] or 1.0
    u = float(np.random.default_rng(seed).uniform())
    copies = F.ceil(F.col("_hi") / total * n - u) - F.ceil(F.col("_lo") / total * n - u)
    return cumulated(rows, key, size).select(key, copies.cast("long").alias("copies"))


def effective_size(logw: str):
    w = F.exp(F.col(logw))
    return F.pow(F.sum(w), F.lit(2)) / F.sum(w * w)


# --- particles ---------------------------------------------------------------------------------------------------


def next_temperature(loglik: np.ndarray, now: float, share: float) -> float:
    """The temperature whose step leaves an effective sample of ``share`` of the particles, by bisection."""

    def ess(t: float) -> float:
        w = np.exp((t - now) * (loglik - loglik.max()))
        return float(w.sum() ** 2 / (w * w).sum() / len(w))

    if ess(1.0) >= share:
        return 1.0
    lo, hi = now, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if ess(mid) >= share else (lo, mid)
    return max(lo, now + 1e-8)


def systematic(weights: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return np.searchsorted(np.cumsum(weights), (np.arange(len(weights)) + rng.uniform()) / len(weights)).clip(0, len(weights) - 1)


def fit_smc(spark: SparkSession, prior_draw: Callable[[np.random.Generator], np.ndarray], log_prior: Callable[[np.ndarray], float], log_likelihood: Callable[[np.ndarray], float], *, particles: int = 1000, target_share: float = 0.5, moves: int = 10, leaps: int = 5, step: float = 0.1, seed: int = 0, most: int = 200) -> tuple[np.ndarray, pd.DataFrame]:
    """Adaptive tempered particles with Hamiltonian moves of identity mass; (particles x k, diagnostics by iteration).

    Particles, ``particles`` vectors, live on the driver between moves; the moves of all particles are tasks.
    """
    rng = np.random.default_rng(seed)
    x = np.array([prior_draw(np.random.default_rng([seed, i])) for i in range(particles)])
    now, log_evidence, report = 0.0, 0.0, []
    schema = "id long, x array<double>, ll double, accepted double"

    def gradient(f: Callable, v: np.ndarray, h: float = 1e-5) -> np.ndarray:
        return np.array([(f(v + h * e) - f(v - h * e)) / (2 * h) for e in np.eye(len(v))])

    def mover(t: float, turn: int):
        def density(v):
            return log_prior(v) + (t * log_likelihood(v) if t else 0.0)

        def run(batches):
            for b in batches:
                out = []
                for i, v in zip(b["id"], b["x"], strict=True):
                    own, v, hits = np.random.default_rng([seed, turn, int(i)]), np.array(v, dtype=float), 0
                    at = density(v)
                    for _ in range(moves if turn else 0):
                        p = own.standard_normal(len(v))
                        w, q = v.copy(), p.copy()
                        for _ in range(leaps):
                            q = q + step / 2 * gradient(density, w)
                            w = w + step * q
                            q = q + step / 2 * gradient(density, w)
                        new = density(w)
                        if np.log(own.uniform()) < new - at - 0.5 * (q @ q - p @ p):
                            v, at, hits = w, new, hits + 1
                    out.append((int(i), v.tolist(), float(log_likelihood(v)), hits / max(1, moves)))
                yield pd.DataFrame(out, columns=["id", "x", "ll", "accepted"])

        return run

    def moved(points: np.ndarray, t: float, turn: int) -> pd.DataFrame:
        df = spark.createDataFrame(pd.DataFrame({"id": range(len(points)), "x": [p.tolist() for p in points]}), "id long, x array<double>")
        return df.repartition(spark.sparkContext.defaultParallelism).mapInPandas(mover(t, turn), schema).toPandas().sort_values("id", ignore_index=True)

    got = moved(x, 0.0, 0)
    for turn in range(1, most + 1):
        ll = got["ll"].to_numpy()
        new = next_temperature(ll, now, target_share)
        logw = (new - now) * ll
        gain = float(np.log(np.mean(np.exp(logw - logw.max()))) + logw.max())
        w = np.exp(logw - logw.max())
        ancestors = systematic(w / w.sum(), rng)
        got = moved(np.array([got["x"][i] for i in ancestors]), new, turn)
        log_evidence += gain
        report.append({"iteration": turn, "lambda": new, "loglik_inc": gain, "accepted": float(got["accepted"].mean()), "ess": float(w.sum() ** 2 / (w * w).sum())})
        now = new
        if now >= 1.0:
            break
    diagnostics = pd.DataFrame(report)
    diagnostics.attrs["log_evidence"] = log_evidence
    return np.array(got["x"].tolist()), diagnostics


# --- nested Laplace ----------------------------------------------------------------------------------------------


def fit_inla(grid: dict[str, np.ndarray], log_prior: Callable[[dict], float], latent: Callable[[dict], tuple[np.ndarray, np.ndarray]], log_likelihood: Callable[[dict], Callable]) -> pd.DataFrame:
    """Posterior of a few outer parameters on a grid, the Gaussian latent field integrated out at each point by its mode and curvature."""
    from itertools import product

    from .marginal import laplace_marginal

    rows = []
    for values in product(*grid.values()):
        at = dict(zip(grid, map(float, values), strict=True))
        mu, q = latent(at)
        logp, mode, _ = laplace_marginal(log_likelihood(at), mu, q, start=np.zeros(len(mu)))
        rows.append({**at, "logp": logp + log_prior(at), "mode": mode})
    out = pd.DataFrame(rows)
    w = np.exp(out["logp"] - out["logp"].max())
    return out.assign(weight=w / w.sum())


METHODS = {"laplace": fit_laplace, "dadvi": fit_dadvi, "pathfinder": fit_pathfinder, "inla": fit_inla, "advi": fit_advi, "smc": fit_smc}


def fit(method: str, *args, **kw):
    if method not in METHODS:
        raise ValueError(f"method {method!r}, not one of {sorted(METHODS)}")
    return METHODS[method](*args, **kw)
