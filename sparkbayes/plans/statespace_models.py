"""Builders of state-space models: level and trend, seasons, cycles, regressions, ARIMA, VARMA, exponential smoothing, factors.

Components add up by ``+``: states stack block-diagonally, observation equations join by the observed series' names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np

from ..operators.statespace import StateSpace


def block(*parts: np.ndarray) -> np.ndarray:
    parts = [np.atleast_2d(p) for p in parts]
    out = np.zeros((sum(p.shape[0] for p in parts), sum(p.shape[1] for p in parts)))
    i = j = 0
    for p in parts:
        out[i : i + p.shape[0], j : j + p.shape[1]] = p
        i, j = i + p.shape[0], j + p.shape[1]
    return out


def block_time(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.ndim == 2 and b.ndim == 2:
        return block(a, b)
    n = max(len(x) for x in (a, b) if x.ndim == 3)
    return np.stack([block(a[min(t, len(a) - 1)] if a.ndim == 3 else a, b[min(t, len(b) - 1)] if b.ndim == 3 else b) for t in range(n)])


def lyapunov(T: np.ndarray, V: np.ndarray) -> np.ndarray:
    """P with P = T P T' + V."""
    m = len(T)
    return np.linalg.solve(np.eye(m * m) - np.kron(T, T), V.ravel()).reshape(m, m)


def companion(coefficients: np.ndarray) -> np.ndarray:
    k = len(coefficients)
    out = np.eye(k, k=-1)
    out[0] = coefficients
    return out


@dataclass(frozen=True)
class Component:
    """Part of a model: its matrices without measurement noise of others; ``build`` makes the whole."""

    name: str
    T: np.ndarray
    Z: np.ndarray
    R: np.ndarray
    Q: np.ndarray
    states: tuple[str, ...]
    observed: tuple[str, ...] = ("y",)
    shocks: tuple[str, ...] = ()
    c: np.ndarray | None = None
    H: np.ndarray | None = None
    x0: np.ndarray | None = None
    P0: np.ndarray | None = None
    parts: tuple[tuple[str, int, int], ...] = ()

    @property
    def m(self) -> int:
        return self.T.shape[-1]

    def slices(self) -> tuple[tuple[str, int, int], ...]:
        return self.parts or ((self.name, 0, self.m),)

    def __add__(self, other: Component) -> Component:
        names = [n for n, _, _ in self.slices() + other.slices()]
        if len({*names}) < len(names):
            raise ValueError(f"components of the same name: {sorted(n for n in {*names} if names.count(n) > 1)}")
        observed = tuple(dict.fromkeys(self.observed + other.observed))

        def spread(x: Component) -> np.ndarray:
            z = np.zeros((*x.Z.shape[:-2], len(observed), x.m))
            for i, o in enumerate(x.observed):
                z[..., observed.index(o), :] = x.Z[..., i, :]
            return z

        def noise(x: Component) -> np.ndarray:
            h, at = np.zeros((len(observed), len(observed))), [observed.index(o) for o in x.observed]
            h[np.ix_(at, at)] = 0 if x.H is None else x.H
            return h

        a, b = spread(self), spread(other)
        n = max([len(x) for x in (a, b) if x.ndim == 3], default=0)
        widen = lambda z: z if z.ndim == 3 or not n else np.broadcast_to(z, (n, *z.shape))
        fill = lambda x, k, zero: zero if getattr(x, k) is None else getattr(x, k)
        return Component(
            name=f"{self.name}+{other.name}", T=block_time(self.T, other.T), Z=np.concatenate([widen(a), widen(b)], axis=-1), R=block(self.R, other.R), Q=block(self.Q, other.Q),
            states=self.states + other.states, observed=observed, shocks=self.shocks + other.shocks, c=np.concatenate([fill(x, "c", np.zeros(x.m)) for x in (self, other)]), H=noise(self) + noise(other),
            x0=np.concatenate([fill(x, "x0", np.zeros(x.m)) for x in (self, other)]), P0=block(*[fill(x, "P0", np.eye(x.m) * 1e6) for x in (self, other)]),
            parts=self.slices() + tuple((n, lo + self.m, hi + self.m) for n, lo, hi in other.slices()),
        )

    def build(self, *, x0=None, P0=None) -> StateSpace:
        p = len(self.observed)
        return StateSpace(
            T=self.T, Z=self.Z, R=self.R, Q=self.Q, H=np.zeros((p, p)) if self.H is None else self.H, c=self.c, states=self.states, observed=self.observed, shocks=self.shocks, name=self.name,
            x0=np.zeros(self.m) if self.x0 is None and x0 is None else self.x0 if x0 is None else x0, P0=(np.eye(self.m) * 1e6 if self.P0 is None else self.P0) if P0 is None else P0, extra={"components": self.slices()},
        )


def extract(model: StateSpace, states: np.ndarray) -> dict[str, np.ndarray]:
    """What each component adds to the observations: time x p for each."""
    out = {}
    for name, lo, hi in model.extra["components"]:
        if hi > lo:
            out[name] = np.stack([model.at("Z", t)[:, lo:hi] @ x[lo:hi] for t, x in enumerate(states)])
    return out


def level_trend(order: int | list[int] = 2, sigmas: list[float] | float = 1.0, *, innovations: list[int] | None = None, observed: str = "y", name: str = "trend") -> Component:
    """Level, slope, acceleration ..: each state adds up the next. order: how many, or a mask of those that are there."""
    mask = [1] * order if isinstance(order, int) else [*order]
    full = np.triu(np.ones((len(mask), len(mask))))
    keep = [i for i, x in enumerate(mask) if x]
    T = np.triu(np.where(np.eye(len(mask), k=1) + np.eye(len(mask)) > 0, 1.0, full))[np.ix_(keep, keep)]
    moved = [i for i, x in enumerate(innovations if innovations is not None else [1] * len(keep)) if x]
    sd = np.broadcast_to(np.asarray(sigmas, dtype=float), (len(moved),))
    names = [("level", "trend", "acceleration", "jerk", "snap", "crackle", "pop")[i] for i in keep]
    return Component(name, T, np.eye(1, len(keep)), np.eye(len(keep))[:, moved], np.diag(sd**2), tuple(names), (observed,), tuple(f"{names[i]}_innovation" for i in moved))


def autoregressive(coefficients: list[float], sigma: float = 1.0, *, lags: list[int] | None = None, observed: str = "y", name: str = "ar") -> Component:
    """lags: which lags the coefficients are of (1 to their number if not given)."""
    lags = lags or [*range(1, len(coefficients) + 1)]
    full = np.zeros(max(lags))
    full[[i - 1 for i in lags]] = coefficients
    k = len(full)
    return Component(name, companion(full), np.eye(1, k), np.eye(k, 1), np.array([[sigma**2]]), tuple(f"L{i + 1}.{name}" for i in range(k)), (observed,), (f"{name}_innovation",))


def rotation(angle: float, damp: float = 1.0) -> np.ndarray:
    c, s = math.cos(angle), math.sin(angle)
    return damp * np.array([[c, s], [-s, c]])


def cycle(length: float, sigma: float = 0.0, *, damping: float = 1.0, observed: str = "y", name: str = "cycle") -> Component:
    moved = sigma > 0
    return Component(name, rotation(2 * math.pi / length, damping), np.array([[1.0, 0.0]]), np.eye(2) if moved else np.zeros((2, 0)), np.eye(2) * sigma**2 if moved else np.zeros((0, 0)), (f"{name}_cos", f"{name}_sin"), (observed,), (f"{name}_cos_innovation", f"{name}_sin_innovation") if moved else ())


def time_seasonality(length: int, sigma: float = 0.0, *, duration: int = 1, remove_first: bool = True, start: int = 0, observed: str = "y", name: str = "season") -> Component:
    """Seasonal dummies that sum to zero, or with ``remove_first=False`` a rotation of one effect for each season.

    duration: steps that each season lasts; the states then turn at the last step of each season only.
    """
    k = length - 1 if remove_first else length
    if remove_first:
        turn = np.eye(k, k=-1)
        turn[0] = -1.0
    else:
        turn = np.roll(np.eye(k), 1, axis=1)
    T = turn if duration == 1 else np.stack([turn if (t + 1) % duration == 0 else np.eye(k) for t in range(duration * length * 64)])
    moved = sigma > 0
    x0 = np.zeros(k)
    first = np.linalg.matrix_power(turn, start)
    return Component(name, T, (np.eye(1, k) @ first), np.eye(k, 1) if moved else np.zeros((k, 0)), np.array([[sigma**2]]) if moved else np.zeros((0, 0)), tuple(f"{name}_{i}" for i in range(k)), (observed,), (f"{name}_innovation",) if moved else (), x0=x0)


def frequency_seasonality(length: float, n: int | None = None, sigma: float = 0.0, *, observed: str = "y", name: str = "frequency") -> Component:
    """Harmonics 1 .. n of a season of any length; the sine of the last one says nothing where its period is two steps."""
    n = n or int(length // 2)
    T = block(*[rotation(2 * math.pi * (j + 1) / length) for j in range(n)])
    Z = np.tile([[1.0, 0.0]], (1, n))
    moved = sigma > 0
    names = tuple(f"{kind}_{j}_{name}" for j in range(n) for kind in ("Cos", "Sin"))
    return Component(name, T, Z, np.eye(2 * n) if moved else np.zeros((2 * n, 0)), np.eye(2 * n) * sigma**2 if moved else np.zeros((0, 0)), names, (observed,), names if moved else ())


def regression(X: np.ndarray, sigma: float | list[float] = 0.0, *, names: list[str] | None = None, observed: str = "y", name: str = "regression") -> Component:
    """Coefficients as states, constant or random walks; the data are the observation matrix, row by row."""
    X = np.asarray(X, dtype=float)
    k = X.shape[1]
    sd = np.broadcast_to(np.asarray(sigma, dtype=float), (k,))
    moved = [i for i in range(k) if sd[i] > 0]
    names = tuple(names or (f"beta_{i}" for i in range(k)))
    return Component(name, np.eye(k), X[:, None, :], np.eye(k)[:, moved], np.diag(sd[moved] ** 2), names, (observed,), tuple(f"{names[i]}_innovation" for i in moved))


def measurement_error(sigma: float | list[float], *, observed: str | list[str] = "y", name: str = "error") -> Component:
    names = (observed,) if isinstance(observed, str) else tuple(observed)
    sd = np.broadcast_to(np.asarray(sigma, dtype=float), (len(names),))
    return Component(name, np.zeros((0, 0)), np.zeros((len(names), 0)), np.zeros((0, 0)), np.zeros((0, 0)), (), names, (), H=np.diag(sd**2), x0=np.zeros(0), P0=np.zeros((0, 0)))


def polynomial(coefficients: list[float], seasonal: list[float], s: int, sign: float) -> np.ndarray:
    """Lags 1 .. of (1 + sign*a L ..)(1 + sign*A L^s ..) - 1, with the sign taken out again."""
    a, b = np.zeros(len(coefficients) + 1), np.zeros(len(seasonal) * s + 1)
    a[0] = b[0] = 1
    a[1:] = sign * np.asarray(coefficients, dtype=float)
    for i, v in enumerate(seasonal):
        b[(i + 1) * s] = sign * v
    return sign * np.convolve(a, b)[1:]


def sarimax(order: tuple[int, int, int], *, ar=(), ma=(), seasonal_order: tuple[int, int, int, int] = (0, 0, 0, 0), seasonal_ar=(), seasonal_ma=(), sigma: float = 1.0, exog: np.ndarray | None = None, beta=(), measurement_sigma: float = 0.0, stationary_initialization: bool = True) -> StateSpace:
    """ARIMA with seasons in Harvey's form; differences are extra states, exogenous data shift the observation."""
    p, d, q = order
    P, D, Q, s = seasonal_order
    if len(ar) != p or len(ma) != q or len(seasonal_ar) != P or len(seasonal_ma) != Q:
        raise ValueError("as many coefficients as the orders say")
    if P and p >= s or Q and q >= s:
        raise ValueError("regular and seasonal lags overlap")
    phi, theta = polynomial([*ar], [*seasonal_ar], max(s, 1), -1.0), polynomial([*ma], [*seasonal_ma], max(s, 1), 1.0)
    k = max(len(phi), len(theta) + 1, 1)
    arma = np.eye(k, k=1)
    arma[: len(phi), 0] += phi
    R = np.zeros((k, 1))
    R[0] = 1
    R[1 : len(theta) + 1, 0] = theta
    n = d + D * s
    # Differences: d running sums, then D blocks that keep the last s values.
    T, Z = np.zeros((n + k, n + k)), np.zeros((1, n + k))
    T[n:, n:] = arma
    T[:d, :d] = np.triu(np.ones((d, d)))
    Z[0, :d] = 1
    Z[0, n] = 1
    for i in range(D):
        at = d + i * s
        T[at + 1 : at + s, at : at + s - 1] = np.eye(s - 1)
        for j in range(i + 1):
            T[d + j * s, at + s - 1] = 1
        T[at, n] = 1
        T[:d, at + s - 1] = 1
        Z[0, at + s - 1] = 1
    T[:d, n] = 1
    Rf = np.vstack([np.zeros((n, 1)), R])
    V = R @ R.T * sigma**2
    stationary = stationary_initialization and np.max(np.abs(np.linalg.eigvals(arma)), initial=0) < 1 - 1e-9
    P0 = block(np.eye(n) * 1e6, lyapunov(arma, V) if stationary else np.eye(k) * 1e6) if n else lyapunov(arma, V) if stationary else np.eye(k) * 1e6
    shift = None if exog is None else (np.asarray(exog, dtype=float) @ np.asarray(beta, dtype=float))[:, None]
    return StateSpace(T=T, Z=Z, R=Rf, Q=np.array([[sigma**2]]), H=np.array([[measurement_sigma**2]]), x0=np.zeros(n + k), P0=P0, d=shift, name=f"sarimax{order}{seasonal_order}", observed=("y",), shocks=("innovation",))


def varmax(ar: list[np.ndarray], ma: list[np.ndarray] = (), *, cov: np.ndarray, exog: np.ndarray | None = None, beta: np.ndarray | None = None, measurement_cov: np.ndarray | None = None, names: list[str] | None = None, stationary_initialization: bool = True) -> StateSpace:
    """Vector ARMA: states are p lags of the series and q of the shocks; exogenous data shift the observation by X beta."""
    ar, ma, cov = [np.atleast_2d(a) for a in ar], [np.atleast_2d(a) for a in ma], np.atleast_2d(cov)
    k, p, q = len(cov), max(len(ar), 1), len(ma)
    m = k * (p + q)
    T = np.zeros((m, m))
    for i, a in enumerate(ar):
        T[:k, i * k : (i + 1) * k] = a
    for i, a in enumerate(ma):
        T[:k, (p + i) * k : (p + i + 1) * k] = a
    for i in range(1, p):
        T[i * k : (i + 1) * k, (i - 1) * k : i * k] = np.eye(k)
    for i in range(1, q):
        T[(p + i) * k : (p + i + 1) * k, (p + i - 1) * k : (p + i) * k] = np.eye(k)
    R = np.zeros((m, k))
    R[:k] = np.eye(k)
    if q:
        R[p * k : (p + 1) * k] = np.eye(k)
    P0 = lyapunov(T, R @ cov @ R.T) if stationary_initialization else np.eye(m) * 1e6
    shift = None if exog is None else np.asarray(exog, dtype=float) @ np.atleast_2d(beta)
    return StateSpace(T=T, Z=np.eye(k, m), R=R, Q=cov, H=np.zeros((k, k)) if measurement_cov is None else measurement_cov, x0=np.zeros(m), P0=P0, d=shift, name=f"varmax({len(ar)},{q})", observed=tuple(names or (f"y_{i}" for i in range(k))))


def ets(order: tuple[str, str, str] = ("A", "N", "N"), *, alpha: float, beta: float = 0.0, gamma: float = 0.0, phi: float = 1.0, seasonal_periods: int = 0, sigma: float = 1.0, transformed: bool = False, level0: float = 0.0, P0: np.ndarray | None = None) -> StateSpace:
    """Exponential smoothing with additive errors: innovation, level, [trend], [seasons].

    transformed: beta and gamma are used as they are; otherwise they stand for alpha * beta and (1 - alpha) * gamma.
    """
    error, trend, season = order
    if error != "A" or trend not in ("N", "A", "Ad") or season not in ("N", "A"):
        raise ValueError("order is one of (A), (N, A, Ad), (N, A)")
    b = beta if transformed else alpha * beta
    g = gamma if transformed else (1 - alpha) * gamma
    damp = phi if trend == "Ad" else 1.0
    names, s = ["innovation", "level"], seasonal_periods if season == "A" else 0
    if trend != "N":
        names.append("trend")
    names += [f"season_{i}" for i in range(s)]
    m, has = len(names), trend != "N"
    T, R, Z = np.zeros((m, m)), np.zeros((m, 1)), np.zeros((1, m))
    T[1, 1] = 1
    R[0], R[1], Z[0, 0], Z[0, 1] = 1 - alpha - (g if s else 0), alpha, 1, 1
    if has:
        T[1, 2] = T[2, 2] = damp
        R[2] = b
    if s:
        at = 2 + has
        T[at, m - 1] = 1
        T[at + 1 : m, at : m - 1] = np.eye(s - 1)
        R[at] = g
        Z[0, at] = 1
    x0 = np.zeros(m)
    x0[1] = level0
    return StateSpace(T=T, Z=Z, R=R, Q=np.array([[sigma**2]]), H=np.zeros((1, 1)), x0=x0, P0=np.eye(m) * 1e6 if P0 is None else P0, states=tuple(names), observed=("y",), shocks=("innovation",), name=f"ets{order}")


def dynamic_factor(loadings: np.ndarray, ar: list[np.ndarray], *, error_ar: list[np.ndarray] = (), error_cov: np.ndarray | None = None, measurement_cov: np.ndarray | None = None, exog: np.ndarray | None = None, exog_sigma: float = 0.0) -> StateSpace:
    """y = loadings f + u: factors are a vector autoregression with unit shocks, errors are white or autoregressive; exogenous coefficients are states."""
    L = np.atleast_2d(loadings)
    p, k = L.shape
    ar = [np.atleast_2d(a) for a in ar] or [np.zeros((k, k))]
    factor = varmax(ar, cov=np.eye(k))
    T, R, Q, Z = factor.T, factor.R, np.eye(k), np.hstack([L, np.zeros((p, factor.m - k))])
    P0, H = factor.P0, np.zeros((p, p)) if measurement_cov is None else np.asarray(measurement_cov, dtype=float)
    cov = np.eye(p) if error_cov is None else np.atleast_2d(error_cov)
    if len(error_ar):
        noise = varmax([np.atleast_2d(a) for a in error_ar], cov=cov)
        T, R, Q, Z, P0 = block(T, noise.T), block(R, noise.R), block(Q, cov), np.hstack([Z, np.eye(p, noise.m)]), block(P0, noise.P0)
    else:
        H = H + cov
    if exog is not None:
        X = np.asarray(exog, dtype=float)
        n = X.shape[1] * p
        rows = np.stack([np.kron(np.eye(p), x[None, :]) for x in X])
        T, P0 = block(T, np.eye(n)), block(P0, np.eye(n) * 1e6)
        R, Q = (block(R, np.eye(n)), block(Q, np.eye(n) * exog_sigma**2)) if exog_sigma > 0 else (np.vstack([R, np.zeros((n, R.shape[1]))]), Q)
        Z = np.concatenate([np.broadcast_to(Z, (len(X), *Z.shape)), rows], axis=-1)
    return StateSpace(T=T, Z=Z, R=R, Q=Q, H=H, x0=np.zeros(len(T)), P0=P0, name="dynamic_factor")


def total(components: list[Component]) -> Component:
    return reduce(lambda a, b: a + b, components)


def renamed(component: Component, name: str) -> Component:
    return replace(component, name=name, parts=())
