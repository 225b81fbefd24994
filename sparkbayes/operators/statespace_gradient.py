"""Likelihoods of state-space models over tables of series, with their gradients by reverse accumulation.

A look at a parameter vector is one pass: each task filters its series side by side, walks the filter backwards for the
derivatives with respect to every matrix, and sends one sum. The chain rule from matrices to
parameters needs no data and is done where the model is built. Several vectors share a pass and its numpy calls, so a Hessian from
differences of exact gradients costs no further one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inference import Target
from .side_by_side import LN_2PI, gathered, inverse, mul, side_by_side, sym, t_
from .statespace import AXES, MATRICES, StateSpace

__all__ = ["SeriesTarget", "Together", "backwards", "filtered", "filtered_together", "gathered", "likelihood_target", "side_by_side", "value_and_gradient", "values_and_gradients"]


class Together:
    """Models of one builder at several points: matrices with a leading axis of points, and one of length one for the series."""

    def __init__(self, models: Sequence[StateSpace]):
        self.m, self.shapes = models[0].m, {k: getattr(models[0], k).shape for k in MATRICES}
        self.values = {k: np.stack([getattr(x, k) for x in models]) for k in MATRICES}
        self.varying = {k for k in MATRICES if len(self.shapes[k]) > AXES[k]}

    def at(self, key: str, t: int) -> np.ndarray:
        value = self.values[key]
        return value[:, None, min(t, value.shape[1] - 1)] if key in self.varying else value[:, None]


def filtered_together(models: Together, ys: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """(log likelihoods by point and series, what the way back needs) of series (series, times, observed); NaN is missing, as is the padding of shorter series.

    A missing value's row of Z, d and y is zero and its variance one, so it adds nothing.
    """
    n_series, n, p = ys.shape
    a, P = models.at("x0", 0), models.at("P0", 0)
    n_points = len(a)
    a, P = np.broadcast_to(a, (n_points, n_series, models.m)), np.broadcast_to(P, (n_points, n_series, models.m, models.m))
    total, kept = np.zeros((n_points, n_series)), []
    for t in range(n):
        there = ~np.isnan(ys[:, t])
        on = there.astype(float)
        Z = models.at("Z", t) * on[:, :, None]
        H = models.at("H", t) * on[:, :, None] * on[:, None, :] + np.eye(p) * (1 - on)[:, :, None]
        v = np.where(there, ys[:, t] - models.at("d", t), 0.0) - mul(Z, a[..., None])[..., 0]
        M = mul(P, t_(Z))
        Si, det = inverse(sym(mul(Z, M) + H))
        w = mul(Si, v[..., None])[..., 0]
        total -= 0.5 * (on.sum(1) * LN_2PI + det + (v * w).sum(-1))
        af, Pf = a + mul(M, w[..., None])[..., 0], sym(P - mul(mul(M, Si), t_(M)))
        kept.append((on, Z, v, M, Si, w, a, P, af, Pf))
        T, R, Q = models.at("T", t), models.at("R", t), models.at("Q", t)
        a, P = models.at("c", t) + mul(T, af[..., None])[..., 0], sym(mul(mul(T, Pf), t_(T)) + R @ Q @ t_(R))
    return total, kept


def backwards(models: Together, kept: list[tuple]) -> dict[str, np.ndarray]:
    """Derivatives of the summed log likelihood at each point with respect to every matrix, in its own shape."""
    out = {k: np.zeros_like(v) for k, v in models.values.items()}

    def add(key: str, t: int, value: np.ndarray) -> None:
        if key in models.varying:
            out[key][:, min(t, out[key].shape[1] - 1)] += value
        else:
            out[key] += value

    if not kept:
        return out
    da, dP = np.zeros(kept[0][6].shape), np.zeros(kept[0][7].shape)  # of the state after the last step: nothing depends on it
    for t in range(len(kept) - 1, -1, -1):
        on, Z, v, M, Si, w, a, P, af, Pf = kept[t]
        T, R, Q = models.at("T", t), models.at("R", t), models.at("Q", t)
        dP = sym(dP)
        add("c", t, da.sum(1))
        add("T", t, t_(da) @ af + 2 * mul(mul(dP, T), Pf).sum(1))
        whole = dP.sum(1)
        add("R", t, 2 * whole @ R[:, 0] @ Q[:, 0])
        add("Q", t, t_(R[:, 0]) @ whole @ R[:, 0])
        daf, dPf = mul(da[..., None, :], T)[..., 0, :], mul(mul(t_(T), dP), T)
        # the update: af = a + M w, Pf = P - M Si M', w = Si v
        dM = daf[..., :, None] * w[..., None, :] - 2 * mul(mul(dPf, M), Si)
        dw = mul(t_(M), daf[..., None])[..., 0]
        dSi = sym(dw[..., :, None] * v[..., None, :] - mul(mul(t_(M), dPf), M))
        dv = mul(Si, dw[..., None])[..., 0] - w
        dS = -0.5 * Si + 0.5 * w[..., :, None] * w[..., None, :] - mul(mul(Si, dSi), Si)
        dZ = -dv[..., :, None] * a[..., None, :] + mul(2 * mul(dS, Z) + t_(dM), P)
        add("d", t, -(dv * on).sum(1))
        add("Z", t, (dZ * on[:, :, None]).sum(1))
        add("H", t, (dS * on[:, :, None] * on[:, None, :]).sum(1))
        da = daf - mul(t_(Z), dv[..., None])[..., 0]
        dP = dPf + mul(mul(t_(Z), dS), Z) + sym(mul(dM, Z))
    out["x0"], out["P0"] = da.sum(1), sym(dP).sum(1)
    return out


def values_and_gradients(models: Together, ys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    total, kept = filtered_together(models, ys)
    return total.sum(1), backwards(models, kept)


def filtered(model: StateSpace, ys: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """``filtered_together`` at one point: log likelihoods by series."""
    total, kept = filtered_together(Together([model]), ys)
    return total[0], kept


def value_and_gradient(model: StateSpace, ys: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    value, grads = values_and_gradients(Together([model]), ys)
    return float(value[0]), {k: v[0] for k, v in grads.items()}


@dataclass
class SeriesTarget:
    """Sums of log likelihood and gradient over a table of ``gathered`` series, for models built from parameters."""

    rows: DataFrame
    build: Callable[[dict[str, float]], StateSpace]
    names: list[str]
    column: str = "ys"

    def models(self, points: list[np.ndarray]) -> list[StateSpace]:
        return [self.build(dict(zip(self.names, np.asarray(x, dtype=float).tolist(), strict=True))) for x in points]

    def sums(self, points: list[np.ndarray], *, gradients: bool = True) -> list[tuple[float, np.ndarray]]:
        """(value, gradient) at each point, in one pass over the series."""
        models, column = self.models(points), self.column

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, together = None, Together(models)
            for batch in batches:
                for _, _, ys in side_by_side(batch.column(column), models[0].p, models[0].m, apart=False, points=len(models)):
                    if gradients:
                        value, grads = values_and_gradients(together, ys)
                        own = np.concatenate([value[:, None], *(grads[k].reshape(len(models), -1) for k in MATRICES)], axis=1).ravel()
                    else:
                        own = filtered_together(together, ys)[0].sum(1)
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], names=["place", "value"])

        got = self.rows.select(column).mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        flat = np.zeros(sum(1 + (sum(getattr(m, k).size for k in MATRICES) if gradients else 0) for m in models))
        for row in got:
            flat[row.place] = row.value
        out, at = [], 0
        for x, model in zip(points, models, strict=True):
            if not gradients:
                out.append((float(flat[at]), np.zeros(0)))
                at += 1
                continue
            value, at, grads = float(flat[at]), at + 1, {}
            for k in MATRICES:
                size = getattr(model, k).size
                grads[k], at = flat[at : at + size].reshape(getattr(model, k).shape), at + size
            out.append((value, self.to_parameters(np.asarray(x, dtype=float), grads)))
        return out

    def to_parameters(self, x: np.ndarray, grads: dict[str, np.ndarray], h: float = 1e-6) -> np.ndarray:
        """The chain rule: how each parameter moves the matrices, by central differences of the builder alone."""
        steps = [h * max(1.0, abs(v)) for v in x]
        sides = [self.models([x + s * e, x - s * e]) for s, e in zip(steps, np.eye(len(x)), strict=True)]
        return np.array([sum(float((grads[k] * (getattr(up, k) - getattr(down, k))).sum()) for k in MATRICES) / (2 * s) for (up, down), s in zip(sides, steps, strict=True)])


def likelihood_target(rows: DataFrame, build: Callable[[dict[str, float]], StateSpace], names: Sequence[str], log_prior: Callable[[np.ndarray], float] | None = None, *, h: float = 1e-4) -> Target:
    """A target for any optimizer: exact values and gradients, Hessians from differences of gradients in the same pass."""
    series, prior = SeriesTarget(rows, build, [*names]), log_prior or (lambda x: 0.0)

    def of_prior(x: np.ndarray) -> tuple[float, np.ndarray]:
        e = np.eye(len(x)) * 1e-6
        return prior(x), np.array([(prior(x + d) - prior(x - d)) / 2e-6 for d in e])

    def many(points: list[np.ndarray]):
        k, each = len(names), []
        for x in points:
            x = np.asarray(x, dtype=float)
            each += [x, *(x + s * h * e for e in np.eye(k) for s in (1, -1))]
        found = [(v + p, g + q) for (v, g), (p, q) in zip(series.sums(each), map(of_prior, each), strict=True)]
        out = []
        for i in range(len(points)):
            own = found[i * (2 * k + 1) : (i + 1) * (2 * k + 1)]
            hess = np.array([(own[1 + 2 * j][1] - own[2 + 2 * j][1]) / (2 * h) for j in range(k)])
            out.append((own[0][0], own[0][1], (hess + hess.T) / 2))
        return out

    return Target([*names], lambda x: many([x])[0], many=many)
