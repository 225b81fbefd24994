"""Filters and smoothers of many series at once: one numpy step moves all series of a batch on by one time.

A batch is (series, times, observed), shorter series padded at their end; batches are bounded by their numbers, not by their
series. Covariances don't depend on the values seen, so series without missing values that share a model share them, too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LN_2PI = math.log(2 * math.pi)
SIDE = 1024  # series in a batch, at most
CELLS = 1 << 20  # numbers of a batch's covariances, where it holds more than one series


def sym(a: np.ndarray) -> np.ndarray:
    return (a + np.swapaxes(a, -1, -2)) / 2


def t_(a: np.ndarray) -> np.ndarray:
    return np.swapaxes(a, -1, -2)


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix products of stacks; short sums are written out, as a call for each small matrix would cost more."""
    k = a.shape[-1]
    if k > 4:
        return a @ b
    return sum((a[..., i : i + 1] * b[..., i : i + 1, :] for i in range(1, k)), a[..., :1] * b[..., :1, :])


def on(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Matrices times vectors."""
    return mul(a, x[..., None])[..., 0]


def inverse(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverses of covariances, and the logs of their determinants."""
    if a.shape[-1] > 1:
        return np.linalg.inv(a), np.linalg.slogdet(a)[1]
    if not a.all():
        raise np.linalg.LinAlgError("Singular matrix")
    return 1 / a, np.log(a[..., 0, 0])


# --- tables -----------------------------------------------------------------------------------------------------------


def gathered(df: DataFrame, series: str, time: Sequence[str], observed: Sequence[str]) -> DataFrame:
    """(series, ys): each series' observations in order of time, unknown times last, one after another. Keep it stored if it is read again."""
    order = [c.alias(f"_{k}{i}") for i, t in enumerate(time) for k, c in (("n", F.col(t).isNull()), ("t", F.col(t)))]
    rows = F.array_sort(F.collect_list(F.struct(*order, F.array(*[F.col(o).cast("double") for o in observed]).alias("_y"))))
    return df.groupBy(series).agg(rows.alias("_r")).select(series, F.flatten(F.transform("_r", lambda x: x["_y"])).alias("ys"))


def batches(size: np.ndarray, apart: np.ndarray, weight: int) -> Iterator[np.ndarray]:
    """Places of series of about equal length, those of ``apart`` by themselves; each time of a series counts ``weight`` numbers."""
    order = np.lexsort((size, apart))
    lo = 0
    while lo < len(order):
        hi = lo + min(SIDE, int(np.count_nonzero(apart[order[lo:]] == apart[order[lo]])))
        while hi - lo > 1 and (hi - lo) * int(size[order[hi - 1]]) * weight > CELLS:
            hi = lo + (hi - lo) // 2
        yield order[lo:hi]
        lo = hi


def side_by_side(lists: pa.Array, p: int, m: int = 1, *, apart: bool = True, points: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, lengths, series x times x p) of batches of a column of ``gathered`` series; with ``apart``, series without missing values are by themselves."""
    ends, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
    ends = ends - ends[0]
    size = np.diff(ends) // p
    holes = np.concatenate([[0], np.cumsum(np.isnan(flat))])[ends]
    for some in batches(size, (np.diff(holes) > 0) & apart, points * max(m, p) ** 2):
        out = np.full((len(some), int(size[some].max()), p), np.nan)
        for i, s in enumerate(some):
            out[i, : size[s]] = flat[ends[s] : ends[s + 1]].reshape(-1, p)
        yield some, size[some], out


def lists(x: np.ndarray) -> pa.Array:
    """The matrices of a stack as flat lists."""
    flat = np.ascontiguousarray(x, dtype=float).reshape(len(x), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


def mapped(df: DataFrame, series: str, p: int, m: int, kernel: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, list]], schema: str) -> DataFrame:
    """``kernel(lengths, ys)`` on each batch of ``gathered`` series: which series each row is of, and the columns of ``schema``."""
    names = [series, *(x.split()[0] for x in schema.split(", "))]

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in got:
            for places, sizes, ys in side_by_side(batch.column("ys"), p, m):
                rows, columns = kernel(sizes, ys)
                yield pa.RecordBatch.from_arrays([batch.column(series).take(pa.array(places[rows])), *columns], names=names)

    return df.mapInArrow(run, f"`{series}` {dict(df.dtypes)[series]}, {schema}")


# --- kernels ----------------------------------------------------------------------------------------------------------


class Stacked:
    """Models of one shape, one for each series of a batch: what they share is kept once."""

    def __init__(self, models: Sequence[Any], keys: Sequence[str]):
        self.m, self.p, self.axes, self.values = models[0].m, models[0].p, {}, {}
        times = max([len(getattr(x, k)) for x in models for k in keys if k not in ("x0", "P0") and self.varies(x, k)], default=0)
        self.time_varying = times > 0
        for k in keys:
            first = getattr(models[0], k)
            if all(getattr(x, k) is first or np.array_equal(getattr(x, k), first) for x in models):
                self.values[k], self.axes[k] = first, (False, self.varies(models[0], k))
            elif any(self.varies(x, k) for x in models):
                self.values[k], self.axes[k] = np.stack([self.stretched(x, k, times) for x in models]), (True, True)
            else:
                self.values[k], self.axes[k] = np.stack([getattr(x, k) for x in models]), (True, False)
        self.x0, self.P0, self.alike = self.values["x0"], self.values["P0"], not any(a for a, _ in self.axes.values())

    @staticmethod
    def varies(model: Any, k: str) -> bool:
        return k not in ("x0", "P0") and getattr(model, k).ndim > (1 if k in ("c", "d") else 2)

    @classmethod
    def stretched(cls, model: Any, k: str, times: int) -> np.ndarray:
        value = getattr(model, k)
        return value[np.minimum(np.arange(times), len(value) - 1)] if cls.varies(model, k) else np.broadcast_to(value, (times, *value.shape))

    def at(self, k: str, t: int) -> np.ndarray:
        value, (own, varies) = self.values[k], self.axes[k]
        if not varies:
            return value
        return value[:, min(t, value.shape[1] - 1)] if own else value[min(t, len(value) - 1)]


def joint_step(a, P, y, there, d, Z, H):
    """Joseph-form update with the values that are there. A missing one's row of Z and y is zero and its variance one, so it adds nothing."""
    seen = there.astype(float)
    Z = Z * seen[:, :, None]
    noise = H * seen[:, :, None] * seen[:, None, :]
    v = np.where(there, y - d, 0.0) - on(Z, a)
    M = mul(P, t_(Z))
    Si, det = inverse(sym(mul(Z, M) + noise + np.eye(len(seen[0])) * (1 - seen)[:, :, None]))
    K = mul(M, Si)
    J = np.eye(a.shape[-1]) - mul(K, Z)
    out = sym(mul(mul(J, P), t_(J)) + mul(mul(K, noise), t_(K)))
    return a + on(K, v), out, -0.5 * (seen.sum(1) * LN_2PI + det + (v * on(Si, v)).sum(1))


def univariate_step(a, P, y, there, d, Z, H):
    """One observed value after another; H's diagonal only. Values without variance say nothing."""
    ll = 0.0
    for i in range(there.shape[1]):
        z = Z[..., i, :]
        g = on(P, z)
        f = (g * z).sum(-1) + H[..., i, i]
        ok = there[:, i] & (f > 1e-12)
        f = np.where(ok, f, 1.0)
        K, v = np.where(ok[:, None], g / f[:, None], 0.0), np.where(ok, y[:, i] - d[..., i] - (a * z).sum(-1), 0.0)
        a = a + K * v[:, None]
        P = sym(P - K[:, :, None] * K[:, None, :] * f[:, None, None])
        ll = ll + np.where(ok, -0.5 * (LN_2PI + np.log(f) + v * v / f), 0.0)
    return a, P, ll


def root_step(a, S, y, there, d, Z, H):
    """Update of a Cholesky factor S of the covariance by one orthogonal triangularisation."""
    seen, k = there.astype(float), there.shape[1]
    Z = Z * seen[:, :, None]
    Hr = np.linalg.cholesky(H * seen[:, :, None] * seen[:, None, :] + np.eye(k) * (1 - seen)[:, :, None])
    ZS = mul(Z, S)
    joint = np.zeros((len(ZS), k + S.shape[-1], k + S.shape[-1]))
    joint[:, :k, :k], joint[:, :k, k:], joint[:, k:, k:] = Hr, ZS, S
    tri = t_(np.linalg.qr(t_(joint), mode="r"))
    tri = tri * np.where(np.diagonal(tri, axis1=-2, axis2=-1) < 0, -1.0, 1.0)[:, None, :]
    Fr = tri[:, :k, :k]
    v = np.where(there, y - d, 0.0) - on(Z, a)
    u = v / Fr[:, :, 0] if k == 1 else np.linalg.solve(Fr, v[..., None])[..., 0]
    return a + on(tri[:, k:, :k], u), tri[:, k:, k:], -0.5 * (seen.sum(1) * LN_2PI + 2 * np.log(np.abs(np.diagonal(Fr, axis1=-2, axis2=-1))).sum(1) + (u * u).sum(1))


STEPS: dict[str, Callable] = {"standard": joint_step, "univariate": univariate_step, "cholesky": root_step, "convergent": joint_step}


def roots(a: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh(sym(a))
    return v * np.sqrt(np.clip(w, 0, None))[..., None, :]


def filtered(model: Any, sizes: np.ndarray, ys: np.ndarray, kind: str = "standard", *, tol: float = 1e-10, keep: bool = True) -> dict[str, np.ndarray]:
    """What ``statespace.kalman`` gives for one series, by name, for all of a batch: series x times x ..., covariances with one series if all share them.

    model: one for all series, or ``Stacked`` ones. ``loglike`` is zero in the padding, where the rest means nothing. Without
    ``keep`` only ``loglike`` is kept, summed over each series.
    """
    if kind not in STEPS:
        raise ValueError(f"filter {kind!r}, not one of {sorted(STEPS)}")
    n_series, n, p = ys.shape
    inside = np.arange(n)[None] < sizes[:, None]
    whole = not np.isnan(ys[inside]).any()
    if kind == "convergent" and (model.time_varying or not whole or not getattr(model, "alike", True)):
        raise ValueError("the convergent filter needs constant matrices and no missing values")
    shared = whole and getattr(model, "alike", True)
    there = np.ones((1, n, p), bool) if whole else ~np.isnan(ys)
    y = np.where(inside[:, :, None], ys, 0.0) if whole else ys
    a, P, root = np.broadcast_to(model.x0, (n_series, model.m)), np.asarray(model.P0), kind == "cholesky"
    P = P if P.ndim == 3 else P[None]
    if root:
        P = np.linalg.cholesky(P + 1e-300 * np.eye(model.m)) if np.linalg.eigvalsh(P)[..., 0].min() > 0 else roots(P)
    kept: dict[str, list] = {k: [] for k in ("filtered", "filtered_cov", "predicted", "predicted_cov", "observed", "observed_cov")}
    total, lls, steady = np.zeros(n_series), [], None
    for t in range(n):
        d, Z, H, c, T, R, Q = (model.at(k, t) for k in ("d", "Z", "H", "c", "T", "R", "Q"))
        if steady is None:
            af, Pf, ll = STEPS[kind](a, P, y[:, t], there[:, t], d, Z, H)
        else:
            K, Si, det, Pf = steady
            v = y[:, t] - d - on(Z, a)
            af, ll = a + on(K, v), -0.5 * (p * LN_2PI + det + (v * on(Si, v)).sum(1))
        ll = np.where(inside[:, t], ll, 0.0)
        if keep:
            cov = mul(P, t_(P)) if root else P
            made = (af, mul(Pf, t_(Pf)) if root else Pf, a, cov, d + on(Z, a), mul(mul(Z, cov), t_(Z)) + H)
            for (name, to), x in zip(kept.items(), made, strict=True):
                to.append(np.broadcast_to(x, (1 if shared and name.endswith("_cov") else n_series, *x.shape[1:])))
            lls.append(ll)
        else:
            total += ll
        a = c + on(T, af)
        if root:
            wide = mul(R, roots(Q))
            wide = np.concatenate([mul(T, Pf), np.broadcast_to(wide, (len(Pf), *wide.shape[-2:]))], axis=-1)
            tri = t_(np.linalg.qr(t_(wide), mode="r"))
            P = np.zeros((len(tri), model.m, model.m))
            P[:, :, : tri.shape[-1]] = tri
        elif steady is None:
            new = sym(mul(mul(T, Pf), t_(T)) + mul(mul(R, Q), t_(R)))
            if kind == "convergent" and np.linalg.norm(new - P) < tol:
                Si, det = inverse(sym(mul(mul(Z, new), t_(Z)) + H))
                steady = (mul(mul(new, t_(Z)), Si), Si, det, joint_step(a[:1], new, y[:1, t], there[:, t], d, Z, H)[1])
            P = new
    if not keep:
        return {"loglike": total}
    return {k: np.stack(v, axis=1) for k, v in kept.items()} | {"loglike": np.stack(lls, axis=1)}


def gains(cov: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Solutions x of cov x = to; the least ones where cov is singular."""
    if cov.shape[-1] == 1:
        return np.where(cov > 0, to / np.where(cov > 0, cov, 1.0), 0.0)
    cov, to = np.broadcast_arrays(cov, to)
    try:
        out = np.linalg.solve(cov, to)
        good = np.isfinite(out).all((-1, -2)) & (np.abs(mul(cov, out) - to).max((-1, -2)) <= 1e-9 * np.maximum(1.0, np.abs(to).max((-1, -2)))) & (np.abs(out).max((-1, -2)) < 1e6)
    except np.linalg.LinAlgError:
        if len(cov) > 1:
            return np.concatenate([gains(cov[i : i + 1], to[i : i + 1]) for i in range(len(cov))])
        return np.linalg.pinv(cov) @ to
    if not good.all():
        out[~good] = np.linalg.pinv(cov[~good]) @ to[~good]
    return out


def smoothed(model: Any, sizes: np.ndarray, f: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rauch-Tung-Striebel: means and covariances given the whole series, for all of a batch."""
    a, P = f["filtered"].copy(), np.broadcast_to(f["filtered_cov"], (len(sizes), *f["filtered_cov"].shape[1:])).copy()
    for t in range(a.shape[1] - 2, -1, -1):
        own, ahead = f["filtered_cov"][:, t], f["predicted_cov"][:, t + 1]
        G = t_(gains(ahead, mul(model.at("T", t), own)))
        inside = t + 1 < sizes
        a[:, t] += np.where(inside[:, None], on(G, a[:, t + 1] - f["predicted"][:, t + 1]), 0.0)
        P[:, t] = np.where(inside[:, None, None], sym(own + mul(mul(G, P[:, t + 1] - ahead), t_(G))), P[:, t])
    return a, P
