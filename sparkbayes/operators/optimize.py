"""Searches for modes beyond plain quasi-Newton steps: within bounds, by Hessian-vector products, and over many basins.

Every search is a generator that asks for looks at points and is sent what was seen there. So one search is driven by single
looks, and many searches share each pass over the data: a round looks at the next point of every one of them.
"""

from __future__ import annotations

from collections.abc import Generator, Sequence

import numpy as np

from .inference import Target, two_loops, uphill

Look = tuple[float, np.ndarray, np.ndarray]
Search = Generator[np.ndarray, Look, tuple[np.ndarray, Look]]


def limits(bounds: Sequence[tuple[float | None, float | None]] | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper limits of each parameter; None is without."""
    if bounds is None:
        return np.full(k, -np.inf), np.full(k, np.inf)
    if len(bounds) != k:
        raise ValueError(f"{len(bounds)} bounds for {k} parameters")
    lo, hi = (np.array([(-np.inf, np.inf)[side] if b is None or b[side] is None else float(b[side]) for b in bounds]) for side in (0, 1))
    if (lo > hi).any():
        raise ValueError("a lower bound lies above its upper one")
    return lo, hi


def climb(start: np.ndarray, lo: np.ndarray, hi: np.ndarray, *, method: str = "newton", steps: int = 100, tol: float = 1e-8, memory: int = 10) -> Search:
    """Uphill from a point, never leaving the bounds.

    Parameters that lie at a bound and would go on beyond it stay; the others take a Newton or L-BFGS step, projected
    back into the bounds and halved until it gives a hundredth of what the slope promises.
    """
    if method not in ("newton", "lbfgs"):
        raise ValueError(f"method {method!r}, not newton or lbfgs")
    x = np.clip(np.asarray(start, dtype=float), lo, hi)
    seen = yield x
    S: list[np.ndarray] = []
    Y: list[np.ndarray] = []
    before = None
    for _ in range(steps):
        value, g, h = seen
        free = ~(((x <= lo) & (g <= 0)) | ((x >= hi) & (g >= 0)))
        if not free.any() or np.max(np.abs(g[free])) < tol * max(1.0, abs(value)):
            break
        direction = np.zeros(len(x))
        if method == "newton":
            direction[free] = np.linalg.solve(uphill(-h[np.ix_(free, free)]), g[free])
        else:
            if before is not None and (before != free).any():
                S, Y = [], []
            direction[free] = two_loops(g[free], [s[free] for s in S], [y[free] for y in Y])
        before, size, got = free, 1.0, None
        while size > 1e-10:
            new = np.clip(x + size * direction, lo, hi)
            look = yield new
            if np.isfinite(look[0]) and np.isfinite(look[1]).all() and look[0] >= value + 0.01 * float(g @ (new - x)):
                got = look
                break
            size /= 2
        if got is None:
            break
        s, y = new - x, g - got[1]
        if s[free] @ y[free] > 1e-12 * (y[free] @ y[free]):
            S, Y = [*S, s][-memory:], [*Y, y][-memory:]
        done = abs(got[0] - value) < 1e-14 * max(1.0, abs(value))
        x, seen = new, got
        if done:
            break
    return x, seen


def together(target: Target, searches: list[Search]) -> list[tuple[np.ndarray, Look]]:
    """Run searches side by side: each pass over the data looks at the next point of all that aren't done."""
    out: list = [None] * len(searches)
    asked = {i: next(s) for i, s in enumerate(searches)}
    while asked:
        order = [*asked]
        looks = target.at_all([asked[i] for i in order])
        for i, look in zip(order, looks, strict=True):
            try:
                asked[i] = searches[i].send(look)
            except StopIteration as end:
                out[i] = end.value
                del asked[i]
    return out


def find_bounded(target: Target, start: np.ndarray, bounds: Sequence[tuple[float | None, float | None]], **kw) -> tuple[np.ndarray, Look, dict]:
    """The point of highest density within bounds; info tells which parameters ended at one."""
    lo, hi = limits(bounds, len(start))
    x, seen = together(target, [climb(start, lo, hi, **kw)])[0]
    return x, seen, {"looks": target.looks, "at_bound": [n for n, v, a, b in zip(target.names, x, lo, hi, strict=True) if v in (a, b)]}


def steihaug(g: np.ndarray, product, radius: float, steps: int, tol: float) -> np.ndarray:
    """The step of highest quadratic value inside a radius, by conjugate gradients on Hessian-vector products."""
    s, r = np.zeros(len(g)), -g
    d = -r
    for _ in range(steps):
        b = -product(d)
        curve = float(d @ b)
        alpha = float(r @ r) / curve if curve > 0 else np.inf
        if curve <= 0 or np.linalg.norm(s + alpha * d) >= radius:
            dd, sd, ss = d @ d, s @ d, s @ s
            return s + (-sd + np.sqrt(sd * sd + dd * (radius * radius - ss))) / dd * d
        s, new = s + alpha * d, r + alpha * b
        if np.linalg.norm(new) < tol:
            return s
        d, r = -new + float(new @ new) / float(r @ r) * d, new
    return s


def trust_region(target: Target, start: np.ndarray, *, steps: int = 100, tol: float = 1e-8, radius: float = 1.0, most: float = 1e3) -> tuple[np.ndarray, tuple[float, np.ndarray], dict]:
    """The point of highest density by trust-region conjugate gradients: slopes and Hessian-vector products only, never the Hessian."""
    if target.slopes is None or target.product is None:
        raise ValueError("the target has no slopes and Hessian-vector products")
    x, products = np.asarray(start, dtype=float), 0
    value, g = target.slopes(x)
    for _ in range(steps):
        size = float(np.linalg.norm(g))
        if np.max(np.abs(g)) < tol * max(1.0, abs(value)):
            break
        used = []

        def product(v: np.ndarray, at: np.ndarray = x, used: list = used) -> np.ndarray:
            used.append((v, target.product(at, v)))
            return used[-1][1]

        s = steihaug(g, product, radius, 2 * len(x), min(0.5, np.sqrt(size)) * size)
        products += len(used)
        promised = float(g @ s + 0.5 * s @ target.product(x, s))
        got = target.slopes(x + s)
        ratio = (got[0] - value) / promised if promised > 0 and np.isfinite(got[0]) else -1.0
        if ratio < 0.25:
            radius /= 4
        elif ratio > 0.75 and np.linalg.norm(s) > 0.99 * radius:
            radius = min(2 * radius, most)
        if ratio > 1e-4:
            x, (value, g) = x + s, got
        elif radius < 1e-12 or abs(promised) < 1e-14 * max(1.0, abs(value)):
            break
    return x, (value, g), {"products": products}


def basin_hopping(target: Target, start: np.ndarray, *, hops: int = 20, chains: int = 1, step: float = 1.0, temperature: float = 1.0, bounds=None, seed: int = 0, **kw) -> tuple[np.ndarray, Look, dict]:
    """The best of the modes that random hops reach.

    Each chain hops from its present mode to a point near by, climbs from there, and stays at the new mode if it is higher, or by
    chance if it isn't much lower. Steps widen and narrow so that about half of the hops are kept. Chains climb side by side.
    """
    k, rng = len(start), np.random.default_rng(seed)
    lo, hi = limits(bounds, k)
    starts = [np.asarray(start, dtype=float)] + [np.asarray(start, dtype=float) + rng.uniform(-step, step, k) for _ in range(chains - 1)]
    now = together(target, [climb(s, lo, hi, **kw) for s in starts])
    best = max(now, key=lambda f: f[1][0])
    kept, found = 0, [round(f[1][0], 6) for f in now]
    for hop in range(hops):
        new = together(target, [climb(x + rng.uniform(-step, step, k), lo, hi, **kw) for x, _ in now])
        for i, f in enumerate(new):
            found.append(round(f[1][0], 6))
            if np.isfinite(f[1][0]) and np.log(rng.uniform()) < (f[1][0] - now[i][1][0]) / temperature:
                now[i], kept = f, kept + 1
        best = max([best, *now], key=lambda f: f[1][0])
        if (hop + 1) % 5 == 0:
            step *= 1.1 if kept > 0.5 * 5 * chains else 0.9
            kept = 0
    return best[0], best[1], {"modes": len({*found}), "looks": target.looks}
