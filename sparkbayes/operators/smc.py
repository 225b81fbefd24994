"""Tempered particles on a table's likelihood, moved by Hamiltonian or no-U-turn trajectories.

All particles move side by side: a trajectory is a generator that asks for the density's value and slope at a point, and a
round answers what all of them ask in one pass over the table. A task takes its rows in batches against all
points and sends one sum for each, so what moves is points times parameters, whatever the table's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from .inference import next_temperature, systematic

Slope = tuple[float, np.ndarray]
Trajectory = Generator[np.ndarray, Slope, tuple[np.ndarray, float]]
CELLS = 1 << 20  # points times rows evaluated at a time


@dataclass
class Sums:
    """Log likelihood and slopes at many points, each pass one job; ``columns`` are what the expression reads."""

    df: DataFrame
    likelihood: E.Expr
    names: list[str]
    columns: list[str]
    passes: int = 0

    def __call__(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, slopes) at the rows of ``points``."""
        self.passes += 1
        names, columns, n = self.names, self.columns, len(points)
        exprs = [self.likelihood, *(E.derivative(self.likelihood, k) for k in names)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, size = np.zeros((len(exprs), n)), max(1, CELLS // max(1, n))
            params = {k: points[:, i][:, None] for i, k in enumerate(names)}
            for batch in batches:
                for lo in range(0, batch.num_rows, size):
                    rows = {c: batch.column(c).slice(lo, size).to_numpy(zero_copy_only=False).astype(float)[None, :] for c in columns}
                    m = len(next(iter(rows.values()))[0])
                    for j, e in enumerate(exprs):
                        total[j] += np.broadcast_to(E.evaluate(e, params, rows), (n, m)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "value"])

        got = self.df.select(*columns).mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        flat = np.zeros(len(exprs) * n)
        for r in got:
            flat[r.place] = r.value
        flat = flat.reshape(len(exprs), n)
        return flat[0], flat[1:].T


@dataclass
class State:
    x: np.ndarray
    p: np.ndarray
    logp: float
    g: np.ndarray


def leap(s: State, size: float) -> Generator[np.ndarray, Slope, State]:
    p = s.p + size / 2 * s.g
    x = s.x + size * p
    logp, g = yield x
    return State(x, p + size / 2 * g, logp, g)


def energy(s: State) -> float:
    return s.logp - 0.5 * float(s.p @ s.p)


def hamiltonian(x: np.ndarray, now: Slope, step: float, rng: np.random.Generator, *, leaps: int = 8) -> Trajectory:
    """One move of fixed length, accepted or not; (where it ended, the share of acceptance)."""
    s = State(x, rng.standard_normal(len(x)), *now)
    new = s
    for _ in range(leaps):
        new = yield from leap(new, step)
    share = math.exp(min(0.0, energy(new) - energy(s))) if np.isfinite(new.logp) else 0.0
    return (new.x, share) if rng.uniform() < share else (x, share)


def turned(a: State, b: State) -> bool:
    """Whether a trajectory from a to b has begun to come back at either end."""
    way = b.x - a.x
    return float(way @ a.p) < 0 or float(way @ b.p) < 0


@dataclass
class Tree:
    """Part of a trajectory: its ends, one of its points drawn by weight, the log of all weights, and whether it may go on."""

    a: State
    b: State
    chosen: np.ndarray
    logw: float
    going: bool
    accepted: float
    size: int


def grow(s: State, depth: int, step: float, start: float, rng: np.random.Generator) -> Generator[np.ndarray, Slope, Tree]:
    """2^depth steps on from a state; step's sign is the direction in time. Stops early where a part of it turns or breaks away."""
    if depth == 0:
        new = yield from leap(s, step)
        w = energy(new) - start if np.isfinite(new.logp) else -np.inf
        return Tree(new, new, new.x, w, w > -1000, math.exp(min(0.0, w)), 1)
    one = yield from grow(s, depth - 1, step, start, rng)
    if not one.going:
        return one
    two = yield from grow(one.b if step > 0 else one.a, depth - 1, step, start, rng)
    return joined(one, two, step, rng, two.logw - np.logaddexp(one.logw, two.logw))


def joined(one: Tree, two: Tree, step: float, rng: np.random.Generator, log_share: float) -> Tree:
    """Two parts that follow one another; the second's point is taken with the given probability."""
    a, b = (one.a, two.b) if step > 0 else (two.a, one.b)
    chosen = two.chosen if two.going and np.log(rng.uniform()) < log_share else one.chosen
    going = one.going and two.going and not turned(a, b)
    return Tree(a, b, chosen, float(np.logaddexp(one.logw, two.logw)), going, one.accepted + two.accepted, one.size + two.size)


def no_u_turn(x: np.ndarray, now: Slope, step: float, rng: np.random.Generator, *, depth: int = 6) -> Trajectory:
    """A trajectory that doubles, forwards or backwards at random, until it turns back; one of its points by weight."""
    s = State(x, rng.standard_normal(len(x)), *now)
    start = energy(s)
    tree = Tree(s, s, x, 0.0, True, 0.0, 0)
    for d in range(depth):
        way = step if rng.uniform() < 0.5 else -step
        part = yield from grow(tree.b if way > 0 else tree.a, d, way, start, rng)
        if not part.going:
            return tree.chosen, (tree.accepted + part.accepted) / (tree.size + part.size)
        tree = joined(tree, part, way, rng, part.logw - tree.logw)
        if not tree.going:
            break
    return tree.chosen, tree.accepted / max(1, tree.size)


KERNELS: dict[str, Callable[..., Trajectory]] = {"nuts": no_u_turn, "hmc": hamiltonian}


def side_by_side(moves: list[Trajectory], look: Callable[[np.ndarray], list[Slope]]) -> list[tuple[np.ndarray, float]]:
    """Run trajectories together: each round answers what all that go on have asked."""
    out: list = [None] * len(moves)
    asked = {i: next(m) for i, m in enumerate(moves)}
    while asked:
        order = [*asked]
        for i, got in zip(order, look(np.array([asked[i] for i in order])), strict=True):
            try:
                asked[i] = moves[i].send(got)
            except StopIteration as end:
                out[i] = end.value
                del asked[i]
    return out


def fit_smc(
    df: DataFrame, likelihood: E.Expr, prior: E.Expr, names: Sequence[str], columns: Sequence[str], draw: Callable[[np.random.Generator], np.ndarray], *,
    kernel: str = "nuts", particles: int = 500, target_share: float = 0.5, moves: int = 5, step: float = 0.1, aim: float = 0.8, seed: int = 0, most: int = 100, **kw,
) -> tuple[np.ndarray, pd.DataFrame]:
    """(particles x k, diagnostics by iteration), from the prior to the posterior of the rows.

    likelihood: of a row; prior: of the parameters; draw: one draw of the prior. The step follows the share of acceptance towards ``aim``.
    """
    if kernel not in KERNELS:
        raise ValueError(f"kernel {kernel!r}, not one of {sorted(KERNELS)}")
    names, rng = [*names], np.random.default_rng(seed)
    sums = Sums(df.select(*columns).persist(), likelihood, names, [*columns])
    slopes = [E.derivative(prior, k) for k in names]

    def of_prior(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        params = {k: points[:, i] for i, k in enumerate(names)}
        with np.errstate(all="ignore"):
            return np.broadcast_to(E.evaluate(prior, params), len(points)), np.array([np.broadcast_to(E.evaluate(e, params), len(points)) for e in slopes]).T

    x = np.array([draw(np.random.default_rng([seed, i])) for i in range(particles)], dtype=float)
    ll, dll = sums(x)
    now, log_evidence, report = 0.0, 0.0, []
    for turn in range(1, most + 1):
        new = next_temperature(ll, now, target_share)
        logw = (new - now) * ll
        gain = float(np.log(np.mean(np.exp(logw - logw.max()))) + logw.max())
        w = np.exp(logw - logw.max())
        ancestors = systematic(w / w.sum(), rng)
        x, ll, dll = x[ancestors], ll[ancestors], dll[ancestors]

        def look(points: np.ndarray, t: float = new) -> list[Slope]:
            a, da = sums(points)
            b, db = of_prior(points)
            return [*zip((t * a + b).tolist(), t * da + db, strict=True)]

        shares = []
        for k in range(moves):
            b, db = of_prior(x)
            at = [*zip((new * ll + b).tolist(), new * dll + db, strict=True)]
            ways = [KERNELS[kernel](x[i], at[i], step, np.random.default_rng([seed, turn, k, i]), **kw) for i in range(particles)]
            done = side_by_side(ways, look)
            x = np.array([d[0] for d in done])
            ll, dll = sums(x)
            shares.append(float(np.mean([d[1] for d in done])))
            step *= math.exp(0.7 * (shares[-1] - aim))
        log_evidence += gain
        report.append({"iteration": turn, "lambda": new, "loglik_inc": gain, "accepted": float(np.mean(shares)), "step": step, "ess": float(w.sum() ** 2 / (w * w).sum()), "passes": sums.passes})
        now = new
        if now >= 1.0:
            break
    sums.df.unpersist()
    diagnostics = pd.DataFrame(report)
    diagnostics.attrs["log_evidence"] = log_evidence
    return x, diagnostics
