"""Numeric helpers: splines, conjugate gradients, partial orders, low-rank Gaussian processes, moments, scaling."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import np_erfinv

# --- splines -----------------------------------------------------------------------------------------------------


def knots(k: int, degree: int = 3) -> np.ndarray:
    """Clamped uniform knots on [0, 1] for k basis functions."""
    if k <= degree:
        raise ValueError("more basis functions than the degree")
    return np.concatenate([np.zeros(degree), np.linspace(0, 1, k - degree + 1), np.ones(degree)])


def bspline_basis(x: Column, k: int, degree: int = 3) -> list[Column]:
    """The k basis functions at x in [0, 1], by the recursion over degrees; the last one is closed at 1."""
    t = knots(k, degree)
    last = max(i for i in range(len(t) - 1) if t[i] < t[i + 1])

    def inside(i: int) -> Column:
        upper = x <= float(t[i + 1]) if i == last else x < float(t[i + 1])
        return F.when((x >= float(t[i])) & upper, F.lit(1.0)).otherwise(F.lit(0.0))

    level: list[Column | None] = [inside(i) if t[i] < t[i + 1] else None for i in range(len(t) - 1)]
    for d in range(1, degree + 1):
        new: list[Column | None] = []
        for i in range(len(t) - 1 - d):
            parts = []
            if level[i] is not None and t[i + d] > t[i]:
                parts.append((x - float(t[i])) / float(t[i + d] - t[i]) * level[i])
            if level[i + 1] is not None and t[i + d + 1] > t[i + 1]:
                parts.append((float(t[i + d + 1]) - x) / float(t[i + d + 1] - t[i + 1]) * level[i + 1])
            new.append(None if not parts else parts[0] if len(parts) == 1 else parts[0] + parts[1])
        level = new
    return [F.lit(0.0) if c is None else c for c in level]


def np_bspline_basis(x: np.ndarray, k: int, degree: int = 3) -> np.ndarray:
    t = knots(k, degree)
    x = np.asarray(x, dtype=float)
    last = max(i for i in range(len(t) - 1) if t[i] < t[i + 1])
    level = np.array([(x >= t[i]) & ((x <= t[i + 1]) if i == last else (x < t[i + 1])) & (t[i] < t[i + 1]) for i in range(len(t) - 1)], dtype=float)
    for d in range(1, degree + 1):
        left = np.array([(x - t[i]) / (t[i + d] - t[i]) if t[i + d] > t[i] else 0 * x for i in range(len(t) - d)])
        level = np.array([left[i] * level[i] + (1 - left[i + 1] if t[i + d + 1] > t[i + 1] else 0) * level[i + 1] for i in range(len(t) - 1 - d)])
    return level.T


def bspline_interpolation(weights: np.ndarray, *, n: int | None = None, at: np.ndarray | None = None, degree: int = 3) -> np.ndarray:
    if (n is None) == (at is None):
        raise ValueError("exactly one of n and at")
    points = np.linspace(0, 1, n) if at is None else np.asarray(at)
    return np_bspline_basis(points, len(weights), degree) @ np.asarray(weights)


# --- conjugate gradients -----------------------------------------------------------------------------------------


def linear_cg(
    matvec: Callable[[np.ndarray], np.ndarray], b: np.ndarray, *, preconditioner: Callable[[np.ndarray], np.ndarray] | None = None, tol: float = 1e-10, steps: int | None = None, start: np.ndarray | None = None, tridiagonal: bool = False
) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Solve A x = b for a positive definite A given by its products; raises if the tolerance isn't met.

    tridiagonal: (x, T), where T is A in the basis that the residuals span (Lanczos), made of the steps' own lengths.
    """
    M = preconditioner or (lambda v: v)
    x = np.zeros_like(b, dtype=float) if start is None else np.asarray(start, dtype=float).copy()
    r = b - matvec(x)
    z = M(r)
    p, rz = z, r @ z
    lengths: list[tuple[float, float]] = []  # of each step, and of the turn after it
    for _ in range(steps or 10 * len(b)):
        if np.linalg.norm(r) <= tol * max(1.0, np.linalg.norm(b)):
            break
        Ap = matvec(p)
        a = rz / (p @ Ap)
        x, r = x + a * p, r - a * Ap
        z = M(r)
        rz, old = r @ z, rz
        p = z + rz / old * p
        lengths.append((a, rz / old))
    else:
        if np.linalg.norm(r) > tol * max(1.0, np.linalg.norm(b)) * 10:
            raise RuntimeError("conjugate gradients did not reach the tolerance")
    return (x, lanczos(lengths)) if tridiagonal else x


def lanczos(lengths: list[tuple[float, float]]) -> np.ndarray:
    """The tridiagonal matrix of conjugate-gradient steps."""
    k = len(lengths)
    T = np.zeros((k, k))
    for i, (a, turn) in enumerate(lengths):
        T[i, i] = 1 / a + (lengths[i - 1][1] / lengths[i - 1][0] if i else 0.0)
        if i + 1 < k:
            T[i, i + 1] = T[i + 1, i] = np.sqrt(turn) / a
    return T


def logdet_quadrature(matvec: Callable[[np.ndarray], np.ndarray], n: int, *, probes: int | None = None, steps: int | None = None, tol: float = 1e-12, seed: int = 0) -> float:
    """log det of a positive definite A by its products: Gauss quadrature of the logarithm from each probe's tridiagonal matrix.

    probes: random sign vectors, an estimate; by default the n unit vectors, which is exact once the steps suffice.
    """
    rng = np.random.default_rng(seed)
    starts = np.eye(n) if probes is None else rng.choice([-1.0, 1.0], size=(probes, n))
    total = 0.0
    for v in starts:
        _, T = linear_cg(matvec, v, tol=tol, steps=steps or 4 * n, tridiagonal=True)
        w, U = np.linalg.eigh(T)
        total += float(v @ v) * float((U[0] ** 2 * np.log(np.maximum(w, 1e-300))).sum())
    return total if probes is None else total / len(starts)


def table_matvec(entries: DataFrame, n: int, row: str = "i", column: str = "j", value: str = "v") -> Callable[[np.ndarray], np.ndarray]:
    """Products with a sparse matrix that is a table of entries: each is one pass, its partial sums made before the shuffle.

    The vector is a literal of the plan, so n is meant to be small against the number of entries.
    """

    def times(x: np.ndarray) -> np.ndarray:
        literal = F.array(*[F.lit(float(v)) for v in x])
        got = entries.groupBy(row).agg(F.sum(F.col(value) * F.get(literal, F.col(column).cast("int"))).alias("s")).collect()
        out = np.zeros(n)
        for r in got:
            out[r[0]] = r[1]
        return out

    return times


# --- partial orders ----------------------------------------------------------------------------------------------


class PartialOrder:
    """Vectors whose places respect a directed acyclic graph: a place exceeds all places with an edge to it."""

    def __init__(self, adjacency: np.ndarray):
        A = np.asarray(adjacency).astype(bool)
        n = len(A)
        reach = A.copy()
        for k in range(n):
            reach |= np.outer(reach[:, k], reach[k])
        if reach.diagonal().any():
            raise ValueError("the graph has a cycle")
        self.closure = reach
        self.reduced = reach & ~(reach.astype(int) @ reach.astype(int) > 0)
        self.order = sorted(range(n), key=lambda i: (int(reach[:, i].sum()), i))
        self.parents = [np.flatnonzero(self.reduced[:, i]).tolist() for i in range(n)]

    def backward(self, v: np.ndarray) -> np.ndarray:
        out = np.array(v, dtype=float)
        for i in self.order:
            if self.parents[i]:
                out[..., i] = out[..., self.parents[i]].max(axis=-1) + np.exp(np.asarray(v)[..., i])
        return out

    def forward(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=float)
        out = x.copy()
        for i, p in enumerate(self.parents):
            if p:
                out[..., i] = np.log(x[..., i] - x[..., p].max(axis=-1))
        return out

    def log_jac_det(self, v: np.ndarray) -> np.ndarray:
        moved = [i for i, p in enumerate(self.parents) if p]
        return np.asarray(v)[..., moved].sum(axis=-1)

    def backward_columns(self, v: list[Column]) -> list[Column]:
        """The same as Columns."""
        out: list[Column] = [*v]
        for i in self.order:
            p = [out[j] for j in self.parents[i]]
            if p:
                out[i] = (F.greatest(*p) if len(p) > 1 else p[0]) + F.exp(v[i])
        return out


def transitive_closure(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """All pairs with a path between them, by joins that double the paths' length until nothing new comes."""
    known = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct().checkpoint() if edges.sparkSession.sparkContext.getCheckpointDir() else edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    count = known.count()
    while True:
        more = known.select("a", F.col("b").alias("m")).join(known.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        known = known.unionByName(more).distinct()
        if known.sparkSession.sparkContext.getCheckpointDir():
            known = known.checkpoint()
        now = known.count()
        if now == count:
            return known
        count = now


# --- low-rank Gaussian processes ---------------------------------------------------------------------------------


def rbf(a: np.ndarray, b: np.ndarray, length: float = 1.0, scale: float = 1.0) -> np.ndarray:
    d = ((np.atleast_2d(a)[:, None, :] - np.atleast_2d(b)[None, :, :]) ** 2).sum(axis=-1)
    return scale**2 * np.exp(-0.5 * d / length**2)


def inducing_points(df: DataFrame, columns: list[str], k: int, seed: int = 0) -> np.ndarray:
    """Centres of a k-means clustering of a table's columns."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(df)
    return np.array(KMeans(k=k, seed=seed).fit(rows).clusterCenters())


class ProjectedProcess:
    """A Gaussian process through its values at inducing points."""

    def __init__(self, inducing: np.ndarray, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], jitter: float = 1e-8):
        self.z, self.kernel = np.atleast_2d(inducing), kernel
        self.root = np.linalg.cholesky(kernel(self.z, self.z) + jitter * np.eye(len(self.z)))

    def prior(self, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Values at x for standard normal v at the inducing points."""
        return self.kernel(x, self.z) @ np.linalg.solve(self.root.T, v)

    def conditional(self, x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance at x given the values u at the inducing points."""
        a = np.linalg.solve(self.root, self.kernel(self.z, x))
        return a.T @ np.linalg.solve(self.root, u), self.kernel(x, x) - a.T @ a


def karhunen_loeve(K: np.ndarray, *, n_eigs: int | None = None, variance_limit: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues and vectors: a number of them, or as many as the share of variance takes."""
    if (n_eigs is None) == (variance_limit is None):
        raise ValueError("exactly one of n_eigs and variance_limit")
    w, v = np.linalg.eigh(K)
    w, v = w[::-1], v[:, ::-1]
    if n_eigs is None:
        n_eigs = int(np.searchsorted(np.cumsum(w) / w.sum(), variance_limit) + 1)
    return w[:n_eigs], v[:, :n_eigs]


# --- moments and scaling -----------------------------------------------------------------------------------------


def moments(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and sample covariance of columns, in one aggregate."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    row = df.agg(*[F.avg(c) for c in columns], *[F.covar_samp(columns[i], columns[j]) for i, j in pairs]).head()
    cov = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(pairs, row[len(columns) :], strict=True):
        cov[i, j] = cov[j, i] = v
    return np.array([float(x) for x in row[: len(columns)]]), cov


def prior_from_draws(draws: DataFrame, columns: list[str], transforms: dict[str, Callable[[Column], Column]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and Cholesky factor of posterior draws, each on its transformed scale: a multivariate normal prior for the next model."""
    t = transforms or {}
    mean, cov = moments(draws.select(*[t.get(c, lambda x: x)(F.col(c)).alias(c) for c in columns]), columns)
    return mean, np.linalg.cholesky(cov)


class StandardScaler:
    """Columns less their mean, over their population standard deviation; learned in one aggregate."""

    def __init__(self, columns: list[str]):
        self.columns = columns
        self.center: dict[str, float] = {}
        self.scale: dict[str, float] = {}

    def fit(self, df: DataFrame) -> StandardScaler:
        row = df.agg(*[f(c) for c in self.columns for f in (F.avg, F.stddev_pop)]).head()
        for i, c in enumerate(self.columns):
            self.center[c], self.scale[c] = float(row[2 * i] or 0), float(row[2 * i + 1] or 0) or 1.0
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - self.center[c]) / self.scale[c] for c in self.columns})

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


# --- shrinkage prior on explained variance -----------------------------------------------------------------------


def r2d2m2cp(output_sigma: float, input_sigma: np.ndarray, r2: float, *, importance: np.ndarray | None = None, importance_concentration: np.ndarray | None = None, positive: np.ndarray | None = None, centered: bool = False, rng: np.random.Generator | None = None) -> tuple[float, np.ndarray]:
    """(residual standard deviation, coefficients): a draw whose explained share of variance is r2.

    importance: shares of the explained variance, fixed or drawn from a Dirichlet. positive: probability of a positive
    sign of each coefficient, which sets the mean of its distribution; without it coefficients are centred at zero.
    """
    if importance is not None and importance_concentration is not None:
        raise TypeError("importance and importance_concentration exclude one another")
    rng = rng or np.random.default_rng(0)
    input_sigma = np.asarray(input_sigma, dtype=float)
    k = len(input_sigma)
    if importance is not None:
        phi = np.asarray(importance, dtype=float)
    elif importance_concentration is not None:
        phi = rng.dirichlet(np.broadcast_to(importance_concentration, (k,)))
    else:
        phi = np.full(k, 1 / k)
    total = output_sigma * np.sqrt(r2 * phi / phi.sum()) / input_sigma
    psi = np.full(k, 0.5) if positive is None else np.asarray(positive, dtype=float)
    edge = (psi <= 0) | (psi >= 1)
    z = math.sqrt(2) * np_erfinv(2 * np.where(edge, 0.5, psi) - 1)
    sd = np.where(edge, 0.0, total / np.sqrt(1 + z * z))
    mu = np.where(edge, np.sign(psi - 0.5) * total, z * sd)
    return output_sigma * math.sqrt(1 - r2), mu + sd * rng.standard_normal(k)


# --- linear model ------------------------------------------------------------------------------------------------


def ols(df: DataFrame, y: str, xs: list[str]) -> np.ndarray:
    """Intercept and slopes of least squares, from the moments of one aggregate."""
    mean, cov = moments(df.select(y, *xs), [y, *xs])
    slopes = np.linalg.solve(cov[1:, 1:], cov[1:, 0])
    return np.concatenate([[mean[0] - slopes @ mean[1:]], slopes])
