"""Latent variables summed or integrated out, and their distributions given the rest."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import HALF_LN_2PI, Value, col, normal_logp
from .markov import log_sum

LogWeight = Callable[[int], Column]


def joint_terms(prior: Sequence[float | Column], given: LogWeight, domain: Sequence[int] | None = None) -> list[Column]:
    """Log joint weights of a finite latent: log prior of each value plus the log probability of the row given it."""
    domain = range(len(prior)) if domain is None else domain
    return [F.log(col(w)) + given(v) for w, v in zip(prior, domain, strict=True)]


def mixture_logp(prior: Sequence[float | Column], given: LogWeight, domain: Sequence[int] | None = None) -> Column:
    """Log probability of a row with its own finite latent summed out; stays within the row, so it needs no key and no join."""
    return log_sum(joint_terms(prior, given, domain))


def mixture_posterior(prior: Sequence[float | Column], given: LogWeight, domain: Sequence[int] | None = None) -> Column:
    """Probabilities of the latent's values given the row, as an array in the domain's order."""
    terms = joint_terms(prior, given, domain)
    total = log_sum(terms)
    return F.array(*[F.exp(t - total) for t in terms])


def bernoulli(p: float) -> list[float]:
    return [1 - p, p]


def discrete_uniform(lower: int, upper: int) -> tuple[list[float], list[int]]:
    n = upper - lower + 1
    return [1 / n] * n, [*range(lower, upper + 1)]


def grouped_mixture_logp(df: DataFrame, key: list[str], prior: Sequence[float], given: LogWeight, domain: Sequence[int] | None = None) -> DataFrame:
    """(key, logp, posterior): one latent shared by all rows of a key. Row terms add up per value of the domain in one aggregate, with partial sums before the shuffle."""
    domain = [*range(len(prior))] if domain is None else [*domain]
    sums = df.groupBy(*key).agg(*[F.sum(given(v)).alias(f"_l{i}") for i, v in enumerate(domain)])
    terms = [math.log(w) + F.col(f"_l{i}") if w > 0 else F.lit(float("-inf")) for i, w in enumerate(prior)]
    total = log_sum(terms)
    return sums.select(*key, total.alias("logp"), F.array(*[F.exp(t - total) for t in terms]).alias("posterior"))


def normal_normal_logp(y: Column, mu_m: Value, sigma_m: Value, sigma_d: Value, slope: Value = 1.0, offset: Value = 0.0) -> Column:
    """y ~ N(offset + slope x, sigma_d) with x ~ N(mu_m, sigma_m) integrated out."""
    spread = F.sqrt(col(sigma_d) * col(sigma_d) + col(slope) * col(slope) * col(sigma_m) * col(sigma_m))
    return normal_logp(y, col(offset) + col(slope) * col(mu_m), spread)


def normal_normal_conditional(y: Column, mu_m: Value, sigma_m: Value, sigma_d: Value, slope: Value = 1.0, offset: Value = 0.0) -> tuple[Column, Column]:
    """Mean and standard deviation of x given y."""
    a, b = 1 / (col(sigma_m) * col(sigma_m)), col(slope) / (col(sigma_d) * col(sigma_d))
    precision = a + b * col(slope)
    return (col(mu_m) * a + b * (y - col(offset))) / precision, 1 / F.sqrt(precision)


def normal_group_posterior(df: DataFrame, key: list[str], value: str, mu_m: float, sigma_m: float, sigma_d: float) -> DataFrame:
    """(key, n, mean, sd): a group's own mean given its rows, from count and sum alone."""
    sums = df.groupBy(*key).agg(F.count(value).alias("n"), F.sum(value).alias("_s"))
    precision = 1 / sigma_m**2 + F.col("n") / sigma_d**2
    return sums.select(*key, "n", ((mu_m / sigma_m**2 + F.col("_s") / sigma_d**2) / precision).alias("mean"), (1 / F.sqrt(precision)).alias("sd"))


def laplace_marginal(logp_y: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], mu: np.ndarray, q: np.ndarray, *, start: np.ndarray | None = None, steps: int = 100, tol: float = 1e-10) -> tuple[float, np.ndarray, np.ndarray]:
    """(log marginal, mode, precision at the mode) of a Gaussian latent with mean mu and precision q.

    logp_y gives value, gradient and Hessian of the log likelihood at a point; over a table each call is one
    aggregate. Newton steps are halved until they improve.
    """
    mu, q = np.atleast_1d(np.asarray(mu, dtype=float)), np.atleast_2d(np.asarray(q, dtype=float))
    x = np.ones(len(mu)) if start is None else np.asarray(start, dtype=float)
    prior = lambda v: -0.5 * (v - mu) @ q @ (v - mu) + 0.5 * np.linalg.slogdet(q)[1] - len(mu) * HALF_LN_2PI
    value, gradient, hessian = logp_y(x)
    for _ in range(steps):
        step = np.linalg.solve(q - hessian, gradient - q @ (x - mu))
        now, size = value + prior(x), 1.0
        while size > 1e-8:
            got = logp_y(x + size * step)
            if got[0] + prior(x + size * step) >= now - 1e-12:
                break
            size /= 2
        x = x + size * step
        value, gradient, hessian = got
        if np.max(np.abs(size * step)) < tol:
            break
    tau = q - hessian
    at_mode = 0.5 * np.linalg.slogdet(tau)[1] - len(mu) * HALF_LN_2PI
    return value + prior(x) - at_mode, x, tau


def poisson_log_rate(df: DataFrame, value: str) -> Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]:
    """Log likelihood of counts ~ Poisson(exp(x)), from sums taken once over the table."""
    from ..functions.special import lgamma

    n, s, g = df.agg(F.count(value), F.sum(value), F.sum(lgamma(F.col(value).cast("double") + 1.0))).head()
    n, s, g = int(n), float(s or 0), float(g or 0)

    def logp(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        rate = math.exp(float(x[0]))
        return s * float(x[0]) - n * rate - g, np.array([s - n * rate]), np.array([[-n * rate]])

    return logp
