"""How far to centre a hierarchy: the weight of a re-expression fitted together with a variational guide.

A vector of normal latents with common mean and spread, x_j ~ N(mu, sigma), is re-expressed by tau_j ~ N(w_j mu, sigma^w_j),
x_j = mu + sigma^(1 - w_j) (tau_j - w_j mu): centred at w = 1, not at w = 0. The guide is a normal for each of mu, log sigma and
all tau; the weights, by a sigmoid, climb the same evidence bound. Much data on each latent pull its weight to 1, little to 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Likelihood = Callable[[np.ndarray], tuple[float, np.ndarray]]


@dataclass
class Fitted:
    weights: np.ndarray
    mean: np.ndarray  # of mu, log sigma and every tau
    sd: np.ndarray
    bounds: list[float]

    def latents(self, rng: np.random.Generator, n: int) -> np.ndarray:
        """Draws of x (n x k) by the guide."""
        z = self.mean + self.sd * rng.standard_normal((n, len(self.mean)))
        return expressed(z[:, :1], z[:, 1:2], z[:, 2:], self.weights)


def expressed(mu, log_sigma, tau, w):
    return mu + np.exp((1 - w) * log_sigma) * (tau - w * mu)


def grouped_normal(df: DataFrame, key: str, value: str, noise: float) -> tuple[list, Likelihood]:
    """(keys, log likelihood of their latents) of rows y ~ N(x_key, noise): a row for each key is all that leaves the table."""
    rows = df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("m")).orderBy(key).collect()
    n, mean = np.array([r["n"] for r in rows], dtype=float), np.array([r["m"] or 0.0 for r in rows], dtype=float)

    def look(x: np.ndarray) -> tuple[float, np.ndarray]:
        return float(-0.5 * (n * (mean - x) ** 2).sum() / noise**2), n * (mean - x) / noise**2

    return [r[key] for r in rows], look


def log_joint(z: np.ndarray, w: np.ndarray, likelihood: Likelihood, mu_prior: tuple[float, float], spread_prior: tuple[float, float]) -> tuple[float, np.ndarray, np.ndarray]:
    """(log density of mu, log sigma and tau with the data, its slopes in them, its slopes in the weights)."""
    mu, s, tau = float(z[0]), float(z[1]), z[2:]
    out, wide = tau - w * mu, np.exp((1 - w) * s)
    value, g = likelihood(mu + wide * out)
    sharp = np.exp(-2 * w * s)
    value += float((-0.5 * out**2 * sharp - w * s).sum()) - 0.5 * ((mu - mu_prior[0]) / mu_prior[1]) ** 2 - 0.5 * ((s - spread_prior[0]) / spread_prior[1]) ** 2
    d_mu = float((g * (1 - w * wide)).sum() + (w * out * sharp).sum()) - (mu - mu_prior[0]) / mu_prior[1] ** 2
    d_s = float((g * (1 - w) * wide * out).sum() + (w * out**2 * sharp - w).sum()) - (s - spread_prior[0]) / spread_prior[1] ** 2
    d_tau = g * wide - out * sharp
    d_w = g * (-s * wide * out - wide * mu) + out * mu * sharp + s * out**2 * sharp - s
    return value, np.concatenate([[d_mu, d_s], d_tau]), d_w


def fit_vip(likelihood: Likelihood, k: int, *, mu_prior: tuple[float, float] = (0.0, 5.0), spread_prior: tuple[float, float] = (0.0, 1.0), start: float = 0.5, steps: int = 3000, draws: int = 8, rate: float = 0.05, seed: int = 0) -> Fitted:
    """Climb the evidence bound in the guide and the weights at once (Adam, slopes by re-expressed draws)."""
    rng = np.random.default_rng(seed)
    n = k + 2
    at = np.concatenate([np.zeros(n), np.full(n, -1.0), np.full(k, math.log(start / (1 - start)))])  # means, log spreads, logits
    m, v, bounds = np.zeros(len(at)), np.zeros(len(at)), []
    for t in range(1, steps + 1):
        mean, sd, w = at[:n], np.exp(at[n : 2 * n]), 1 / (1 + np.exp(-at[2 * n :]))
        g, bound = np.zeros(len(at)), 0.0
        g[n : 2 * n] = 1.0  # of the entropy
        for e in rng.standard_normal((draws // 2, n)):
            for sign in (1.0, -1.0):
                value, slope, d_w = log_joint(mean + sign * sd * e, w, likelihood, mu_prior, spread_prior)
                g[:n] += slope / draws
                g[n : 2 * n] += slope * sign * sd * e / draws
                g[2 * n :] += d_w * w * (1 - w) / draws
                bound += value / draws
        bounds.append(bound + float(at[n : 2 * n].sum()))
        g *= min(1.0, 1e3 / max(1e-12, float(np.linalg.norm(g))))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        at = at + rate * min(1.0, 3 * (1 - t / (steps + 1))) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Fitted(1 / (1 + np.exp(-at[2 * n :])), at[:n], np.exp(at[n : 2 * n]), bounds)
