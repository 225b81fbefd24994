"""Densities, distribution functions, quantiles and draws as Column expressions.

Each distribution is a small frozen dataclass of parameters, numbers or Columns. ``logp`` and its kin take a Column
of values and give -inf outside the support, never null, unless an argument is null. Literal parameters are checked
when the object is made; ``check`` gives the same condition as a Column for parameters that are data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import NEG_INF, Value, betaln, col, erf, gamma_draw, gamma_p, lgamma, log1mexp, log_bessel_i, normal_logp, softplus, uniform



def number(x: Value) -> bool:
    return not isinstance(x, Column)


def need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def bounded(inside: Column, value: Column, outside: float = NEG_INF) -> Column:
    return F.when(inside, value).otherwise(F.lit(outside))


class Distribution:
    """What all distributions have: a density on the log scale and what follows from it."""

    def logp(self, x: Value) -> Column:
        raise NotImplementedError

    def logcdf(self, x: Value) -> Column:
        raise NotImplementedError

    def icdf(self, q: Value) -> Column:
        raise NotImplementedError

    def pdf(self, x: Value) -> Column:
        return F.exp(self.logp(x))

    def cdf(self, x: Value) -> Column:
        return F.exp(self.logcdf(x))

    def logsf(self, x: Value) -> Column:
        return log1mexp(self.logcdf(x))

    def sf(self, x: Value) -> Column:
        return F.exp(self.logsf(x))

    def isf(self, q: Value) -> Column:
        return self.icdf(1.0 - col(q))

    def draw(self, key: Column, seed: int = 0) -> Column:
        """A random value by key: the quantile of a uniform number."""
        return self.icdf(uniform(key, seed))


def near_zero(xi: Value) -> Column:
    return F.abs(col(xi)) <= 1e-8


@dataclass(frozen=True)
class GenExtreme(Distribution):
    """Generalised extreme values; xi > 0 has the heavy upper tail."""

    mu: Value = 0.0
    sigma: Value = 1.0
    xi: Value = 0.0

    def __post_init__(self):
        need(not number(self.sigma) or self.sigma > 0, "sigma > 0")
        need(not number(self.xi) or -1 < self.xi < 1, "-1 < xi < 1")

    @staticmethod
    def of_opposite_sign(mu: Value, sigma: Value, c: Value) -> GenExtreme:
        """From the shape of the convention in which a positive one bounds the upper tail."""
        return GenExtreme(mu, sigma, -c)

    def check(self) -> Column:
        return (col(self.sigma) > 0) & (col(self.xi) > -1) & (col(self.xi) < 1)

    def _scaled(self, x: Value) -> tuple[Column, Column, Column]:
        z = (col(x) - col(self.mu)) / col(self.sigma)
        xi = F.when(near_zero(self.xi), F.lit(1.0)).otherwise(col(self.xi))
        return z, xi, xi * z

    def logp(self, x: Value) -> Column:
        z, xi, u = self._scaled(x)
        tail = -F.log(col(self.sigma)) - (xi + 1) / xi * F.log1p(u) - F.exp(-F.log1p(u) / xi)
        limit = -F.log(col(self.sigma)) - z - F.exp(-z)
        return F.when(near_zero(self.xi), limit).otherwise(bounded(1 + u > 0, tail))

    def logcdf(self, x: Value) -> Column:
        """0 above the upper end point (xi < 0), -inf below the lower one (xi > 0)."""
        z, xi, u = self._scaled(x)
        outside = F.when(xi < 0, F.lit(0.0)).otherwise(F.lit(NEG_INF))
        return F.when(near_zero(self.xi), -F.exp(-z)).otherwise(F.when(1 + u > 0, -F.exp(-F.log1p(u) / xi)).otherwise(outside))

    def icdf(self, q: Value) -> Column:
        e = -F.log(col(q))
        xi = F.when(near_zero(self.xi), F.lit(1.0)).otherwise(col(self.xi))
        return col(self.mu) + col(self.sigma) * F.when(near_zero(self.xi), -F.log(e)).otherwise(F.expm1(-xi * F.log(e)) / xi)

    def support_point(self) -> Column:
        xi = F.when(near_zero(self.xi), F.lit(1.0)).otherwise(col(self.xi))
        return col(self.mu) + F.when(near_zero(self.xi), F.lit(0.0)).otherwise(col(self.sigma) * (F.pow(1 + xi, -xi) - 1) / xi)


def log1p_over(u: Column) -> Column:
    """log1p(u) / u, by its series near zero."""
    small = 1 - u / 2 + u * u / 3 - u * u * u / 4 + u * u * u * u / 5
    safe = F.when(F.abs(u) < 1e-3, F.lit(1.0)).otherwise(u)
    return F.when(F.abs(u) < 1e-3, small).otherwise(F.log1p(safe) / safe)


def expm1_over(u: Column) -> Column:
    """expm1(u) / u, by its series near zero."""
    small = 1 + u / 2 + u * u / 6 + u * u * u / 24 + u * u * u * u / 120
    safe = F.when(F.abs(u) < 1e-3, F.lit(1.0)).otherwise(u)
    return F.when(F.abs(u) < 1e-3, small).otherwise(F.expm1(safe) / safe)


@dataclass(frozen=True)
class GenPareto(Distribution):
    """Exceedances of a threshold mu; xi < 0 has an upper end point."""

    mu: Value = 0.0
    sigma: Value = 1.0
    xi: Value = 0.0

    def __post_init__(self):
        need(not number(self.sigma) or self.sigma > 0, "sigma > 0")

    def check(self) -> Column:
        return col(self.sigma) > 0

    def _excess(self, x: Value) -> tuple[Column, Column, Column]:
        """z, the exponential scale's excess, and whether x is below the upper end point."""
        z = (col(x) - col(self.mu)) / col(self.sigma)
        u = col(self.xi) * z
        below = (1 + u > 0) & (z < float("inf"))
        safe = F.when((z >= 0) & below, u).otherwise(F.lit(0.0))
        return z, z * log1p_over(safe), below

    def logp(self, x: Value) -> Column:
        z, e, below = self._excess(x)
        return bounded((z >= 0) & below, -F.log(col(self.sigma)) - F.log1p(col(self.xi) * z) - e)

    def logcdf(self, x: Value) -> Column:
        z, e, below = self._excess(x)
        return F.when(z < 0, F.lit(NEG_INF)).when(~below, F.lit(0.0)).when(z == 0, F.lit(NEG_INF)).otherwise(log1mexp(-e))

    def logsf(self, x: Value) -> Column:
        z, e, below = self._excess(x)
        return F.when(z < 0, F.lit(0.0)).when(~below, F.lit(NEG_INF)).otherwise(-e)

    def quantile(self, excess: Column) -> Column:
        return col(self.mu) + col(self.sigma) * excess * expm1_over(col(self.xi) * excess)

    def _at(self, q: Value, excess: Column) -> Column:
        end = F.when(col(self.xi) < 0, col(self.mu) - col(self.sigma) / col(self.xi)).otherwise(F.lit(float("inf")))
        return F.when((col(q) < 0) | (col(q) > 1), F.lit(float("nan"))).when(excess == float("inf"), end).otherwise(self.quantile(excess))

    def icdf(self, q: Value) -> Column:
        return self._at(q, F.when(col(q) >= 1, F.lit(float("inf"))).otherwise(-F.log1p(-col(q))))

    def isf(self, q: Value) -> Column:
        return self._at(q, F.when(col(q) <= 0, F.lit(float("inf"))).otherwise(-F.log(col(q))))

    def support_point(self) -> Column:
        return self.icdf(0.5)

    # The transform to the real line: the logit of the distribution function.
    def forward(self, x: Value) -> Column:
        return self.logcdf(x) - self.logsf(x)

    def backward(self, v: Value) -> Column:
        lowest = col(self.mu) + F.abs(col(self.mu)) * (8 * 2.0**-52) + 2.2250738585072014e-308
        return F.greatest(self.quantile(softplus(v)), lowest)

    def log_jac_det(self, v: Value) -> Column:
        return -softplus(v) - softplus(-col(v)) - self.logp(self.backward(v))


@dataclass(frozen=True)
class ExtGenPareto(Distribution):
    """The generalised Pareto distribution function raised to the power kappa > 0."""

    mu: Value = 0.0
    sigma: Value = 1.0
    xi: Value = 0.0
    kappa: Value = 1.0

    def __post_init__(self):
        need(not number(self.sigma) or self.sigma > 0, "sigma > 0")
        need(not number(self.kappa) or self.kappa > 0, "kappa > 0")

    @property
    def base(self) -> GenPareto:
        return GenPareto(self.mu, self.sigma, self.xi)

    def logp(self, x: Value) -> Column:
        kappa = col(self.kappa)
        carrier = F.when(kappa == 1, F.lit(0.0)).otherwise((kappa - 1) * self.base.logcdf(x))
        return F.log(kappa) + carrier + self.base.logp(x)

    def logcdf(self, x: Value) -> Column:
        inner = self.base.logcdf(x)
        return F.when(inner == NEG_INF, F.lit(NEG_INF)).otherwise(col(self.kappa) * inner)

    def logsf(self, x: Value) -> Column:
        """In the deep tail 1 - (1 - s)^kappa is kappa * s up to a relative error of s."""
        deep, near = self.base.logsf(x), log1mexp(self.logcdf(x))
        return F.when(col(x) <= col(self.mu), F.lit(0.0)).when((deep < -36) & (F.log(col(self.kappa)) + deep < -36), F.log(col(self.kappa)) + deep).otherwise(near)

    def _at(self, q: Value, log_q: Column) -> Column:
        excess = -log1mexp(log_q / col(self.kappa))
        return F.when((col(q) < 0) | (col(q) > 1), F.lit(float("nan"))).when(log_q == NEG_INF, col(self.mu)).when(log_q == 0, self.base.icdf(1.0)).otherwise(self.base.quantile(excess))

    def icdf(self, q: Value) -> Column:
        return self._at(q, F.when(col(q) <= 0, F.lit(NEG_INF)).otherwise(F.log(col(q))))

    def isf(self, q: Value) -> Column:
        return self._at(q, F.when(col(q) >= 1, F.lit(NEG_INF)).otherwise(F.log1p(-col(q))))

    def forward(self, x: Value) -> Column:
        return self.logcdf(x) - self.logsf(x)

    def backward(self, v: Value) -> Column:
        """The value whose distribution function has the logit v: ln q is -softplus(-v)."""
        excess = -log1mexp(-softplus(-col(v)) / col(self.kappa))
        return self.base.quantile(excess)

    def log_jac_det(self, v: Value) -> Column:
        return -softplus(v) - softplus(-col(v)) - self.logp(self.backward(v))

    def support_point(self) -> Column:
        return self.backward(0.0)


@dataclass(frozen=True)
class Chi(Distribution):
    nu: Value = 1.0

    def __post_init__(self):
        need(not number(self.nu) or self.nu > 0, "nu > 0")

    def logp(self, x: Value) -> Column:
        x, nu = col(x), col(self.nu)
        safe = F.when(x > 0, x).otherwise(F.lit(1.0))
        return bounded(x > 0, (1 - nu / 2) * math.log(2) + (nu - 1) * F.log(safe) - safe * safe / 2 - lgamma(nu / 2))

    def logcdf(self, x: Value) -> Column:
        x = col(x)
        return bounded(x > 0, F.log(gamma_p(col(self.nu) / 2, x * x / 2)))

    def draw(self, key: Column, seed: int = 0) -> Column:
        return F.sqrt(2 * gamma_draw(col(self.nu) / 2, key, seed))


@dataclass(frozen=True)
class Maxwell(Distribution):
    a: Value = 1.0

    def __post_init__(self):
        need(not number(self.a) or self.a > 0, "a > 0")

    def logp(self, x: Value) -> Column:
        x, a = col(x), col(self.a)
        safe = F.when(x > 0, x).otherwise(F.lit(1.0))
        return bounded(x > 0, 0.5 * math.log(2 / math.pi) + 2 * F.log(safe) - safe * safe / (2 * a * a) - 3 * F.log(a))

    def logcdf(self, x: Value) -> Column:
        z = col(x) / col(self.a)
        return bounded(z > 0, F.log(erf(z / math.sqrt(2)) - math.sqrt(2 / math.pi) * z * F.exp(-z * z / 2)))

    def draw(self, key: Column, seed: int = 0) -> Column:
        return col(self.a) * Chi(3.0).draw(key, seed)


class Discrete(Distribution):
    """Draws by search in a table of the distribution function, made once on the driver from literal parameters."""

    def np_logp(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def draw(self, key: Column, seed: int = 0, lower: int = 0, upper: int = 400) -> Column:
        values = np.arange(lower, upper + 1)
        cdf = np.cumsum(np.exp(self.np_logp(values)))
        table = F.array(*[F.lit(float(c)) for c in cdf[cdf < 1 - 1e-12]])
        u = uniform(key, seed)
        return (F.size(F.filter(table, lambda c: c < u)) + lower).cast("long")


@dataclass(frozen=True)
class GeneralizedPoisson(Discrete):
    """Counts with rate mu whose spread lam makes wider (> 0) or narrower (< 0)."""

    mu: Value = 1.0
    lam: Value = 0.0

    def __post_init__(self):
        need(not number(self.mu) or self.mu > 0, "0 < mu")
        need(not number(self.lam) or abs(self.lam) <= 1, "-1 <= lam <= 1")
        need(not (number(self.mu) and number(self.lam)) or -self.mu / 4 <= self.lam, "-mu/4 <= lam")

    def logp(self, x: Value) -> Column:
        x, mu, lam = col(x), col(self.mu), col(self.lam)
        rate = mu + lam * x
        safe = F.when(rate > 0, rate).otherwise(F.lit(1.0))
        return bounded((x >= 0) & (rate >= 0), F.log(mu) + (x - 1) * F.log(safe) - rate - lgamma(F.greatest(x, F.lit(0.0)) + 1.0))

    def np_logp(self, x: np.ndarray) -> np.ndarray:
        rate = self.mu + self.lam * x
        with np.errstate(invalid="ignore", divide="ignore"):
            out = math.log(self.mu) + (x - 1) * np.log(rate) - rate - np.array([math.lgamma(v + 1) for v in x])
        return np.where(rate > 0, out, NEG_INF)

    def support_point(self) -> Column:
        return F.floor(col(self.mu) / (1 - col(self.lam)))


@dataclass(frozen=True)
class BetaNegativeBinomial(Discrete):
    alpha: Value = 1.0
    beta: Value = 1.0
    r: Value = 1.0

    def __post_init__(self):
        need(all(not number(v) or v > 0 for v in (self.alpha, self.beta, self.r)), "alpha, beta and r > 0")

    def logp(self, x: Value) -> Column:
        k, a, b, r = F.greatest(col(x), F.lit(0.0)), col(self.alpha), col(self.beta), col(self.r)
        return bounded(col(x) >= 0, betaln(r + k, a + b) - betaln(r, a) + lgamma(k + b) - lgamma(k + 1.0) - lgamma(b))

    def np_logp(self, x: np.ndarray) -> np.ndarray:
        g, a, b, r = math.lgamma, self.alpha, self.beta, self.r
        bl = lambda p, q: g(p) + g(q) - g(p + q)
        return np.array([bl(r + k, a + b) - bl(r, a) + g(k + b) - g(k + 1) - g(b) for k in x])


@dataclass(frozen=True)
class Skellam(Discrete):
    """The difference of two Poisson counts."""

    mu1: Value = 1.0
    mu2: Value = 1.0

    def __post_init__(self):
        need(all(not number(v) or v > 0 for v in (self.mu1, self.mu2)), "mu1 and mu2 > 0")

    def logp(self, x: Value) -> Column:
        x, a, b = col(x), col(self.mu1), col(self.mu2)
        return -a - b + 0.5 * x * (F.log(a) - F.log(b)) + log_bessel_i(F.abs(x), 2 * F.sqrt(a * b))

    def draw(self, key: Column, seed: int = 0, lower: int = 0, upper: int = 400) -> Column:
        return GeneralizedPoisson(self.mu1).draw(key, seed, lower, upper) - GeneralizedPoisson(self.mu2).draw(key, seed + 1, lower, upper)


@dataclass(frozen=True)
class Normal(Distribution):
    mu: Value = 0.0
    sigma: Value = 1.0

    def logp(self, x: Value) -> Column:
        return normal_logp(x, self.mu, self.sigma)

    def logcdf(self, x: Value) -> Column:
        z = (col(x) - col(self.mu)) / col(self.sigma)
        return F.log(0.5 * (1 + erf(z / math.sqrt(2))))


@dataclass(frozen=True)
class Poisson(Discrete):
    mu: Value = 1.0

    def logp(self, x: Value) -> Column:
        k = F.greatest(col(x), F.lit(0.0))
        return bounded(col(x) >= 0, k * F.log(col(self.mu)) - col(self.mu) - lgamma(k + 1.0))

    def np_logp(self, x: np.ndarray) -> np.ndarray:
        return x * math.log(self.mu) - self.mu - np.array([math.lgamma(k + 1) for k in x])


@dataclass(frozen=True)
class Exponential(Distribution):
    lam: Value = 1.0

    def logp(self, x: Value) -> Column:
        return bounded(col(x) >= 0, F.log(col(self.lam)) - col(self.lam) * col(x))

    def logcdf(self, x: Value) -> Column:
        return bounded(col(x) > 0, log1mexp(-col(self.lam) * F.greatest(col(x), F.lit(1e-300))))

    def icdf(self, q: Value) -> Column:
        return -F.log1p(-col(q)) / col(self.lam)


@dataclass(frozen=True)
class JointCategorical:
    """States of several places at once: a table of probabilities over k^n combinations, the first place most significant."""

    p: tuple[float, ...]
    k: int
    n: int

    @staticmethod
    def of(p=None, logit_p=None) -> JointCategorical:
        need((p is None) != (logit_p is None), "exactly one of p and logit_p")
        table = np.asarray(p if p is not None else logit_p, dtype=float)
        need(len(set(table.shape)) == 1, "the same number of states in every place")
        if p is None:
            table = np.exp(table - table.max())
        return JointCategorical(tuple((table / table.sum()).ravel().tolist()), table.shape[0], table.ndim)

    def flat(self, *states: Column) -> Column:
        return reduce(lambda a, s: a * self.k + s, states, F.lit(0))

    def logp(self, *states: Column) -> Column:
        table = F.array(*[F.lit(x) for x in self.p])
        inside = reduce(lambda a, s: a & (s >= 0) & (s < self.k), states, F.lit(True))
        return bounded(inside, F.log(F.get(table, self.flat(*states).cast("int"))))

    def draw(self, key: Column, seed: int = 0) -> Column:
        """The states of all places, as an array."""
        bounds = F.array(*[F.lit(float(c)) for c in np.cumsum(self.p)[:-1]])
        u = uniform(key, seed)
        flat = F.size(F.filter(bounds, lambda c: c <= u))
        return F.array(*[F.pmod(F.floor(flat / self.k**i), F.lit(self.k)).cast("int") for i in reversed(range(self.n))])

    def support_point(self) -> list[int]:
        at, out = int(np.argmax(self.p)), []
        for _ in range(self.n):
            at, digit = divmod(at, self.k)
            out.append(digit)
        return out[::-1]
