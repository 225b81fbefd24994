"""Special functions as Column expressions, with numpy twins for driver-side kernels.

Every Column stays inside whole-stage code generation, except the few series that fold over a literal range.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | float | int

# Lanczos' approximation of the gamma function for g = 7 with nine coefficients.
LANCZOS_G = 7.0
LANCZOS = [
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
]
HALF_LN_2PI = 0.5 * math.log(2 * math.pi)
NEG_INF = float("-inf")


def col(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def lgamma(x: Value) -> Column:
    """ln of the gamma function for x > 0."""
    x = col(x)
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (x + float(i))
    t = x + (LANCZOS_G + 0.5)
    return HALF_LN_2PI + (x + 0.5) * F.log(t) - t + F.log(series) - F.log(x)


def betaln(a: Value, b: Value) -> Column:
    a, b = col(a), col(b)
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def log1mexp(x: Value) -> Column:
    """ln(1 - exp(x)) for x <= 0."""
    x = col(x)
    return F.when(x > -math.log(2), F.log(-F.expm1(x))).otherwise(F.log1p(-F.exp(x)))


def softplus(x: Value) -> Column:
    x = col(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def logsumexp(values: Column) -> Column:
    """ln of the sum of exponentials of an array; the array is read twice, so pass a column rather than a long expression."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.when(top == NEG_INF, F.lit(NEG_INF)).otherwise(top + F.log(total))


def bound(x: Column, of) -> Column:
    """``of(x)`` with x worked out once for a row, however often it is read."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def gamma_p(a: Value, x: Value) -> Column:
    """Regularised lower incomplete gamma function by its power series, summed from its smallest term that counts.

    Terms behind the x-th fall off like those of a Poisson distribution of mean x, so x - a plus ten of its standard deviations
    and some more are enough; where x is further than that above a, the function is one.
    """
    a, x = col(a), col(x)

    def of(x: Column) -> Column:
        spread = 10 * F.sqrt(x) + 40
        terms = F.ceil(F.greatest(x - a, F.lit(0.0)) + spread).cast("int")
        series = F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), F.lit(1.0), lambda s, k: 1 + s * x / (a + k))
        return F.when(x <= 0, F.lit(0.0)).when(x - a > spread, F.lit(1.0)).when(x.isNotNull(), F.least(F.lit(1.0), series * F.exp(a * F.log(x) - x - lgamma(a + 1.0))))

    return bound(x.cast("double"), of)


def erf(x: Value) -> Column:
    x = col(x)
    return F.signum(x) * gamma_p(0.5, x * x)


def log_bessel_i(order: Value, x: Value, terms: int = 200) -> Column:
    """ln of the modified Bessel function of the first kind, integer order >= 0, by its power series scaled by its first term."""
    order, x = col(order), col(x)
    quarter = x * x / 4.0
    state = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        state,
        lambda s, k: F.struct((s["term"] * quarter / (k * (order + k))).alias("term"), (s["total"] + s["term"] * quarter / (k * (order + k))).alias("total")),
        lambda s: s["total"],
    )
    return order * F.log(x / 2.0) - lgamma(order + 1.0) + F.log(series)


def normal_logp(x: Value, mu: Value, sigma: Value) -> Column:
    x, mu, sigma = col(x), col(mu), col(sigma)
    z = (x - mu) / sigma
    return -0.5 * z * z - F.log(sigma) - HALF_LN_2PI


def uniform(key: Column, seed: int) -> Column:
    """A uniform number in (0, 1) that depends on key and seed alone, not on partitions."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def normal(key: Column, seed: int) -> Column:
    """A standard normal number by key, after Box and Muller."""
    return F.sqrt(-2.0 * F.log(uniform(key, seed))) * F.cos(2 * math.pi * uniform(key, seed + 7919))


def gamma_draw(alpha: Column, key: Column, seed: int, tries: int = 8) -> Column:
    """A gamma variable by Marsaglia and Tsang: the first accepted of a few proposals by key; shapes below one are boosted."""
    boosted = F.when(alpha < 1, alpha + 1).otherwise(alpha)
    d = boosted - 1.0 / 3
    c = 1 / F.sqrt(9 * d)
    value = d
    for i in range(tries - 1, -1, -1):
        x, u = normal(key, seed + 1009 * i), uniform(key, seed + 1009 * i + 503)
        v = F.pow(1 + c * x, F.lit(3))
        ok = (1 + c * x > 0) & (F.log(u) < 0.5 * x * x + d - d * v + d * F.log(F.greatest(v, F.lit(1e-300))))
        value = F.when(ok, d * v).otherwise(value)
    return F.when(alpha < 1, value * F.pow(uniform(key, seed + 77), 1 / alpha)).otherwise(value)


np_lgamma = np.vectorize(math.lgamma, otypes=[float])
np_erf = np.vectorize(math.erf, otypes=[float])


def np_erfinv(y: np.ndarray | float) -> np.ndarray:
    """Inverse error function: a start in closed form, then Newton steps."""
    y = np.asarray(y, dtype=float)
    a = 0.147
    ln = np.log(np.maximum(1 - y * y, 1e-300))
    first = 2 / (math.pi * a) + ln / 2
    x = np.sign(y) * np.sqrt(np.maximum(np.sqrt(first * first - ln / a) - first, 0))
    for _ in range(4):
        x = x - (np_erf(x) - y) / (2 / math.sqrt(math.pi) * np.exp(-x * x))
    return np.where(np.abs(y) >= 1, np.where(y > 0, np.inf, -np.inf), x)


def np_logsumexp(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    safe = np.where(np.isfinite(top), top, 0.0)
    out = np.log(np.sum(np.exp(x - safe), axis=axis, keepdims=True)) + safe
    return out.reshape(()) if axis is None else np.squeeze(out, axis=axis)
