"""Small expressions over parameters and data that know their derivatives and compile to Columns or numpy.

Gradients and Hessians of a log likelihood become further sums of the same aggregate, so one pass over a table gives
the value and all derivatives, with partial sums before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import lgamma, np_lgamma


@dataclass(frozen=True, eq=False)
class Expr:
    op: str
    args: tuple = ()

    def __add__(self, o):
        return add(self, wrap(o))

    __radd__ = __add__

    def __mul__(self, o):
        return mul(self, wrap(o))

    __rmul__ = __mul__

    def __neg__(self):
        return mul(const(-1.0), self)

    def __sub__(self, o):
        return add(self, -wrap(o))

    def __rsub__(self, o):
        return add(wrap(o), -self)

    def __truediv__(self, o):
        return mul(self, power(wrap(o), -1.0))

    def __rtruediv__(self, o):
        return mul(wrap(o), power(self, -1.0))

    def __pow__(self, n: float):
        return power(self, float(n))


def const(x: float) -> Expr:
    return Expr("const", (float(x),))


def param(name: str) -> Expr:
    return Expr("param", (name,))


def data(column: str) -> Expr:
    return Expr("data", (column,))


def wrap(x) -> Expr:
    return x if isinstance(x, Expr) else const(x)


def is_const(e: Expr, value: float | None = None) -> bool:
    return e.op == "const" and (value is None or e.args[0] == value)


def add(a: Expr, b: Expr) -> Expr:
    if is_const(a) and is_const(b):
        return const(a.args[0] + b.args[0])
    return b if is_const(a, 0) else a if is_const(b, 0) else Expr("add", (a, b))


def mul(a: Expr, b: Expr) -> Expr:
    if is_const(a) and is_const(b):
        return const(a.args[0] * b.args[0])
    if is_const(a, 0) or is_const(b, 0):
        return const(0.0)
    return b if is_const(a, 1) else a if is_const(b, 1) else Expr("mul", (a, b))


def power(a: Expr, n: float) -> Expr:
    return const(1.0) if n == 0 else a if n == 1 else const(a.args[0] ** n) if is_const(a) else Expr("pow", (a, n))


def unary(op: str) -> Callable[[Expr | float], Expr]:
    return lambda a: Expr(op, (wrap(a),))


exp, log, log1p, loggamma, digamma, sigmoid, softplus = map(unary, ("exp", "log", "log1p", "lgamma", "digamma", "sigmoid", "softplus"))


def derivative(e: Expr, name: str) -> Expr:
    if e.op in ("const", "data"):
        return const(0.0)
    if e.op == "param":
        return const(1.0 if e.args[0] == name else 0.0)
    if e.op == "add":
        return derivative(e.args[0], name) + derivative(e.args[1], name)
    if e.op == "mul":
        return derivative(e.args[0], name) * e.args[1] + e.args[0] * derivative(e.args[1], name)
    inner = derivative(e.args[0], name)
    if is_const(inner, 0):
        return inner
    a = e.args[0]
    outer = {
        "pow": lambda: e.args[1] * power(a, e.args[1] - 1) if e.op == "pow" else None,
        "exp": lambda: e,
        "log": lambda: power(a, -1.0),
        "log1p": lambda: power(1 + a, -1.0),
        "lgamma": lambda: digamma(a),
        "sigmoid": lambda: e * (1 - e),
        "softplus": lambda: sigmoid(a),
    }
    if e.op not in outer:
        raise ValueError(f"no derivative of {e.op}")
    return outer[e.op]() * inner


def has_data(e: Expr) -> bool:
    return e.op == "data" or any(isinstance(a, Expr) and has_data(a) for a in e.args)


def column(e: Expr, params: dict[str, float]) -> Column:
    """The expression over a table's rows; what needs no row is computed here and enters as a literal."""
    go = lambda x: column(x, params)
    if not has_data(e):
        with np.errstate(all="ignore"):
            return F.lit(float(evaluate(e, params)))
    if e.op == "const":
        return F.lit(e.args[0])
    if e.op == "param":
        return F.lit(float(params[e.args[0]]))
    if e.op == "data":
        return F.col(e.args[0]).cast("double")
    if e.op == "add":
        return go(e.args[0]) + go(e.args[1])
    if e.op == "mul":
        return go(e.args[0]) * go(e.args[1])
    a = go(e.args[0])
    if e.op == "pow":
        return a * a if e.args[1] == 2 else 1 / a if e.args[1] == -1 else F.pow(a, F.lit(e.args[1]))
    if e.op == "digamma":
        big = a + 6.0
        series = F.log(big) - 0.5 / big - 1 / (12 * big * big) + 1 / (120 * F.pow(big, F.lit(4))) - 1 / (252 * F.pow(big, F.lit(6)))
        return series - (1 / a + 1 / (a + 1) + 1 / (a + 2) + 1 / (a + 3) + 1 / (a + 4) + 1 / (a + 5))
    return {"exp": F.exp, "log": F.log, "log1p": F.log1p, "lgamma": lgamma, "sigmoid": lambda x: 1 / (1 + F.exp(-x)), "softplus": lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))}[e.op](a)


def evaluate(e: Expr, params: dict[str, float | np.ndarray], rows: dict[str, np.ndarray] | None = None) -> np.ndarray:
    go = lambda x: evaluate(x, params, rows)
    if e.op == "const":
        return np.float64(e.args[0])
    if e.op == "param":
        return np.asarray(params[e.args[0]], dtype=float)
    if e.op == "data":
        return np.asarray((rows or {})[e.args[0]], dtype=float)
    if e.op == "add":
        return go(e.args[0]) + go(e.args[1])
    if e.op == "mul":
        return go(e.args[0]) * go(e.args[1])
    a = go(e.args[0])
    if e.op == "pow":
        return a ** e.args[1]
    if e.op == "digamma":
        h = 1e-5
        return (np_lgamma(a + h) - np_lgamma(a - h)) / (2 * h)
    return {"exp": np.exp, "log": np.log, "log1p": np.log1p, "lgamma": np_lgamma, "sigmoid": lambda x: 1 / (1 + np.exp(-x)), "softplus": lambda x: np.logaddexp(0, x)}[e.op](a)


def names(e: Expr) -> set[str]:
    return {e.args[0]} if e.op == "param" else set().union(*[names(a) for a in e.args if isinstance(a, Expr)])


def normal(x: Expr, mu, sigma) -> Expr:
    z = (x - wrap(mu)) / wrap(sigma)
    return -0.5 * z * z - log(wrap(sigma)) - 0.5 * math.log(2 * math.pi)


def poisson(x: Expr, log_rate) -> Expr:
    return x * wrap(log_rate) - exp(wrap(log_rate)) - loggamma(x + 1.0)


def bernoulli_logit(x: Expr, logit) -> Expr:
    return x * wrap(logit) - softplus(wrap(logit))
