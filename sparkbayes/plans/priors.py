"""Priors as data: named distributions with parameters and dimensions, read from and written to plain dictionaries.

A drawn prior is a DataFrame with one key column for each of its dimensions. Arithmetic between priors of different
dimensions is a join on the dimensions they share; a dimension that one of them lacks is met by repetition.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.special import Value, col, gamma_draw, normal, uniform

#: Names of distributions and their parameters, in order.
KNOWN: dict[str, tuple[str, ...]] = {
    "Normal": ("mu", "sigma"),
    "HalfNormal": ("sigma",),
    "Exponential": ("lam",),
    "Uniform": ("lower", "upper"),
    "Gamma": ("alpha", "beta"),
    "Beta": ("alpha", "beta"),
    "StudentT": ("nu", "mu", "sigma"),
    "ZeroSumNormal": ("sigma",),
    "Poisson": ("mu",),
    "GenExtreme": ("mu", "sigma", "xi"),
    "GenPareto": ("mu", "sigma", "xi"),
    "Deterministic": ("value",),
}
NON_CENTERED = {"Normal", "StudentT", "ZeroSumNormal"}
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "exp": F.exp,
    "log": F.log,
    "sqrt": F.sqrt,
    "abs": F.abs,
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "square": lambda x: x * x,
    "reciprocal": lambda x: 1 / x,
}


class UnsupportedDistributionError(ValueError):
    pass


class UnsupportedShapeError(ValueError):
    pass


class UnknownTransformError(ValueError):
    pass


def register_transform(name: str, function: Callable[[Column], Column]) -> None:
    """Make a function of Columns known to priors by name."""
    TRANSFORMS[name] = function


@dataclass(frozen=True)
class Prior:
    distribution: str
    parameters: dict[str, Any] = field(default_factory=dict)
    dims: tuple[str, ...] = ()
    centered: bool = True
    transform: str | None = None

    def __init__(self, distribution: str, *, dims: str | tuple[str, ...] | list[str] | None = None, centered: bool = True, transform: str | None = None, **parameters):
        put = lambda k, v: object.__setattr__(self, k, v)
        put("distribution", distribution)
        put("parameters", parameters)
        put("dims", (dims,) if isinstance(dims, str) else tuple(dims or ()))
        put("centered", centered)
        put("transform", transform)
        if distribution not in KNOWN:
            raise UnsupportedDistributionError(f"distribution {distribution!r} is not known; known are {sorted(KNOWN)}")
        if not {*parameters} <= {*KNOWN[distribution]}:
            raise ValueError(f"parameters {sorted(parameters)} must be among {KNOWN[distribution]}")
        for k, v in parameters.items():
            if not isinstance(v, (int, float, Prior, DataFrame)) or isinstance(v, bool):
                raise ValueError(f"parameter {k} must be a number, a prior or a table")
        if transform is not None and transform not in TRANSFORMS:
            raise UnknownTransformError(f"transform {transform!r} is not known")
        if not centered and (distribution not in NON_CENTERED or {*parameters} < {"mu", "sigma"} and distribution == "Normal"):
            raise ValueError(f"{distribution} with {sorted(parameters)} has no non-centered form")
        for child in parameters.values():
            if isinstance(child, Prior) and not {*child.dims} <= {*self.dims}:
                raise UnsupportedShapeError(f"dimensions {child.dims} of a parameter must be among {self.dims}")

    # --- dictionaries

    def to_dict(self) -> dict:
        if any(isinstance(v, DataFrame) for v in self.parameters.values()):
            raise ValueError("a table has no dictionary")
        out: dict[str, Any] = {"dist": self.distribution}
        if self.parameters:
            out["kwargs"] = {k: v.to_dict() if isinstance(v, (Prior, Censored, Scaled)) else v for k, v in self.parameters.items()}
        if not self.centered:
            out["centered"] = False
        if self.dims:
            out["dims"] = self.dims
        if self.transform:
            out["transform"] = self.transform
        return out

    @classmethod
    def from_dict(cls, data: dict) -> Prior:
        if not isinstance(data, dict) or "dist" not in data:
            raise ValueError("a prior's dictionary has the key 'dist'")
        kwargs = {k: deserialize(v) if isinstance(v, dict) else v for k, v in data.get("kwargs", {}).items()}
        return cls(data["dist"], dims=data.get("dims"), centered=data.get("centered", True), transform=data.get("transform"), **kwargs)

    # --- draws

    def sample(self, spark: SparkSession, coords: dict[str, list] | None = None, *, draws: int = 1000, name: str = "x", seed: int = 0) -> DataFrame:
        """(draw, dims.., name and its parameters' columns): draws by key, so they don't depend on partitions."""
        coords = coords or {}
        missing = [d for d in self.dims if d not in coords]
        if missing:
            raise KeyError(f"coordinates of {missing} are missing")
        out = spark.range(draws).withColumnRenamed("id", "draw")
        for d in self.dims:
            # A dimension's labels are literals of the model, so repeating draws over them is an explode, not a join.
            out = out.withColumn(d, F.explode(F.array(*[F.lit(x) for x in coords[d]])))
        values: dict[str, Column] = {}
        for i, (k, v) in enumerate(self.parameters.items()):
            if isinstance(v, Prior):
                child = v.sample(spark, coords, draws=draws, name=f"{name}_{k}", seed=seed * 31 + i + 1)
                out = out.join(child, ["draw", *v.dims])
                values[k] = F.col(f"{name}_{k}")
            elif isinstance(v, DataFrame):
                shared = [c for c in v.columns if c in self.dims]
                out = out.join(v.withColumnRenamed("value", f"{name}_{k}"), shared)
                values[k] = F.col(f"{name}_{k}")
            else:
                values[k] = F.lit(float(v))
        key = F.xxhash64("draw", *self.dims, F.lit(name))
        raw = f"{name}_raw" if self.transform else name
        if not self.centered:
            base = self._draw({k: v for k, v in values.items() if k == "nu"}, key, seed)
            out = out.withColumn(f"{name}_offset", base)
            out = out.withColumn(raw, values.get("mu", F.lit(0.0)) + values["sigma"] * F.col(f"{name}_offset"))
        else:
            out = out.withColumn(raw, self._draw(values, key, seed))
        return out.withColumn(name, TRANSFORMS[self.transform](F.col(raw))) if self.transform else out

    def _draw(self, p: dict[str, Column], key: Column, seed: int) -> Column:
        get = lambda k, default: p.get(k, F.lit(default))
        if self.distribution in ("Normal", "ZeroSumNormal"):
            return get("mu", 0.0) + get("sigma", 1.0) * normal(key, seed)
        if self.distribution == "HalfNormal":
            return F.abs(get("sigma", 1.0) * normal(key, seed))
        if self.distribution == "Exponential":
            return -F.log(uniform(key, seed)) / get("lam", 1.0)
        if self.distribution == "Uniform":
            return get("lower", 0.0) + (get("upper", 1.0) - get("lower", 0.0)) * uniform(key, seed)
        if self.distribution == "Deterministic":
            return p["value"]
        if self.distribution == "GenExtreme":
            return D.GenExtreme(get("mu", 0.0), get("sigma", 1.0), get("xi", 0.0)).draw(key, seed)
        if self.distribution == "GenPareto":
            return D.GenPareto(get("mu", 0.0), get("sigma", 1.0), get("xi", 0.0)).draw(key, seed)
        if self.distribution == "StudentT":
            return get("mu", 0.0) + get("sigma", 1.0) * normal(key, seed) / F.sqrt(gamma_draw(get("nu", 4.0) / 2, key, seed + 17) * 2 / get("nu", 4.0))
        if self.distribution == "Gamma":
            return gamma_draw(get("alpha", 1.0), key, seed) / get("beta", 1.0)
        if self.distribution == "Beta":
            a, b = gamma_draw(get("alpha", 1.0), key, seed), gamma_draw(get("beta", 1.0), key, seed + 29)
            return a / (a + b)
        if self.distribution == "Poisson":
            mu = self.parameters.get("mu", 1.0)
            if not isinstance(mu, (int, float)):
                raise UnsupportedDistributionError("draws of counts need a number as rate")
            return D.Poisson(float(mu)).draw(key, seed).cast("double")
        raise UnsupportedDistributionError(self.distribution)

    def logp(self, value: Column, **given: Value) -> Column:
        """Log density of a value; parameters that are priors are given as Columns."""
        p = {k: col(given.get(k, v)) if not isinstance(given.get(k, v), Prior) else F.col(k) for k, v in self.parameters.items()}
        get = lambda k, default: p.get(k, F.lit(default))
        if self.distribution == "Normal":
            return D.Normal(get("mu", 0.0), get("sigma", 1.0)).logp(value)
        if self.distribution == "HalfNormal":
            return F.when(value >= 0, math.log(2) + D.Normal(0.0, get("sigma", 1.0)).logp(value)).otherwise(F.lit(float("-inf")))
        if self.distribution == "Exponential":
            return D.Exponential(get("lam", 1.0)).logp(value)
        if self.distribution == "Uniform":
            inside = (value >= get("lower", 0.0)) & (value <= get("upper", 1.0))
            return F.when(inside, -F.log(get("upper", 1.0) - get("lower", 0.0))).otherwise(F.lit(float("-inf")))
        if self.distribution == "Poisson":
            return D.Poisson(get("mu", 1.0)).logp(value)
        if self.distribution == "GenExtreme":
            return D.GenExtreme(get("mu", 0.0), get("sigma", 1.0), get("xi", 0.0)).logp(value)
        if self.distribution == "GenPareto":
            return D.GenPareto(get("mu", 0.0), get("sigma", 1.0), get("xi", 0.0)).logp(value)
        if self.distribution in ("Gamma", "Beta", "StudentT"):
            from ..functions.special import betaln, lgamma

            if self.distribution == "Gamma":
                a, b = get("alpha", 1.0), get("beta", 1.0)
                return a * F.log(b) + (a - 1) * F.log(value) - b * value - lgamma(a)
            if self.distribution == "Beta":
                a, b = get("alpha", 1.0), get("beta", 1.0)
                return (a - 1) * F.log(value) + (b - 1) * F.log1p(-value) - betaln(a, b)
            nu, z = get("nu", 4.0), (value - get("mu", 0.0)) / get("sigma", 1.0)
            return lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * F.log(nu * math.pi) - F.log(get("sigma", 1.0)) - (nu + 1) / 2 * F.log1p(z * z / nu)
        raise UnsupportedDistributionError(self.distribution)

    def likelihood(self, mu: Prior | float, **more) -> Prior:
        """This distribution around another mean, for data."""
        if "mu" not in KNOWN[self.distribution]:
            raise UnsupportedDistributionError(f"{self.distribution} has no parameter mu")
        if "mu" in self.parameters:
            raise ValueError("mu is set already")
        return Prior(self.distribution, dims=self.dims, centered=self.centered, transform=self.transform, **{**self.parameters, "mu": mu, **more})

    def constrain(self, lower: float, upper: float, mass: float = 0.95) -> Prior:
        """Parameters such that [lower, upper] holds ``mass``, equal parts of the rest on either side."""
        tail = (1 - mass) / 2
        from ..functions.special import np_erfinv

        z = float(math.sqrt(2) * np_erfinv(1 - 2 * tail))
        if self.distribution == "Normal":
            return Prior("Normal", dims=self.dims, mu=(lower + upper) / 2, sigma=(upper - lower) / (2 * z))
        if self.distribution == "HalfNormal":
            return Prior("HalfNormal", dims=self.dims, sigma=upper / float(math.sqrt(2) * np_erfinv(mass)))
        if self.distribution == "Exponential":
            return Prior("Exponential", dims=self.dims, lam=-math.log(1 - mass) / upper)
        if self.distribution == "Uniform":
            wide = (upper - lower) / mass
            return Prior("Uniform", dims=self.dims, lower=lower - (wide - upper + lower) / 2, upper=upper + (wide - upper + lower) / 2)
        raise UnsupportedDistributionError(f"constrain doesn't know {self.distribution}")

    def __str__(self) -> str:
        return f'Prior("{self.distribution}", {", ".join(f"{k}={v}" for k, v in self.parameters.items())})'


@dataclass(frozen=True)
class Censored:
    """A prior whose values beyond the bounds are seen at the bounds."""

    distribution: Prior
    lower: float | None = None
    upper: float | None = None

    @property
    def dims(self) -> tuple[str, ...]:
        return self.distribution.dims

    def clip(self, x: Column) -> Column:
        x = F.greatest(x, F.lit(float(self.lower))) if self.lower is not None else x
        return F.least(x, F.lit(float(self.upper))) if self.upper is not None else x

    def sample(self, spark: SparkSession, coords=None, *, draws: int = 1000, name: str = "x", seed: int = 0) -> DataFrame:
        out = self.distribution.sample(spark, coords, draws=draws, name=name, seed=seed)
        return out.withColumn(name, self.clip(F.col(name)))

    def logp(self, x: Column, logcdf: Callable[[Value], Column], **given: Value) -> Column:
        """Density inside, the tail's mass at a bound; ``logcdf`` is of the uncensored distribution."""
        from ..functions.special import log1mexp

        out = self.distribution.logp(x, **given)
        if self.lower is not None:
            out = F.when(x < self.lower, F.lit(float("-inf"))).when(x == self.lower, logcdf(self.lower)).otherwise(out)
        if self.upper is not None:
            out = F.when(x > self.upper, F.lit(float("-inf"))).when(x == self.upper, log1mexp(logcdf(self.upper))).otherwise(out)
        return out

    def to_dict(self) -> dict:
        return {"class": "Censored", "data": {"dist": self.distribution.to_dict(), "lower": self.lower, "upper": self.upper}}

    @classmethod
    def from_dict(cls, data: dict) -> Censored:
        data = data["data"]
        return cls(deserialize(data["dist"]), data.get("lower"), data.get("upper"))


@dataclass(frozen=True)
class Scaled:
    """A prior times a factor."""

    distribution: Prior
    factor: float

    @property
    def dims(self) -> tuple[str, ...]:
        return self.distribution.dims

    def sample(self, spark: SparkSession, coords=None, *, draws: int = 1000, name: str = "x", seed: int = 0) -> DataFrame:
        out = self.distribution.sample(spark, coords, draws=draws, name=f"{name}_unscaled", seed=seed)
        return out.withColumn(name, F.col(f"{name}_unscaled") * self.factor)

    def to_dict(self) -> dict:
        return {"class": "Scaled", "data": {"dist": self.distribution.to_dict(), "factor": self.factor}}

    @classmethod
    def from_dict(cls, data: dict) -> Scaled:
        return cls(deserialize(data["data"]["dist"]), data["data"]["factor"])


#: (applies, makes), the first that applies wins.
REGISTRY: list[tuple[Callable[[Any], bool], Callable[[Any], Any]]] = []


def register_deserialization(applies: Callable[[Any], bool], makes: Callable[[Any], Any]) -> None:
    REGISTRY.append((applies, makes))


class DeserializableError(Exception):
    pass


def deserialize(data: Any) -> Any:
    for applies, makes in REGISTRY:
        try:
            fits = applies(data)
        except Exception:  # a test that can't read the data doesn't apply to it
            fits = False
        if fits:
            return makes(data)
    raise DeserializableError(f"no registered reader for {data!r}")


register_deserialization(lambda d: d.get("class") == "Censored", Censored.from_dict)
register_deserialization(lambda d: d.get("class") == "Scaled", Scaled.from_dict)
register_deserialization(lambda d: "dist" in d, Prior.from_dict)


def align(tables: dict[str, DataFrame], dims: dict[str, tuple[str, ...]], labels: dict[str, DataFrame]) -> DataFrame:
    """All tables side by side on the union of their dimensions: joined on those they share, repeated over labels of the others.

    tables: each with its dimensions' key columns and a column of its own name. labels: one-column tables of the dimensions' labels.
    """
    every = [*dict.fromkeys(d for x in dims.values() for d in x)]
    unknown = [d for d in every if d not in labels]
    if unknown:
        raise UnsupportedShapeError(f"labels of {unknown} are missing")
    order = sorted(tables, key=lambda t: -len(dims[t]))
    out, have = tables[order[0]], [*dims[order[0]]]
    for t in order[1:]:
        shared = [d for d in dims[t] if d in have]
        out = out.join(tables[t], shared) if shared else out.crossJoin(F.broadcast(tables[t])) if not dims[t] else out.crossJoin(tables[t])  # no shared dimension: the product is the result asked for
        have += [d for d in dims[t] if d not in have]
    return out


def config_id(config: dict, version: str, kind: str) -> str:
    """Sixteen hexadecimal digits of a hash of a configuration's values, a version and a type."""
    h = hashlib.sha256()
    h.update(json.dumps([config[k] for k in sorted(config)], sort_keys=True, default=str).encode())
    h.update(version.encode())
    h.update(kind.encode())
    return h.hexdigest()[:16]


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
