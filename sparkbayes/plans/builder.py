"""A model with fit and predict: configuration, posterior tables, saving and loading."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators.inference import Fit, fit_laplace, table_target
from ..sources.loader import load_tables, save_tables
from .priors import config_id


class ModelBuilder:
    """Subclasses say what the likelihood and prior are; parameters live on the real line."""

    kind = "ModelBuilder"
    version = "1"

    def __init__(self, model_config: dict | None = None, sampler_config: dict | None = None):
        self.model_config = self.default_model_config() | (model_config or {})
        self.sampler_config = self.default_sampler_config() | (sampler_config or {})
        self.posterior: DataFrame | None = None
        self.fitted: Fit | None = None

    def default_model_config(self) -> dict:
        return {}

    def default_sampler_config(self) -> dict:
        return {"draws": 500, "seed": 0}

    def parameters(self) -> list[str]:
        raise NotImplementedError

    def likelihood(self) -> E.Expr:
        raise NotImplementedError

    def prior(self) -> E.Expr:
        raise NotImplementedError

    def start(self) -> np.ndarray:
        return np.zeros(len(self.parameters()))

    @property
    def id(self) -> str:
        return config_id(self.model_config, self.version, self.kind)

    def get_params(self) -> dict[str, Any]:
        return {"model_config": self.model_config, "sampler_config": self.sampler_config}

    def set_params(self, **p) -> ModelBuilder:
        for k, v in p.items():
            setattr(self, k, getattr(self, k) | v)
        return self

    def fit(self, df: DataFrame) -> ModelBuilder:
        target = table_target(df, self.likelihood(), self.prior(), self.parameters())
        self.fitted = fit_laplace(target, self.start())
        self.posterior = self.fitted.draws(df.sparkSession, self.sampler_config["draws"], seed=self.sampler_config["seed"])
        return self

    def averaged(self, df: DataFrame, of: Callable[[dict[str, Column]], Column], to: str) -> DataFrame:
        """``df`` with the mean of ``of(parameters)`` over the posterior draws, in the column ``to``.

        All draws (as many as ``sampler_config`` says) go along as one row, so each row of ``df`` is averaged where it lies.
        """
        self._check()
        names = self.parameters()
        draws = self.posterior.agg(F.collect_list(F.struct(*names)).alias("_draws"))
        total = F.aggregate("_draws", F.lit(0.0), lambda sum_, d: sum_ + of({n: d[n] for n in names}))
        return df.crossJoin(draws).withColumn(to, total / F.size("_draws")).drop("_draws")

    def _check(self) -> None:
        if self.fitted is None:
            raise RuntimeError("fit the model first")

    def save(self, at: str) -> None:
        self._check()
        spark = self.posterior.sparkSession
        rows = [(n, float(m), [float(x) for x in c]) for n, m, c in zip(self.fitted.names, self.fitted.mean, self.fitted.covariance, strict=True)]
        tables = {"posterior": self.posterior, "fit": spark.createDataFrame(rows, "param string, mean double, covariance array<double>")}
        save_tables(tables, at, {"id": self.id, "model_type": self.kind, "version": self.version, "model_config": self.model_config, "sampler_config": self.sampler_config})

    @classmethod
    def load(cls, spark: SparkSession, at: str) -> ModelBuilder:
        tables, attributes = load_tables(spark, at)
        out = cls(attributes["model_config"], attributes["sampler_config"])
        if out.id != attributes["id"]:
            raise ValueError(f"the saved model has the id {attributes['id']}, not {out.id}: its configuration differs")
        rows = {r["param"]: r for r in tables["fit"].collect()}
        names = out.parameters()
        out.fitted = Fit(names, np.array([rows[n]["mean"] for n in names]), np.array([rows[n]["covariance"] for n in names]), float("nan"))
        out.posterior = tables["posterior"]
        return out


class LinearModel(ModelBuilder):
    """y ~ N(intercept + slope x, sigma): normal priors of the line, half-normal of the noise, on its log scale."""

    kind = "LinearModel"

    def default_model_config(self) -> dict:
        return {"x": "input", "y": "output", "intercept_sd": 10.0, "slope_sd": 10.0, "noise_sd": 2.0}

    def parameters(self) -> list[str]:
        return ["intercept", "slope", "log_noise"]

    def likelihood(self) -> E.Expr:
        c = self.model_config
        return E.normal(E.data(c["y"]), E.param("intercept") + E.param("slope") * E.data(c["x"]), E.exp(E.param("log_noise")))

    def prior(self) -> E.Expr:
        c = self.model_config
        s = E.exp(E.param("log_noise"))
        return E.normal(E.param("intercept"), 0.0, c["intercept_sd"]) + E.normal(E.param("slope"), 0.0, c["slope_sd"]) + E.normal(s, 0.0, c["noise_sd"]) + E.param("log_noise")

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with the posterior mean of the prediction."""
        return self.averaged(df, lambda p: p["intercept"] + p["slope"] * F.col(self.model_config["x"]), "prediction")

    def predict_posterior(self, df: DataFrame, key: str) -> DataFrame:
        """(draw, key, prediction) under each posterior draw; the draws, a parameter of the fit, are what is repeated."""
        self._check()
        from ..functions.special import normal

        pairs = df.select(key, self.model_config["x"]).crossJoin(self.posterior)
        mean = F.col("intercept") + F.col("slope") * F.col(self.model_config["x"])
        return pairs.select("draw", key, (mean + F.exp("log_noise") * normal(F.xxhash64("draw", key), 11)).alias("prediction"))

    def sample_prior(self, spark: SparkSession, n: int = 500, seed: int = 0) -> DataFrame:
        from ..functions.special import normal

        c, key = self.model_config, F.col("draw")
        return spark.range(n).withColumnRenamed("id", "draw").select("draw", (c["intercept_sd"] * normal(key, seed)).alias("intercept"), (c["slope_sd"] * normal(key, seed + 1)).alias("slope"), F.log(F.abs(c["noise_sd"] * normal(key, seed + 2))).alias("log_noise"))


class LogisticModel(ModelBuilder):
    """y ~ Bernoulli(sigmoid(intercept + sum of slopes x)): normal priors of all coefficients."""

    kind = "LogisticModel"

    def default_model_config(self) -> dict:
        return {"x": ["input"], "y": "output", "intercept_sd": 5.0, "slope_sd": 5.0}

    def parameters(self) -> list[str]:
        return ["intercept", *(f"slope_{x}" for x in self.model_config["x"])]

    def likelihood(self) -> E.Expr:
        line = E.param("intercept")
        for x in self.model_config["x"]:
            line = line + E.param(f"slope_{x}") * E.data(x)
        return E.bernoulli_logit(E.data(self.model_config["y"]), line)

    def prior(self) -> E.Expr:
        out = E.normal(E.param("intercept"), 0.0, self.model_config["intercept_sd"])
        for x in self.model_config["x"]:
            out = out + E.normal(E.param(f"slope_{x}"), 0.0, self.model_config["slope_sd"])
        return out

    def chance(self, p: dict[str, Column]) -> Column:
        line = p["intercept"]
        for x in self.model_config["x"]:
            line = line + p[f"slope_{x}"] * F.col(x)
        return 1 / (1 + F.exp(-line))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """``df`` with the chance of a one, the mean over the posterior draws."""
        return self.averaged(df, self.chance, "probability")

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        return self.predict_proba(df).withColumn("prediction", (F.col("probability") >= threshold).cast("int"))

    def predict_posterior(self, df: DataFrame, key: str) -> DataFrame:
        """(draw, key, prediction): a drawn outcome for each row under each posterior draw."""
        self._check()
        from ..functions.special import uniform

        pairs = df.select(key, *self.model_config["x"]).crossJoin(self.posterior)
        hit = uniform(F.xxhash64("draw", key), 13) < self.chance({n: F.col(n) for n in self.parameters()})
        return pairs.select("draw", key, hit.cast("int").alias("prediction"))
