"""Streams: windowed statistics with late data, and a Kalman filter that carries each series' state from batch to batch."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEVEL = "series long, n long, level double, variance double, loglike double"


def windowed(stream: DataFrame, time: str, value: str, *, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """Count, mean and standard deviation per window; rows later than ``late`` behind the newest are dropped with their windows' state."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(window, *(keys or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def online_level(stream: DataFrame, series: str, time: str, value: str, *, a0: float, P0: float, H: float, Q: float, phi: float = 1.0) -> DataFrame:
    """(series, n, level, variance, loglike) after each micro-batch: a scalar filter whose state is the prediction for the next value.

    Rows of a batch are taken in order of time; what a later batch brings counts as later.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, a, P, ll = state.get if state.exists else (0, a0, P0, 0.0)
        rows = pd.concat(parts).sort_values(time)
        for y in rows[value]:
            if y is not None and not math.isnan(y):
                f = P + H
                v, k = y - a, P / f
                a, P = a + k * v, P * (1 - k)
                ll += -0.5 * (math.log(2 * math.pi) + math.log(f) + v * v / f)
            a, P, n = phi * a, phi * phi * P + Q, n + 1
        state.update((n, a, P, ll))
        yield pd.DataFrame({"series": [key[0]], "n": [n], "level": [a], "variance": [P], "loglike": [ll]})

    return stream.groupBy(series).applyInPandasWithState(step, LEVEL, "n long, a double, P double, ll double", "update", GroupStateTimeout.NoTimeout)
