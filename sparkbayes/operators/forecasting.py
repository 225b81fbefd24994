"""Forecasts of many series, from any time, under scenarios of what drives them, and under draws of parameters.

Training rows and a scenario's rows are one table ordered by time in each series; the model is built over the whole of it, so
matrices that vary with time go on into the future. The state that a forecast starts from is the filter's or smoother's at
the start; what follows it in the training rows gives regressors there, and observations only to the smoother.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import side_by_side
from .statespace import MATRICES, StateSpace, forecast, kalman, kind_of, psd_root, simulate, smooth

OUTPUTS = ("filtered", "predicted", "smoothed")


def starting_state(model: StateSpace, y: np.ndarray, at: int, output: str) -> tuple[np.ndarray, np.ndarray]:
    f = kalman(model, y)
    if output == "predicted":
        return f.predicted[at], f.predicted_cov[at]
    if output == "filtered":
        return f.filtered[at], f.filtered_cov[at]
    a, P = smooth(model, f)
    return a[at], P[at]


def spine(df: DataFrame, scenario: DataFrame | None, series: str, time: str, observed: Sequence[str], regressors: Sequence[str]) -> DataFrame:
    """(series, rows): observed rows and the scenario's, in order of time. A scenario without the series' column is every series' own."""
    numbers = lambda names, found: F.array(*[F.col(n).cast("double") if n in found else F.lit(None).cast("double") for n in names])
    shown = lambda d, future: d.select(series, F.struct(F.col(time).alias("time"), F.lit(future).alias("future"), numbers(observed, [] if future else d.columns).alias("y"), numbers(regressors, d.columns).alias("x")).alias("row"))
    rows = shown(df, False)
    if scenario is not None:
        if series not in scenario.columns:
            scenario = df.select(series).distinct().crossJoin(scenario)
        scenario = scenario.join(df.groupBy(series).agg(F.max(time).alias("_last")), series).where(F.col(time) > F.col("_last"))
        rows = rows.unionByName(shown(scenario, True))
    return rows.groupBy(series).agg(F.array_sort(F.collect_list("row")).alias("rows"))


def forecasts(
    df: DataFrame, build: Callable[..., StateSpace], series: str, time: str, observed: Sequence[str], *, regressors: Sequence[str] = (), scenario: DataFrame | None = None, start: Any = None, periods: int | None = None, end: Any = None,
    output: str = "smoothed", draws: DataFrame | None = None, paths: bool = False, seed: int = 0,
) -> DataFrame:
    """(series, [draw,] step, time, mean, cov), or with ``paths`` (series, draw, step, time, state, observed).

    build(parameters, X): the model; X holds the regressors of all rows, scenario's included, or is None.
    start: the time to forecast from, the series' last one if None; periods, or end (a time, included), or all of the scenario.
    draws: ``draw`` and parameters, each row a forecast of its own; without it, parameters are empty.
    time: of the forecast row, where training rows or the scenario tell it; else null.
    """
    if output not in OUTPUTS:
        raise ValueError(f"output {output!r}, not one of {OUTPUTS}")
    if periods is not None and end is not None:
        raise ValueError("periods or end, not both")
    if periods is None and end is None and scenario is None:
        raise ValueError("periods, end or a scenario is needed")
    if regressors and scenario is None and start is None:
        raise ValueError(f"a scenario of {list(regressors)} is needed")
    if missing := [c for c in regressors if c not in df.columns or scenario is not None and c not in scenario.columns]:
        raise ValueError(f"{missing} are not in the rows or the scenario")
    if paths and draws is None:
        raise ValueError("paths need draws")
    whole = spine(df, scenario, series, time, observed, regressors)
    if draws is not None:
        whole = whole.crossJoin(draws).repartition(F.col(series), F.col("draw"))
    drawn = draws is not None
    parameters = [c for c in draws.columns if c != "draw"] if drawn else []
    pick_start = _comparable(start)
    pick_end = _comparable(end)

    def prepared(key, row: slice, flat: dict, values: dict) -> tuple[StateSpace, np.ndarray, int, int]:
        """(model, observations, where the forecast starts, its steps) of one series."""
        future, n = flat["future"][row], row.stop - row.start
        known = int(np.argmax(future)) if future.any() else n
        y, X = flat["y"][row][:known], flat["x"][row] if regressors else None
        if X is not None and np.isnan(X).any():
            raise ValueError(f"regressors of series {key} are missing")
        at, times = known - 1, [_comparable(x) for x in flat["told"][row]] if flat["told"] is not None else []
        if pick_start is not None:
            if pick_start not in times[:known]:
                raise ValueError(f"series {key} has no row at {start}")
            at = times.index(pick_start)
        if pick_end is not None:
            if pick_end not in times or times.index(pick_end) <= at:
                raise ValueError(f"series {key} has no row at {end} after the start")
            steps = times.index(pick_end) - at
        else:
            steps = periods if periods is not None else n - 1 - at
        if X is not None and at + steps >= n:
            raise ValueError(f"series {key} has regressors for {n - 1 - at} of {steps} steps")
        return build(values, X), y, at, steps

    names = ["mean", "cov"] if not paths else ["state", "observed"]
    head = [series] + (["draw"] if drawn else [])

    def made(batch: pa.RecordBatch, some: np.ndarray, ends: np.ndarray, flat: dict, time_: pa.Array) -> pa.RecordBatch:
        """Forecasts of some series of a batch, their filters side by side where the models' sizes agree."""
        keys = [batch.column(series)[int(i)].as_py() for i in some]
        ready = [prepared(key, slice(ends[i], ends[i + 1]), flat, {k: float(batch.column(k)[int(i)].as_py()) for k in parameters}) for key, i in zip(keys, some, strict=True)]
        states: dict[int, tuple] = {}
        for m in {x[0].m for x in ready}:
            own = [j for j, x in enumerate(ready) if x[0].m == m]
            found = starting_states([ready[j][0] for j in own], [ready[j][1] for j in own], [ready[j][2] for j in own], output)
            states |= dict(zip(own, found, strict=True))
        rows, step, when, columns = [], [], [], ([], [])
        for j, (model, _, at, steps) in enumerate(ready):
            if not paths:
                told = forecast(model, *states[j], steps, start=at)
            else:
                number = int(batch.column("draw")[int(some[j])].as_py()) if drawn else 0
                told = path(model, *states[j], at, steps, np.random.default_rng([seed, number, zlib.crc32(str(keys[j]).encode())]))
            first, last = ends[some[j]], ends[some[j] + 1]
            rows += [int(some[j])] * steps
            step += range(1, steps + 1)
            when += [int(first) + at + 1 + s if first + at + 1 + s < last else None for s in range(steps)]
            for to, x in zip(columns, told, strict=True):
                to += [np.ravel(v) for v in x]
        told = [pa.array([v.tolist() for v in c], pa.list_(pa.float64())) for c in columns]
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows, pa.int64())) for c in head), pa.array(step, pa.int32()), time_.take(pa.array(when, pa.int64())), *told], names=[*head, "step", "time", *names])

    def run(batches):
        for batch in batches:
            column = batch.column("rows")
            ends = column.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            fields = column.flatten()
            parts = dict(zip([f.name for f in fields.type], fields.flatten(), strict=True))
            flat = {k: parts[k].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(fields), -1) for k in ("y", "x")}
            flat["future"] = parts["future"].to_numpy(zero_copy_only=False)
            flat["told"] = _times(parts["time"]) if pick_start is not None or pick_end is not None else None
            size = np.diff(ends)
            for some in side_by_side.batches(size, size < 0, 16):
                yield made(batch, some, ends, flat, parts["time"])

    draw = ", draw long" if drawn else ""
    return whole.mapInArrow(run, f"`{series}` {kind_of(df, series)}{draw}, step int, time {kind_of(df, time)}, {names[0]} array<double>, {names[1]} array<double>")


def starting_states(models: list[StateSpace], ys: list[np.ndarray], at: list[int], output: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """``starting_state`` of many series, side by side. At its last row a series' smoothed state is the filtered one."""
    sizes = np.array([len(y) for y in ys])
    padded = np.full((len(ys), int(sizes.max()), models[0].p), np.nan)
    for i, y in enumerate(ys):
        padded[i, : len(y)] = y
    model = side_by_side.Stacked(models, MATRICES)
    f = side_by_side.filtered(model, sizes, padded)
    a, P = f["filtered" if output == "smoothed" else output], f["filtered_cov" if output == "smoothed" else f"{output}_cov"]
    if output == "smoothed" and (np.asarray(at) < sizes - 1).any():
        a, P = side_by_side.smoothed(model, sizes, f)
    return [(a[i, t], P[i if len(P) > 1 else 0, t]) for i, t in enumerate(at)]


def _times(column: pa.Array) -> list:
    """Times as the session shows them, without a zone."""
    if pa.types.is_timestamp(column.type):
        shown = column.to_pandas()
        return [*(shown.dt.tz_localize(None) if column.type.tz else shown)]
    return column.to_pylist()


def path(model: StateSpace, a: np.ndarray, P: np.ndarray, at: int, steps: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """States and observations of the ``steps`` times after a state at time ``at``, drawn once."""
    if not model.time_varying:
        return simulate(model, steps, rng, x0=a, P0=P, append_x0=False)
    x, states, seen = a + psd_root(P) @ rng.standard_normal(model.m), [], []
    for t in range(at, at + steps):
        Q = model.at("Q", t)
        x = model.at("c", t) + model.at("T", t) @ x + model.at("R", t) @ (psd_root(Q) @ rng.standard_normal(len(Q)))
        states.append(x)
        seen.append(model.at("d", t + 1) + model.at("Z", t + 1) @ x + psd_root(model.at("H", t + 1)) @ rng.standard_normal(model.p))
    return np.array(states), np.array(seen)


def _comparable(x: Any) -> Any:
    """Dates and times in one form, whatever Spark or the caller gives; numbers as they are."""
    if x is None or isinstance(x, (int, float, str, np.integer, np.floating)):
        return x
    return pd.Timestamp(x)
