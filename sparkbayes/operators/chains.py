"""Hidden chains of any order as products of step tables, over series of any length.

A row of a series becomes a step table: log weights of going from each run of the last n states to each next state, with
the row's emission in it; orders, transitions that vary with time or with columns, and missing emissions all
come down to that. A series is cut into segments of rows. Segments are multiplied out side by side, the short list of their
products is folded for each series, and what enters a segment from either side goes back to it; so no task holds a
series' rows, only one number matrix for each of its segments.

Runs are numbered with the earliest state most significant. Before the first row the run is 0; the first n rows' tables
hold the initial probabilities whatever the run.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 512  # rows


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


def forward(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log weights (..., K) of runs before a step to those after it; w: (..., K, k)."""
    runs, k = w.shape[-2:]
    joint = a[..., None] + w
    return log_sum(joint.reshape(*joint.shape[:-2], k, runs // k, k), -3).reshape(*joint.shape[:-2], runs)


def backward(b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log weights of what follows a step, by the run after it, to that by the run before it."""
    runs, k = w.shape[-2:]
    joint = w.reshape(*w.shape[:-2], k, runs // k, k) + b.reshape(*b.shape[:-1], 1, runs // k, k)
    return log_sum(joint, -1).reshape(*b.shape)


def product(a: np.ndarray, m: np.ndarray) -> np.ndarray:
    return log_sum(a[..., :, None] + m, -2)


def log_of(p: Column) -> Column:
    return F.when(p > 0, F.log(p)).otherwise(F.lit(float("-inf")))


def numbered(df: DataFrame, series: Sequence[str], order: Sequence[str], name: str = "t") -> DataFrame:
    """``df`` with each row's place in its series, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*series).orderBy(*order)) - 1)


def segments(rows: DataFrame, series: Sequence[str], t: str, table: str, length: int = SEGMENT) -> DataFrame:
    """(series, segment, w): the step tables of every ``length`` rows in order, one after another."""
    steps = F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(table).alias("w"))))
    cut = rows.groupBy(*series, F.floor(F.col(t) / length).cast("int").alias("segment")).agg(steps.alias("steps"))
    return cut.select(*series, "segment", F.flatten(F.transform("steps", lambda s: s["w"])).alias("w"))


def padded(column: pa.Array, runs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of step tables as (segments, steps, runs, k), and which steps there are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends, flat = column.offsets.to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(ends) // (runs * k)
    out, there = np.zeros((len(sizes), int(sizes.max(initial=0)), runs, k)), np.arange(int(sizes.max(initial=0)))[None] < sizes[:, None]
    out[there] = flat.reshape(-1, runs, k)
    return out, there


def fixed(column: pa.Array, *shape: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, *shape)


def lists(x: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(x.reshape(len(x), -1))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


def mapped(df: DataFrame, keep: Sequence[str], more: str, run) -> DataFrame:
    """``run(batch)`` gives the columns of ``more`` for each batch; those of ``keep`` go along, taken by the rows it names if it does."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), more])
    names = [*keep, *(x.split()[0] for x in more.split(", "))]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, columns = run(part)
                own = [part.column(c) for c in keep]
                if rows is not None:
                    own = [c.take(pa.array(rows)) for c in own]
                yield pa.RecordBatch.from_arrays([*own, *columns], names=names)

    return df.mapInArrow(go, schema)


def transfers(cut: DataFrame, series: Sequence[str], runs: int, k: int) -> DataFrame:
    """(series, segment, m): each segment's log weights from the run before it to the run at its end."""

    def run(batch: pa.RecordBatch):
        w, there = padded(batch.column("w"), runs, k)
        with np.errstate(divide="ignore"):
            a = np.broadcast_to(np.log(np.eye(runs)), (len(w), runs, runs))
        for t in range(w.shape[1]):
            a = np.where(there[:, t, None, None], forward(a, w[:, t, None]), a)
        return None, [lists(a)]

    return mapped(cut, [*series, "segment"], "m array<double>", run)


def gathered(found: DataFrame, series: Sequence[str]) -> DataFrame:
    """(series, segments, m): a series' segments in order with their products, one after another."""
    one = found.groupBy(*series).agg(F.array_sort(F.collect_list(F.struct("segment", "m"))).alias("all"))
    return one.select(*series, F.transform("all", lambda s: s["segment"]).alias("segments"), F.flatten(F.transform("all", lambda s: s["m"])).alias("m"))


def entered(m: np.ndarray) -> np.ndarray:
    """Log weights of runs before each segment of a series, and at its end."""
    out = np.full((len(m) + 1, m.shape[1]), -np.inf)
    out[0, 0] = 0.0
    for j in range(len(m)):
        out[j + 1] = product(out[j], m[j])
    return out


def followed(m: np.ndarray) -> np.ndarray:
    out = np.zeros((len(m), m.shape[1]))
    for j in range(len(m) - 2, -1, -1):
        out[j] = log_sum(m[j + 1] + out[j + 1][None, :], 1)
    return out


def series_logp(rows: DataFrame, series: Sequence[str], t: str, table: str, runs: int, k: int, *, length: int = SEGMENT) -> DataFrame:
    """(series, logp): log probability of each series, its hidden states summed out."""

    def run(batch: pa.RecordBatch):
        sizes = np.diff(batch.column("m").offsets.to_numpy()) // runs**2
        parts = np.split(fixed(batch.column("m"), runs, runs), np.cumsum(sizes)[:-1])
        return None, [pa.array([float(log_sum(entered(m)[-1], 0)) for m in parts])]

    found = gathered(transfers(segments(rows, series, t, table, length), series, runs, k), series)
    return mapped(found, [*series], "logp double", run)


def with_ends(cut: DataFrame, series: Sequence[str], runs: int, k: int) -> DataFrame:
    """Segments with ``before`` and ``after``: log weights of what precedes, by the run before, and follows, by the run at the end."""

    def run(batch: pa.RecordBatch):
        sizes = np.diff(batch.column("m").offsets.to_numpy()) // runs**2
        parts = np.split(fixed(batch.column("m"), runs, runs), np.cumsum(sizes)[:-1])
        number = batch.column("segments").flatten()
        return np.repeat(np.arange(batch.num_rows), sizes), [number, lists(np.concatenate([entered(m)[:-1] for m in parts])), lists(np.concatenate([followed(m) for m in parts]))]

    ends = mapped(gathered(transfers(cut, series, runs, k), series), [*series], "segment int, before array<double>, after array<double>", run)
    return cut.join(ends, [*series, "segment"])


def smoothed(rows: DataFrame, series: Sequence[str], t: str, table: str, runs: int, k: int, *, length: int = SEGMENT) -> DataFrame:
    """(series, t, prob): probabilities of each row's state given its whole series."""

    def run(batch: pa.RecordBatch):
        w, there = padded(batch.column("w"), runs, k)
        a, b = fixed(batch.column("before"), runs), fixed(batch.column("after"), runs)
        ahead = []
        for i in range(w.shape[1]):
            a = np.where(there[:, i, None], forward(a, w[:, i]), a)
            ahead.append(a)
        prob = np.zeros((*there.shape, k))
        for i in range(w.shape[1] - 1, -1, -1):
            both = ahead[i] + b
            both = np.exp(both - log_sum(both, -1)[:, None])
            prob[:, i] = both.reshape(len(w), runs // k, k).sum(axis=1)
            b = np.where(there[:, i, None], backward(b, w[:, i]), b)
        where, step = np.nonzero(there)
        at = batch.column("segment").to_numpy()[where].astype(np.int64) * length + step
        return where, [pa.array(at, pa.int64()), lists(prob[there])]

    return mapped(with_ends(segments(rows, series, t, table, length), series, runs, k), [*series], "t long, prob array<double>", run)


def chosen(rng: np.random.Generator, log_weights: np.ndarray) -> np.ndarray:
    """One choice for each row of log weights."""
    p = np.exp(log_weights - np.max(log_weights, axis=-1, keepdims=True)).cumsum(axis=-1)
    return (rng.uniform(size=(len(p), 1)) * p[:, -1:] >= p[:, :-1]).sum(axis=1)


def draws(rows: DataFrame, series: Sequence[str], t: str, table: str, runs: int, k: int, n: int, *, seed: int = 0, length: int = SEGMENT) -> DataFrame:
    """(series, draw, t, state): paths drawn given each series. Runs at segments' ends are drawn first, then what lies between."""

    def keyed(batch: pa.RecordBatch, i: int) -> np.random.Generator:
        said = repr([batch.column(c)[i].as_py() for c in [*series, *(["segment"] if "segment" in batch.schema.names else [])]])
        return np.random.default_rng([seed, zlib.crc32(said.encode())])

    def ends(batch: pa.RecordBatch):
        sizes = np.diff(batch.column("m").offsets.to_numpy()) // runs**2
        first, last = [], []
        for i, m in enumerate(np.split(fixed(batch.column("m"), runs, runs), np.cumsum(sizes)[:-1])):
            rng, a = keyed(batch, i), entered(m)
            state = chosen(rng, np.broadcast_to(a[-1], (n, runs)))
            own = [state]
            for j in range(len(m) - 1, 0, -1):
                own.append(chosen(rng, a[j] + m[j][:, own[-1]].T))
            own.append(np.zeros(n, np.int64))
            last += own[-2::-1]
            first += own[:0:-1]
        return np.repeat(np.arange(batch.num_rows), sizes), [batch.column("segments").flatten(), *(pa.array([x.tolist() for x in e], pa.list_(pa.int64())) for e in (first, last))]

    def inside(batch: pa.RecordBatch):
        w, there = padded(batch.column("w"), runs, k)
        where, out, place = [], [], []
        for i in range(batch.num_rows):
            rng, own = keyed(batch, i), w[i, there[i]]
            a = np.full((n, runs), -np.inf)
            a[np.arange(n), batch.column("first")[i].as_py()] = 0.0
            ahead = [a]
            for step in own:
                ahead.append(forward(ahead[-1], step[None]))
            run_at, states = np.array(batch.column("last")[i].as_py()), []
            for j in range(len(own) - 1, -1, -1):
                state = run_at % k
                states.append(state)
                before = np.arange(k)[None] * (runs // k) + (run_at // k)[:, None]  # runs that this one may follow
                pick = chosen(rng, np.take_along_axis(ahead[j], before, 1) + own[j][before, state[:, None]])
                run_at = before[np.arange(n), pick]
            out.append(np.array(states[::-1]).ravel())
            place.append(np.repeat(np.arange(len(own)) + int(batch.column("segment")[i].as_py()) * length, n))
            where.append(np.full(len(own) * n, i))
        flat = np.concatenate(place)
        return np.concatenate(where), [pa.array(np.concatenate([np.tile(np.arange(n), len(x) // n) for x in out]), pa.int64()), pa.array(flat, pa.int64()), pa.array(np.concatenate(out), pa.int64())]

    cut = segments(rows, series, t, table, length)
    at_ends = mapped(gathered(transfers(cut, series, runs, k), series), [*series], "segment int, first array<long>, last array<long>", ends)
    return mapped(cut.join(at_ends, [*series, "segment"]), [*series], "draw long, t long, state long", inside)
