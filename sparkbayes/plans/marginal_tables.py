"""Latents that span rows: shared by all rows of a key, or chains over a series; alone or inside one another.

A marginal node is a tree: the latent, then what depends on it, marginals among that. It is evaluated from the rows up.
A row gives one log probability for each combination of the enclosing latents' values; a latent shared by
a key's rows sums them over the key, one aggregate for all combinations, and then sums its own values out; a
chain turns them into step tables. What reaches a level is one row a cell with a column for each combination.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import chains
from ..operators.markov import log_sum
from .model import Model, Node, column_logp, domain, find_marginal, node_logp, row_level, value, values_of

Combination = dict[str, Column]


def combinations(latents: Sequence[Node]) -> list[Combination]:
    return [{n.name: F.lit(float(v)) for n, v in zip(latents, c, strict=True)} for c in itertools.product(*[states(n) for n in latents])]


def states(n: Node) -> list[int]:
    return [*range(np.shape(n.get("p"))[-1])] if n.dist == "MarkovChain" else domain(n)


def summed(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


# --- chains ----------------------------------------------------------------------------------------------------------


def log_value(x, given: Combination) -> Column:
    if isinstance(x, (int, float)):
        return F.lit(float(np.log(x)) if x > 0 else float("-inf"))
    return chains.log_of(value(x, given))


def flat(x) -> list:
    return [y for p in x for y in flat(p)] if isinstance(x, (tuple, list)) else [x]


def depth(x) -> int:
    return 1 + depth(x[0]) if isinstance(x, (tuple, list)) else 0


def chain_shape(n: Node) -> tuple[int, int, int]:
    """(runs, states, order) of a chain's node."""
    lags, k = int(n.get("n_lags", 1)), np.shape(n.get("p"))[-1]
    return k**lags, k, lags


def step_table(n: Node, given: Combination, t: Column) -> Column:
    """A row's log weights from each run to each state: the transition's, or the initial ones in the first rows, and the emissions'.

    ``p`` nests n_lags + 1 axes of states, and one of steps before them if it varies with time; later steps use the last.
    Entries are numbers, parameters or columns. ``init`` holds a distribution, or one for each of the first states.
    """
    latent, *below = n.marginal
    runs, k, lags = chain_shape(latent)
    p, init = latent.get("p"), latent.get("init", (1.0 / k,) * k)
    said = F.array(*[summed([F.coalesce(column_logp(d, given | {latent.name: F.lit(float(j))}), F.lit(0.0)) for d in below]) for j in range(k)])
    steps = flat(p)
    if depth(p) == lags + 2:
        number = F.least(t - lags, F.lit(len(p) - 1)) * (runs * k)
        table = F.array(*[log_value(x, given) for x in steps])
        move = [F.get(table, (number + i).cast("int")) for i in range(runs * k)]
    elif depth(p) == lags + 1:
        move = [log_value(x, given) for x in steps]
    else:
        raise ValueError("p needs n_lags + 1 axes, and one more if it varies with time")
    first = F.array(*[log_value(x, given) for x in (flat(init) if depth(init) == 2 else flat(init) * lags)])
    begin = [F.get(first, (t * k + j).cast("int")) for j in range(k)]
    table = F.when(t < lags, F.array(*begin * runs)).otherwise(F.array(*move))
    return F.zip_with(table, F.flatten(F.array_repeat(said, runs)), lambda a, b: a + b)


def chain_rows(n: Node, df: DataFrame, given: Combination, above: Sequence[Node]) -> tuple[DataFrame, list[str]]:
    """A row for each row and combination of the enclosing latents' values: keys, ``_c``, ``_t`` and ``_w``."""
    latent = n.marginal[0]
    keys, order = list(latent.dims), latent.get("order")
    if not order:
        raise ValueError(f"{latent.name} needs the columns that order its rows")
    rows = chains.numbered(df, keys, list(order), "_t")
    tables = F.array(*[step_table(n, given | c, F.col("_t")) for c in combinations(above)])
    return rows.select("*", F.posexplode(tables).alias("_c", "_w")), [*keys, "_c"]


def chain_cells(n: Node, df: DataFrame, given: Combination, above: Sequence[Node]) -> DataFrame:
    rows, keys = chain_rows(n, df, given, above)
    runs, k, _ = chain_shape(n.marginal[0])
    found = chains.series_logp(rows, keys, "_t", "_w", runs, k)
    width = len(combinations(above))
    return found.groupBy(*keys[:-1]).agg(*[F.max(F.when(F.col("_c") == i, F.col("logp"))).alias(f"_l{i}") for i in range(width)])


# --- latents shared by a key's rows --------------------------------------------------------------------------------------


def shared_terms(n: Node, df: DataFrame, given: Combination, above: Sequence[Node]) -> DataFrame:
    """(keys, _j0, _j1, ...): log joint weights of the latent's values, fastest, for each combination of the enclosing ones'."""
    latent, *below = n.marginal
    keys, inner = list(latent.dims), [*above, latent]
    all_ = combinations(inner)
    wide = [d for d in below if not row_level(d)]
    narrow = [d for d in below if row_level(d)]
    sums = [F.sum(F.coalesce(summed([column_logp(d, given | c) for d in narrow]), F.lit(0.0))).alias(f"_s{i}") for i, c in enumerate(all_)]
    cells = df.groupBy(*keys).agg(*sums)
    for number, d in enumerate(wide):
        part = tree_cells(d, df, given, inner).groupBy(*keys).agg(*[F.sum(f"_l{i}").alias(f"_d{number}_{i}") for i in range(len(all_))])
        part = part.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], *[c for c in part.columns if c not in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)]
        cells = cells.join(part, reduce(lambda a, b: a & b, same, F.lit(True)))
    values = len(states(latent))
    prior = [node_logp(latent, c[latent.name], given | c) for c in all_]
    joint = [summed([prior[i], F.col(f"_s{i}"), *[F.col(f"_d{j}_{i}") for j in range(len(wide))]]) for i in range(len(all_))]
    assert len(joint) % values == 0
    return cells.select(*keys, *[x.alias(f"_j{i}") for i, x in enumerate(joint)])


def tree_cells(n: Node, df: DataFrame, given: Combination, above: Sequence[Node]) -> DataFrame:
    """(keys, _l0, _l1, ...): a marginal's log probability in each cell for each combination of the enclosing latents' values."""
    if n.rule == "chain":
        return chain_cells(n, df, given, above)
    if n.rule != "finite":
        raise NotImplementedError(f"{n.name} ({n.rule}) doesn't span rows")
    latent, values = n.marginal[0], len(states(n.marginal[0]))
    terms = shared_terms(n, df, given, above)
    return terms.select(*latent.dims, *[log_sum([F.col(f"_j{i * values + v}") for v in range(values)]).alias(f"_l{i}") for i in range(len(combinations(above)))])


def tree_logp(n: Node, df: DataFrame, given=None) -> DataFrame:
    """(keys, logp): log probability of each cell of a marginal that spans rows."""
    return tree_cells(n, df, values_of(given), []).withColumnRenamed("_l0", "logp")


def conditional_table(model: Model, df: DataFrame, name: str, given=None) -> DataFrame:
    """The distribution of a marginalized node that spans rows, given its rows.

    Of one shared by a key's rows: (keys, prob). Of a chain: all columns of ``df``, ``t`` (the place in the series) and ``prob``.
    ``prob`` is in the order of the values. Of a node inside another's marginal: given that one's value, too, a number or a column.
    """
    n = find_marginal(model.nodes, name)
    if n is None:
        raise TypeError("marginalized nodes are selected by name")
    at = values_of(given)
    if n.rule == "chain":
        rows, keys = chain_rows(n, df, at, [])
        runs, k, _ = chain_shape(n.marginal[0])
        found = chains.smoothed(rows, keys, "_t", "_w", runs, k).drop("_c")
        return chains.numbered(df, keys[:-1], list(n.marginal[0].get("order"))).join(found, [*keys[:-1], "t"])
    if n.rule != "finite" or row_level(n):
        raise NotImplementedError(f"{name} is a row's own; use model.conditional")
    width = len(states(n.marginal[0]))
    joint = [F.col(f"_j{i}") for i in range(width)]
    return shared_terms(n, df, at, []).select(*n.marginal[0].dims, F.array(*[F.exp(x - log_sum(joint)) for x in joint]).alias("prob"))


def recover_table(model: Model, df: DataFrame, name: str, n_draws: int, given=None, *, seed: int = 0) -> DataFrame:
    """Draws of a marginalized node that spans rows, given its rows. Of a chain: (keys, draw, t, state); of a shared one: (keys, draw, state)."""
    from ..functions.special import uniform

    n = find_marginal(model.nodes, name)
    if n is not None and n.rule == "chain":
        rows, keys = chain_rows(n, df, values_of(given), [])
        runs, k, _ = chain_shape(n.marginal[0])
        return chains.draws(rows, keys, "_t", "_w", runs, k, n_draws, seed=seed).drop("_c")
    found = conditional_table(model, df, name, given)
    keys, first = list(n.marginal[0].dims), states(n.marginal[0])[0]
    each = found.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    running = F.aggregate("prob", F.array().cast("array<double>"), lambda a, p: F.concat(a, F.array(p + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)))))
    at = F.least(F.size(F.filter(running, lambda c: c < uniform(F.xxhash64("draw", *keys), seed))), F.size("prob") - 1)
    return each.select(*keys, F.col("draw").cast("long").alias("draw"), (at + first).cast("long").alias("state"))
