"""Models as immutable trees, and rewrites of them.

A model is named nodes: random variables whose parameters are numbers, other nodes' names or small expressions, data
that are a table's columns, and functions of them. Rewrites give new models: latents summed or integrated out,
conditionals put back, location-scale variables re-expressed. ``row_logp`` compiles a model to one Column over a table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import NEG_INF, lgamma, normal_logp
from ..operators.marginal import normal_normal_conditional, normal_normal_logp
from ..operators.markov import log_sum
from .dims import At, Total, connection, leaves, names

FINITE = {"Bernoulli", "Categorical", "DiscreteUniform"}


@dataclass(frozen=True)
class Ref:
    """Another node, scaled and shifted: offset + slope * node."""

    name: str
    slope: Any = 1.0
    offset: Any = 0.0


@dataclass(frozen=True)
class Pick:
    """One of several values, chosen by a finite node."""

    name: str
    values: tuple[Any, ...]


@dataclass(frozen=True)
class Node:
    name: str
    dist: str  # Normal, Poisson, Bernoulli, Categorical, DiscreteUniform, Exponential, MarkovChain; Deterministic, Data, Marginal
    params: tuple[tuple[str, Any], ...] = ()
    observed: str | None = None  # the column of a table
    dims: tuple[str, ...] = ()
    marginal: tuple[Node, ...] = ()  # of a Marginal: the latent, then what depends on it
    rule: str = ""

    def get(self, key: str, default: Any = None) -> Any:
        return dict(self.params).get(key, default)

    def parents(self) -> set[str]:
        inner = {p.name for p in self.marginal}
        return set().union(*[names(v) for _, v in self.params], *[p.parents() for p in self.marginal]) - inner

    def absorbed(self) -> list[str]:
        """Names of the latents summed out in here, from the outermost in."""
        return [self.name, *(x for p in self.marginal[1:] if p.dist == "Marginal" for x in p.absorbed())] if self.marginal else []


def rv(name: str, dist: str, *, observed: str | None = None, dims: Sequence[str] = (), **params) -> Node:
    return Node(name, dist, tuple(sorted(params.items())), observed, tuple(dims))


@dataclass(frozen=True)
class Model:
    nodes: tuple[Node, ...] = ()
    coords: tuple[tuple[str, tuple], ...] = ()

    def __post_init__(self):
        names = [n.name for n in self.nodes]
        if len({*names}) < len(names):
            raise ValueError("names must differ")

    def add(self, *nodes: Node) -> Model:
        return replace(self, nodes=self.nodes + nodes)

    def __getitem__(self, name: str) -> Node:
        for n in self.nodes:
            if n.name == name:
                return n
        raise KeyError(name)

    def dependents(self, name: str) -> list[Node]:
        return [n for n in self.nodes if name in n.parents()]

    def free(self) -> list[Node]:
        gone = {x for n in self.nodes for x in n.absorbed()}
        return [x for n in self.nodes for x in leaves(n) if x.observed is None and x.dist not in ("Deterministic", "Data") and x.name not in gone]

    def size(self, node: Node) -> int:
        return math.prod(len(dict(self.coords)[d]) for d in node.dims)

    def n_parameters(self) -> int:
        return sum(self.size(n) for n in self.free())


# --- rewrites ----------------------------------------------------------------------------------------------------


def finite_rule(model: Model, latent: Node, below: list[Node]) -> Node | None:
    return Node(latent.name, "Marginal", marginal=(latent, *below), rule="finite") if latent.dist in FINITE else None


def chain_rule(model: Model, latent: Node, below: list[Node]) -> Node | None:
    """A Markov chain over a series' rows: ``dims`` are the series' keys, the parameter ``order`` the columns that order its rows."""
    if latent.dist != "MarkovChain":
        return None
    if inside := [x for d in below for x in d.absorbed() if not row_level(d)]:
        raise NotImplementedError(f"{inside[0]} spans several rows of the chain {latent.name}")
    return Node(latent.name, "Marginal", marginal=(latent, *below), rule="chain")


def normal_rule(model: Model, latent: Node, below: list[Node]) -> Node | None:
    """One normal dependent whose mean is affine in the latent and whose spread is free of it."""
    if latent.dist != "Normal" or len(below) != 1 or below[0].dist != "Normal":
        return None
    d = below[0]
    mu = d.get("mu")
    if not isinstance(mu, Ref) or mu.name != latent.name or latent.name in names(d.get("sigma")) | names(mu.slope) | names(mu.offset) or latent.dims != d.dims or d.observed is None:
        return None
    return Node(latent.name, "Marginal", marginal=(latent, d), rule="normal")


def laplace_rule(model: Model, latent: Node, below: list[Node]) -> Node | None:
    return Node(latent.name, "Marginal", marginal=(latent, *below), rule="laplace") if latent.get("laplace") else None


#: Tried in order for each latent; more can be put in.
RULES: list[Callable[[Model, Node, list[Node]], Node | None]] = [finite_rule, chain_rule, normal_rule, laplace_rule]


def marginalize(model: Model, names: Sequence[str], *, laplace: dict[str, np.ndarray] | None = None) -> Model:
    """The model without the named latents; each is absorbed with what depends on it. laplace: precisions of latents to approximate.

    Rewriting goes on until nothing is left to do: a latent waits while another named one depends on it, and is then
    absorbed with that one's marginal, so the order of the names doesn't matter.
    """
    waiting = [*dict.fromkeys(names)]
    for name in waiting:
        latent = model[name]
        if latent.observed is not None or latent.dist in ("Deterministic", "Data", "Marginal"):
            raise ValueError(f"{name} is not a free random variable")
    while waiting:
        ready = [x for x in waiting if not any(d.name in waiting for d in model.dependents(x))]
        if not ready:
            raise NotImplementedError(f"{waiting} depend on one another in a circle")
        model = absorb(model, ready[0], laplace or {})
        waiting.remove(ready[0])
    return model


def absorb(model: Model, name: str, laplace: dict[str, np.ndarray]) -> Model:
    latent = model[name]
    if name in laplace:
        latent = replace(latent, params=(*latent.params, ("laplace", tuple(map(tuple, np.atleast_2d(laplace[name]))))))
    below = sorted(model.dependents(name), key=lambda n: n.name)
    if any(d.dist == "Deterministic" for d in below):
        raise NotImplementedError(f"a deterministic node depends on {name}")
    if not below:
        raise ValueError(f"nothing depends on {name}")
    if any(d.dist == "StateSpace" for d in below):
        raise NotImplementedError(f"a state-space likelihood depends on {name}")
    connection(model, latent, below)
    made = next((m for rule in RULES if (m := rule(model, latent, below))), None)
    if made is None:
        raise NotImplementedError(f"no rule marginalizes {name} ({latent.dist})")
    gone = {name, *(d.name for d in below)}
    return replace(model, nodes=tuple(n for n in model.nodes if n.name not in gone) + (made,))


def row_level(n: Node) -> bool:
    """Whether a marginal's latents, all of them, are a row's own."""
    if n.dist != "Marginal":
        return True
    return n.rule in ("finite", "normal") and all(row_level(d) for d in n.marginal[1:]) and all(frozenset(x.dims) == frozenset(n.marginal[0].dims) for d in n.marginal[1:] for x in leaves(d))


def unmarginalize(model: Model, names: Sequence[str] | None = None) -> Model:
    """Marginalized nodes put back as they were, all or those named; what was absorbed with a named one and isn't named is marginalized again."""
    known = [x for n in model.nodes for x in n.absorbed()]
    wrong = [x for x in names or () if x not in known]
    if wrong:
        raise ValueError(f"{wrong} are not marginalized; there are {known}")
    out: list[Node] = []
    again: list[str] = []
    precisions: dict[str, np.ndarray] = {}
    for n in model.nodes:
        inside = n.absorbed()
        if not inside or names is not None and not {*inside} & {*names}:
            out.append(n)
            continue
        for p in leaves(n):
            if p.get("laplace") and names is not None and p.name not in names:
                precisions[p.name] = np.array(p.get("laplace"))
            out.append(replace(p, params=tuple((k, v) for k, v in p.params if k != "laplace")))
        again += [x for x in inside if names is not None and x not in names]
    return marginalize(replace(model, nodes=tuple(out)), again, laplace=precisions)


def value(x: Any, given: dict[str, Column]) -> Column:
    if isinstance(x, Total):
        return sum((value(p, given) for p in places(x.of, given)), F.lit(0.0))
    if isinstance(x, At):
        return value(places(x.of, given)[x.place], given)
    if isinstance(x, Ref):
        return value(x.offset, given) + value(x.slope, given) * given[x.name]
    if isinstance(x, Pick):
        return F.get(F.array(*[value(v, given) for v in x.values]), given[x.name].cast("int"))
    if isinstance(x, str):
        return F.col(x).cast("double")
    return x if isinstance(x, Column) else F.lit(float(x))


def places(x: Any, given: dict[str, Column]) -> list:
    """An expression of one parameter vector, once for each of its places; a vector is given by name and place, as in ``mu[2]``."""
    if not isinstance(x, Ref):
        raise NotImplementedError("sums and places are those of a scaled and shifted vector")
    count = sum(1 for k in given if k.startswith(f"{x.name}["))
    return [Ref(f"{x.name}[{i}]", x.slope, x.offset) for i in range(count)]


def values_of(given: dict[str, Column | float | Sequence[float]] | None) -> dict[str, Column]:
    """Values by name as Columns; a vector's by name and place."""
    out: dict[str, Column] = {}
    for k, v in (given or {}).items():
        if isinstance(v, (list, tuple, np.ndarray)):
            out |= {f"{k}[{i}]": F.lit(float(x)) for i, x in enumerate(v)}
        else:
            out[k] = v if isinstance(v, Column) else F.lit(float(v))
    return out


def node_logp(n: Node, x: Column, given: dict[str, Column]) -> Column:
    get = lambda k, d=None: value(n.get(k, d), given)
    if n.dist == "Normal":
        return normal_logp(x, get("mu", 0.0), get("sigma", 1.0))
    if n.dist == "Poisson":
        return x * F.log(get("mu")) - get("mu") - lgamma(x + 1.0)
    if n.dist == "Exponential":
        return F.when(x >= 0, F.log(get("lam")) - get("lam") * x).otherwise(F.lit(NEG_INF))
    if n.dist == "Bernoulli":
        return F.when(x == 1, F.log(get("p"))).when(x == 0, F.log(1 - get("p"))).otherwise(F.lit(NEG_INF))
    if n.dist == "Categorical":
        return F.log(F.get(F.array(*[value(p, given) for p in n.get("p")]), x.cast("int")))
    if n.dist == "DiscreteUniform":
        lo, hi = n.get("lower"), n.get("upper")
        return F.when((x >= lo) & (x <= hi), F.lit(-math.log(hi - lo + 1))).otherwise(F.lit(NEG_INF))
    raise ValueError(f"no density of {n.dist}")


def domain(n: Node) -> list[int]:
    if n.dist == "Bernoulli":
        return [0, 1]
    if n.dist == "Categorical":
        return [*range(len(n.get("p")))]
    return [*range(n.get("lower"), n.get("upper") + 1)]


def column_logp(n: Node, given: dict[str, Column]) -> Column:
    """Log probability of a row: of an observed or given node, or of a marginal whose latents are the row's own."""
    if n.dist == "Marginal" and n.rule == "finite":
        return log_sum(joint(n, given))
    if n.dist == "Marginal" and n.rule == "normal":
        latent, d = n.marginal
        mu = d.get("mu")
        return normal_normal_logp(F.col(d.observed).cast("double"), value(latent.get("mu", 0.0), given), value(latent.get("sigma", 1.0), given), value(d.get("sigma", 1.0), given), value(mu.slope, given), value(mu.offset, given))
    if n.dist == "Marginal":
        raise NotImplementedError("a Laplace marginal is not a sum over rows; use operators.marginal.laplace_marginal")
    return node_logp(n, F.col(n.observed).cast("double") if n.observed is not None else given[n.name], given)


def joint(n: Node, given: dict[str, Column]) -> list[Column]:
    """Log joint weights of a finite marginal's values."""
    latent, *below = n.marginal
    terms = []
    for v in domain(latent):
        here = given | {latent.name: F.lit(float(v))}
        terms.append(sum((column_logp(d, here) for d in below), node_logp(latent, F.lit(float(v)), given)))
    return terms


def row_logp(model: Model, given: dict[str, Column | float] | None = None) -> Column:
    """Log probability of a row: its observed nodes and marginals, with values for what is free."""
    at, total = values_of(given), F.lit(0.0)
    for n in model.nodes:
        if n.rule == "laplace":
            raise NotImplementedError("a Laplace marginal is not a sum over rows; use operators.marginal.laplace_marginal")
        if n.dist == "Marginal" and not row_level(n):
            raise NotImplementedError(f"{n.name} spans several rows; use marginal_tables.tree_logp or model_logp")
        if n.dist == "StateSpace":
            raise NotImplementedError(f"{n.name} is the likelihood of whole series; use model_logp or statespace_target")
        if n.dist == "Marginal" or n.observed is not None:
            total = total + column_logp(n, at)
    return total


def model_logp(model: Model, df: DataFrame, given: dict[str, float] | None = None) -> float:
    """Rows' log probability summed in one aggregate, that of latents that span rows by their cells, and that of the free nodes' values."""
    from .marginal_tables import tree_logp

    wide = [n for n in model.nodes if n.dist == "Marginal" and n.rule != "laplace" and not row_level(n)]
    spaces = [n for n in model.nodes if n.dist == "StateSpace"]
    narrow = replace(model, nodes=tuple(n for n in model.nodes if n not in wide and n not in spaces))
    total = df.agg(F.sum(row_logp(narrow, dict(given or {})))).head()[0] or 0.0
    for n in wide:
        total += tree_logp(n, df, given).agg(F.sum("logp")).head()[0] or 0.0
    for n in spaces:
        total += series_target(n, df).sums([np.array([float((given or {})[k]) for k in n.get("names")])], gradients=False)[0][0]
    at = values_of(given)
    free = [node_logp(n, at[n.name], at) for n in narrow.free() if n.name in at]
    if not free:
        return float(total)
    return float(total) + float(df.sparkSession.range(1).select(sum(free[1:], free[0])).head()[0])


# --- state-space likelihoods ---------------------------------------------------------------------------------------------


def with_statespace(model: Model, name: str, build: Callable[[dict[str, float]], Any], parameters: Sequence[str], *, series: str, time: Sequence[str], observed: Sequence[str]) -> Model:
    """The model with the likelihood of a table's series under the state-space model that ``build`` makes of the named parameters."""
    known = {n.name for n in model.free()}
    if missing := [p for p in parameters if p not in known]:
        raise ValueError(f"{missing} are not free nodes of the model")
    params = (("build", build), ("names", tuple(parameters)), ("of", tuple(Ref(p) for p in parameters)), ("series", series), ("time", tuple(time)), ("columns", tuple(observed)))
    return model.add(Node(name, "StateSpace", params, observed=observed[0]))


def series_target(n: Node, df: DataFrame):
    from ..operators.statespace_gradient import SeriesTarget, gathered

    return SeriesTarget(gathered(df, n.get("series"), n.get("time"), n.get("columns")), n.get("build"), list(n.get("names")))


def number(x: Any, given: dict[str, float]) -> float:
    if isinstance(x, Ref):
        return number(x.offset, given) + number(x.slope, given) * given[x.name]
    return float(x)


def log_density(n: Node, x: float, given: dict[str, float]) -> float:
    """Log density of one free number."""
    if n.dist == "Normal":
        mu, sigma = number(n.get("mu", 0.0), given), number(n.get("sigma", 1.0), given)
        return -0.5 * ((x - mu) / sigma) ** 2 - math.log(sigma) - 0.5 * math.log(2 * math.pi)
    if n.dist == "Exponential":
        lam = number(n.get("lam", 1.0), given)
        return math.log(lam) - lam * x if x >= 0 else NEG_INF
    raise NotImplementedError(f"{n.dist} isn't a prior of a state-space parameter")


def statespace_target(model: Model, df: DataFrame):
    """A target for ``inference.find_map`` and the fits built on it: the series' likelihood and the priors of the free nodes, in their order."""
    from ..operators.statespace_gradient import likelihood_target

    spaces, free = [n for n in model.nodes if n.dist == "StateSpace"], model.free()
    if len(spaces) != 1 or any(n.dims for n in free):
        raise NotImplementedError("one state-space likelihood and free numbers without dimensions")
    names = [n.name for n in free]
    own = series_target(spaces[0], df)

    def log_prior(x: np.ndarray) -> float:
        given = dict(zip(names, x.tolist(), strict=True))
        return sum(log_density(n, given[n.name], given) for n in free)

    return likelihood_target(own.rows.persist(), own.build, names, log_prior)


def find_marginal(nodes: Sequence[Node], name: str) -> Node | None:
    for n in nodes:
        if n.dist == "Marginal":
            if n.name == name:
                return n
            if found := find_marginal(n.marginal, name):
                return found
    return None


def conditional(model: Model, name: str, given: dict[str, Column | float] | None = None) -> dict[str, Column]:
    """The distribution of a marginalized node given the row: probabilities of its values, or mean and sd.

    Of a node inside another's marginal: given that one's value, too.
    """
    n = find_marginal(model.nodes, name) if isinstance(name, str) else None
    if n is None:
        raise TypeError("marginalized nodes are selected by name")
    at = values_of(given)
    if n.rule in ("finite", "chain") and not row_level(n):
        raise NotImplementedError(f"{name} spans several rows; use marginal_tables.conditional_table")
    if n.rule == "finite":
        terms = joint(n, at)
        total = log_sum(terms)
        return {"values": F.array(*[F.lit(v) for v in domain(n.marginal[0])]), "prob": F.array(*[F.exp(t - total) for t in terms])}
    if n.rule == "normal":
        latent, d = n.marginal
        mu = d.get("mu")
        mean, sd = normal_normal_conditional(F.col(d.observed).cast("double"), value(latent.get("mu", 0.0), at), value(latent.get("sigma", 1.0), at), value(d.get("sigma", 1.0), at), value(mu.slope, at), value(mu.offset, at))
        return {"mean": mean, "sd": sd}
    raise NotImplementedError("a Laplace marginal has no conditional")


def recover(model: Model, df: DataFrame, draws: DataFrame, name: str, key: str, *, seed: int = 0) -> DataFrame:
    """(draw, key, name): draws of a marginalized node for each row of a keyed table under each posterior draw.

    draws: a column per free node and ``draw``. Rows times draws is what is asked for; each pair is drawn by its own key.
    """
    from ..functions.special import normal, uniform

    free = [c for c in draws.columns if c != "draw"]
    pairs = df.crossJoin(draws)
    got = conditional(model, name, {c: F.col(c) for c in free})
    who = F.xxhash64("draw", key)
    if "prob" in got:
        u = uniform(who, seed)
        running = F.aggregate(got["prob"], F.array().cast("array<double>"), lambda a, p: F.concat(a, F.array(p + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)))))
        at = F.least(F.size(F.filter(running, lambda c: c < u)), F.size(got["prob"]) - 1)
        return pairs.select("draw", key, F.get(got["values"], at).alias(name))
    return pairs.select("draw", key, (got["mean"] + got["sd"] * normal(who, seed)).alias(name))


def reparametrize(model: Model, name: str, weight: float) -> Model:
    """A normal variable re-expressed between centred (1) and non-centred (0): tau ~ N(w mu, sigma^w), x = mu + sigma^(1-w) (tau - w mu)."""
    n = model[name]
    if n.dist not in ("Normal", "Exponential"):
        raise NotImplementedError(f"{n.dist} is not re-expressed")
    if not 0 <= weight <= 1:
        raise ValueError("the weight lies between 0 and 1")
    if n.dist == "Normal":
        mu, sigma = float(n.get("mu", 0.0)), float(n.get("sigma", 1.0))
        tau = rv(f"{name}_tau", "Normal", mu=weight * mu, sigma=sigma**weight, dims=n.dims)
        back = Node(name, "Deterministic", (("of", Ref(tau.name, sigma ** (1 - weight), mu - sigma ** (1 - weight) * weight * mu)),), dims=n.dims)
    else:
        scale = 1 / float(n.get("lam", 1.0))
        tau = rv(f"{name}_tau", "Exponential", lam=1 / scale**weight, dims=n.dims)
        back = Node(name, "Deterministic", (("of", Ref(tau.name, scale ** (1 - weight))),), dims=n.dims)
    return replace(model, nodes=tuple(x for m in model.nodes for x in ((tau, back) if m.name == name else (m,))))


def equivalent(a: Model, b: Model) -> bool:
    """The same nodes, whatever their order."""
    return sorted(a.nodes, key=lambda n: n.name) == sorted(b.nodes, key=lambda n: n.name) and sorted(a.coords) == sorted(b.coords)


def model_table(model: Model) -> str:
    """Name, expression, dimensions and number of parameters of each node, as text."""

    def shown(x: Any) -> str:
        if isinstance(x, Ref):
            return x.name if (x.slope, x.offset) == (1.0, 0.0) else f"{x.offset} + {x.slope} * {x.name}"
        return f"{list(x.values)}[{x.name}]" if isinstance(x, Pick) else str(x)

    rows = [("name", "expression", "dims", "parameters")]
    for n in model.nodes:
        inside = ", ".join(f"{k}={shown(v)}" for k, v in n.params)
        rows.append((n.name, f"{n.dist}({inside})" if n.dist != "Marginal" else f"Marginal[{n.rule}]({', '.join(p.name for p in n.marginal)})", ", ".join(n.dims), str(model.size(n)) if n in model.free() else ""))
    wide = [max(len(r[i]) for r in rows) for i in range(4)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)).rstrip() for r in rows) + f"\ntotal parameters: {model.n_parameters()}"


def as_model(coords: dict[str, Sequence] | None = None):
    """A function that returns nodes as a factory of models; its arguments are kept as data nodes."""

    def wrap(f: Callable[..., Sequence[Node]]) -> Callable[..., Model]:
        def make(*args, **kw) -> Model:
            inputs = tuple(Node(k, "Data", (("value", v),)) for k, v in kw.items() if isinstance(v, (int, float)))
            return Model(inputs + tuple(f(*args, **kw)), tuple((k, tuple(v)) for k, v in (coords or {}).items()))

        return make

    return wrap
