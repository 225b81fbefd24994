"""Which named dimensions of a latent reach what depends on it, through expressions.

A dimension is a key column of a table, or a coordinate of a parameter vector. A latent may be summed out cell by cell
only where each of its dimensions passes through unchanged: elementwise expressions and choices keep the dimensions of their
parts; a reduction over one of the latent's, or an index into one, ties its cells together and is refused, and
so is a dependent that lacks one of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Total:
    """Sum of an expression over one dimension."""

    of: Any
    dim: str


@dataclass(frozen=True)
class At:
    """One place of an expression along a dimension."""

    of: Any
    dim: str
    place: int


class ConnectionError(NotImplementedError):
    """A latent's cells are tied together on the way to what depends on it."""


def parts(x: Any) -> list:
    """The expressions an expression is made of."""
    if isinstance(x, (Total, At)):
        return [x.of]
    if hasattr(x, "values") and isinstance(x.values, tuple):
        return [*x.values]
    if hasattr(x, "slope"):
        return [x.slope, x.offset]
    return [*x] if isinstance(x, (tuple, list)) else []


def names(x: Any) -> set[str]:
    """Nodes that an expression refers to."""
    own = {x.name} if hasattr(x, "name") and not isinstance(x, str) else set()
    return own.union(*[names(p) for p in parts(x)])


def carried(x: Any, latent: str, dims: frozenset[str], model) -> frozenset[str]:
    """Dimensions of an expression; raises where one of the latent's doesn't pass through."""
    if isinstance(x, (Total, At)):
        inner = carried(x.of, latent, dims, model)
        if latent in names(x.of) and x.dim in dims:
            raise ConnectionError(f"{'a sum over' if isinstance(x, Total) else 'an index into'} {x.dim} ties cells of {latent} together")
        if x.dim not in inner:
            raise ValueError(f"there is no dimension {x.dim} here")
        return inner - {x.dim}
    own = frozenset()
    if hasattr(x, "name") and not isinstance(x, str):
        own = dims if x.name == latent else frozenset(d for n in model.nodes if n.name == x.name for d in n.dims)
    return own.union(*[carried(p, latent, dims, model) for p in parts(x)])


def connection(model, latent, below) -> dict[str, frozenset[str]]:
    """Dimensions that each dependent has beyond the latent's: what is summed within a cell. Raises where the latent can't be summed out."""
    dims, out = frozenset(latent.dims), {}
    for d in below:
        for n in leaves(d):
            for _, x in n.params:
                if latent.name in names(x):
                    carried(x, latent.name, dims, model)
            if not dims <= frozenset(n.dims):
                raise ConnectionError(f"{n.name} has no dimension {', '.join(sorted(dims - frozenset(n.dims)))} of {latent.name}")
        out[d.name] = frozenset(x for n in leaves(d) for x in n.dims) - dims
    return out


def leaves(node) -> list:
    """A node, or all nodes inside a marginal one."""
    return [x for p in node.marginal for x in leaves(p)] if node.dist == "Marginal" else [node]
