"""All registered queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from . import queries_densities, queries_inference, queries_models, queries_statespace

FAMILIES = [queries_densities, queries_statespace, queries_inference, queries_models]
QUERIES: dict = {k: v for family in FAMILIES for k, v in family.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for family in FAMILIES for k, v in family.ORACLES.items()}
