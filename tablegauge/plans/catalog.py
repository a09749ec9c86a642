"""All queries of the library."""

from __future__ import annotations

from . import cleaning, many, measuring, modelling, profiling, results
from .base import Query

MODULES = (cleaning, profiling, measuring, modelling, results, many)


def queries() -> dict[str, Query]:
    """Every query by name."""
    return {name: q for m in MODULES for name, q in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by name."""
    return {name: q for m in MODULES for name, q in m.R.sql.items()}
