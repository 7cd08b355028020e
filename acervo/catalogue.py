"""Registered queries of the core, and the DuckDB statements they are checked against."""

from __future__ import annotations

from acervo.plans import analysis, attributes, extraction, files, maintenance, modelling, projects, relational, topics, votes  # noqa: F401
from acervo.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
