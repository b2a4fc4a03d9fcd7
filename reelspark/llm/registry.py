"""Queries and SQL of the subpackage."""

from __future__ import annotations

from reelspark.llm import queries as _queries


def queries() -> dict:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_queries.ORACLE)
