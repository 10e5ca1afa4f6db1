"""All queries outside the llm package, by name, and their SQL."""

from __future__ import annotations

from .queries import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
