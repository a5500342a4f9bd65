"""All registered queries with their SQL twins."""

from __future__ import annotations

from mnemospark.plans import base, extraction, maintenance, recall, relations, sessions, structure, texts, views, writes  # noqa: F401  (importing registers)


def queries() -> dict:
    return base.QUERIES | structure.QUERIES


def oracle_sql() -> dict[str, str]:
    return base.SQL | structure.SQL
