"""All queries of the engine and their oracle SQL, by name."""

from __future__ import annotations

from . import chunks, grounding, increments, ranking, records, requests, review, scans, upkeep, vectors

_MODULES = (ranking, chunks, requests, grounding, records, review, upkeep, vectors, increments, scans)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
