"""All queries of the engine's own operators, and the SQL they are checked against."""

from __future__ import annotations

from scholia.plans import analytics, library, relational, texts

MODULES = [relational, analytics, texts, library]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in m.ORACLE.items()}
