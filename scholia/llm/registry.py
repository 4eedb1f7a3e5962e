"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from scholia.llm import queries_a, queries_b, queries_c, queries_d, queries_e, queries_f

MODULES = [queries_a, queries_b, queries_c, queries_d, queries_e, queries_f]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in m.ORACLE.items()}
