"""All queries of the core and their DuckDB statements."""

from __future__ import annotations

from graphloom.plans import building, chunks, graphs, references, search  # noqa: F401  (they register their queries)
from graphloom.plans.base import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return {"p3_found": references.p3_found, "p3_report": references.p3_report} | QUERIES


def oracle_sql() -> dict[str, str]:
    return references.oracle_sql() | ORACLE
