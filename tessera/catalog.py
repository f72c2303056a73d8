"""Every registered query of the registry and retrieval operators, with its oracle statement."""

from __future__ import annotations

from tessera.plans import catalogue, checks, documents, edits, events, planning, registry, resolution, retrieval, routes, rules, strings, structure, workflow  # noqa: F401
from tessera.plans.query import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
