"""Registered queries of the record and file operators, with their oracle SQL."""

from __future__ import annotations

from kinfold.plans import detection, preparation, reporting, services, survivorship

MODULES = (preparation, detection, survivorship, reporting, services)


def queries() -> dict:
    return {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
