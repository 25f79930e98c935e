"""Every query of the library over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

import importlib

MODULES = ("recruitment_queries", "table_queries", "genome_queries", "workflow_queries", "evidence_queries", "link_queries", "composite_queries", "flow_queries", "marker_queries")


def _all() -> dict:
    found: dict = {}
    for m in MODULES:
        found |= importlib.import_module(f"{__package__}.{m}").QUERIES
    return found


def queries() -> dict:
    return {name: q[0] for name, q in _all().items()}


def oracle_sql() -> dict:
    return {name: q[1] for name, q in _all().items() if q[1]}
