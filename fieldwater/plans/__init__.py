"""End-to-end plans and the registered driver-table queries."""

from __future__ import annotations

import importlib

MODULES = ("meter_queries", "grid_queries", "model_queries", "stream_queries")


def all_queries():
    """The registered queries and their check SQL, in registration order."""
    for name in MODULES:
        importlib.import_module(f"fieldwater.plans.{name}")
    from fieldwater.plans.registry import CHECKS, QUERIES

    return QUERIES, CHECKS
