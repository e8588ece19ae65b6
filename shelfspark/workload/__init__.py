"""Registered queries with their comparison SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("analysis", "pages", "scalars", "store")


def load() -> tuple[dict, dict]:
    """All queries and all comparison SQL, keyed by query name."""
    for name in MODULES:
        import_module(f"shelfspark.workload.{name}")
    from shelfspark.workload.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
