"""The registered queries: what each computes, and the SQL that checks it.

``QUERIES`` holds the engine's side, ``CHECKS`` the same result written
independently for DuckDB over the same tables.
"""

from __future__ import annotations

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, and its check."""
    def add(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if check is not None:
            CHECKS[name] = check
        return function
    return add


def load() -> None:
    """Import every module that registers queries."""
    from postfunnel.plans.catalog import funnel, reports, scoring, selection, sources, store, streams, text  # noqa: F401
