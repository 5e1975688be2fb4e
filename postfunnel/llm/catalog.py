"""The registered queries of this folder and the SQL that checks them."""

from __future__ import annotations

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, and its check where SQL can say it."""
    def add(function):
        QUERIES[name] = function
        if check is not None:
            CHECKS[name] = check
        return function
    return add


def load() -> None:
    """Import every module that registers a query."""
    from postfunnel.llm import queries  # noqa: F401
