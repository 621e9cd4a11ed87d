"""Registry of named queries: Spark builder + DuckDB oracle SQL (or None).

Oracle SQL may be registered as a string or as a function returning one;
functions are resolved when the SQL is asked for."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
_ORACLE: dict[str, str | Callable[[], str]] = {}


def register(name: str, sql: str | Callable[[], str] | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def oracle() -> dict[str, str]:
    return {k: (v() if callable(v) else v) for k, v in _ORACLE.items()}


def load_all() -> None:
    """Import every module that registers queries."""
    from airwell.plans import queries  # noqa: F401
