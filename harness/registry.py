"""All queries and their SQL, gathered from the topic modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from flowtide.session import configure

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; it runs with the recommended settings, times in UTC."""

    def add(fn: Callable) -> Callable:
        @wraps(fn)
        def run(spark, sf):
            return fn(configure(spark), sf)

        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return run

    return add


def _load() -> None:
    from harness import q_alerts, q_counters, q_flows, q_labelled, q_models, q_sketches, q_streams, q_telemetry  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
