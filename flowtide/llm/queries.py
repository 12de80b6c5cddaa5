"""The registered queries of the corpus operators: each takes (spark, sf_dir) and covers its whole tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = (
    "q_bpe", "q_brown", "q_decontaminate", "q_html", "q_importance", "q_lattice", "q_lines", "q_passages", "q_simhash", "q_toxicity",
    "q_strings", "q_trie", "q_whitening",
)

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable) -> Callable:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"flowtide.llm.{module}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
