"""Registered whole-table jobs."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

_MODULES = ["text_queries", "payload_queries", "graph_queries", "change_queries"]


def _load() -> None:
    for name in _MODULES:
        import_module("pagegraph.plans." + name)


def all_queries() -> dict[str, Callable]:
    _load()
    from pagegraph.plans.registry import QUERIES

    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    from pagegraph.plans.registry import ORACLES

    return dict(ORACLES)
