"""Registered queries over the given tables and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ["q_core", "q_files", "q_schema", "q_plans", "q_report"]


def _load() -> None:
    for m in MODULES:
        import_module(f"lintlake.suite.{m}")


def all_queries() -> dict:
    from lintlake.suite.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_twins() -> dict[str, str]:
    from lintlake.suite.registry import TWINS

    _load()
    return dict(TWINS)
