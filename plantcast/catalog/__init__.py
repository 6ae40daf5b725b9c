"""Registered queries and the SQL they are checked against."""

from importlib import import_module

from plantcast.catalog.registry import ORACLES, QUERIES

MODULES = ("tables", "analysis", "decisions", "models", "streams")


def _load() -> None:
    for name in MODULES:
        import_module(f"plantcast.catalog.{name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
