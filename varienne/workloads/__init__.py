"""Queries over the provided tables, each with the SQL that checks it."""

from importlib import import_module

MODULES = ("scans", "aggregates", "sensitivity", "surrogates", "screening", "storage", "waves")


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
