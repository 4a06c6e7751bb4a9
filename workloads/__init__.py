"""Queries over the given tables that exercise every operator of the library."""

from importlib import import_module

MODULES = ("sequences", "events", "accounts", "identifiers", "undo", "health", "io", "payloads", "streams")


def load_all() -> None:
    """Import every query module, which registers its queries."""
    for name in MODULES:
        import_module(f"workloads.{name}")
