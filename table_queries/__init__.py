"""Queries over the test tables."""

from importlib import import_module

MODULES = ("bursts", "captures", "store", "model", "prompts", "streams")


def load():
    """Import every query module and return the registry."""
    for name in MODULES:
        import_module(f"table_queries.{name}")
    return import_module("table_queries.registry")
