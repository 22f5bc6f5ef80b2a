"""Registered queries."""

import importlib

_MODULES = ("graph", "records", "selection", "text")


def load_all() -> None:
    """Import every module that registers queries."""
    for name in _MODULES:
        importlib.import_module(f"lectern.plans.{name}")
