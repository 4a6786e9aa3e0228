"""Registered queries over the given tables."""

from __future__ import annotations

import importlib
import pkgutil

from flowloom.queries import registry


def load():
    """(queries, oracles) of every module in this package."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return registry.QUERIES, registry.ORACLES
