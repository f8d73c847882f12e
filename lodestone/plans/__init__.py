"""Queries bound to the shared tables."""

from __future__ import annotations

import importlib
import pkgutil

from lodestone.plans.registry import QUERIES, BoundQuery


def all_queries() -> dict[str, BoundQuery]:
    """Every registered query; importing the ``*_queries`` modules registers them."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
    return QUERIES
