"""Registered queries and the SQL that checks them."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> dict:
    """All registered queries by name."""
    from barlab.catalog.registry import REGISTRY

    for mod in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{mod.name}")
    return dict(REGISTRY)
