"""All registered queries of the core."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> tuple[dict, dict]:
    """Import every module of plans and return copies of the registered queries and their SQL."""
    from treeline.plans import registry

    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
