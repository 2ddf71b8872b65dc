"""Scenario queries over the driver's tables, one module per operator family."""

from __future__ import annotations

import importlib
import pkgutil


def _load() -> None:
    for info in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{info.name}")


def all_queries() -> dict:
    _load()
    from scenarios.base import QUERIES

    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    from scenarios.base import ORACLES

    return dict(ORACLES)
