"""Queries over the given tables, each with its oracle where SQL can express it."""

from __future__ import annotations

import importlib
import pkgutil

from .registry import ORACLES, QUERIES


def _load() -> None:
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    _load()
    return dict(ORACLES)
