"""Queries over the driver tables, with their reference SQL."""

from __future__ import annotations

import importlib
import pkgutil

from tessera.bindings.base import ORACLE, QUERIES


def _load() -> None:
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLE)
