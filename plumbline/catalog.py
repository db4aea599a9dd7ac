"""All registered queries of the library and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from plumbline import plans
from plumbline.registry import REGISTRY, Program


def _load() -> None:
    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"plumbline.plans.{module.name}")


def queries() -> dict[str, Program]:
    _load()
    return {name: q.program for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}


def coverage() -> dict[str, list[str]]:
    """The queries that cover each operator id of the survey."""
    _load()
    out: dict[str, list[str]] = {}
    for q in REGISTRY.values():
        for i in q.covers:
            out.setdefault(i, []).append(q.name)
    return dict(sorted(out.items()))
