"""All registered queries and their check SQL."""

from __future__ import annotations

import importlib

_GROUPS = ("text", "tables", "retrieval", "indexes", "streams", "audit", "evaluation", "scenarios")


def _collect(prefix: str, name: str) -> dict:
    found: dict = {}
    for g in _GROUPS:
        found.update(getattr(importlib.import_module(f"dossier.plans.{prefix}_{g}"), name))
    return found


def queries() -> dict:
    return _collect("catalog", "QUERIES")


def oracles() -> dict:
    return _collect("sql", "ORACLES")
