"""All registered queries."""

from __future__ import annotations

import importlib

from answerloom.catalog.registry import REGISTRY, Entry

MODULES = (
    "tables", "alignment", "profiles", "grading", "votes", "sequences", "rollouts",
    "boards", "vectors", "training", "storage", "live",
)


def load() -> dict[str, Entry]:
    for module in MODULES:
        importlib.import_module(f"answerloom.catalog.{module}")
    return REGISTRY
