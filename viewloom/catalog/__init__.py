"""Named queries on the driver's tables."""

from __future__ import annotations

import importlib
from types import ModuleType

_GROUPS = ("views", "epochs", "cameras", "captions", "embeds", "planes", "points", "logs", "files")


def load() -> ModuleType:
    """Imports every query module; returns the registry."""
    for name in _GROUPS:
        importlib.import_module(f"viewloom.catalog.{name}")
    return importlib.import_module("viewloom.catalog.base")
