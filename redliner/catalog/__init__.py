"""Registered queries: each pairs a DataFrame job over the shared tables with the same result in SQL."""

from __future__ import annotations

import importlib

MODULES = ("access", "ingest", "titleblocks", "integrity", "claims", "codekb", "measure", "rules", "review", "learning", "operations", "streams")


def load():
    from redliner.catalog.base import REGISTRY

    for name in MODULES:
        importlib.import_module(f"redliner.catalog.{name}")
    return REGISTRY
