"""Registered queries: every operator over the shared tables, with its SQL statement."""

from __future__ import annotations

import importlib.util

from tickloom.catalog.registry import Query, all_queries

GROUPS = (
    "ingest", "lake", "rolling", "recursive", "features", "signals", "joins", "screeners",
    "pairs", "labels", "liquidity", "portfolio", "learning", "live", "user",
)


def load() -> dict[str, Query]:
    for g in GROUPS:
        if importlib.util.find_spec(f"tickloom.catalog.{g}"):
            importlib.import_module(f"tickloom.catalog.{g}")
    return all_queries()
