"""Every operator as a query over the driver's tables, with the SQL another engine answers it by."""

from __future__ import annotations

from importlib import import_module

from .base import CHECKS, Check

MODULES = ["filters", "ranking", "aggregates", "text", "places", "spatial", "towns", "personal", "feeds", "sinks", "quality",
           "streams", "routes", "sqlfunctions"]


def all_checks() -> dict[str, Check]:
    for module in MODULES:
        import_module(f"{__name__}.{module}")
    return dict(CHECKS)
