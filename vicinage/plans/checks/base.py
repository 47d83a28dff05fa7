"""Registry of checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..views import Tables, with_views


@dataclass(frozen=True)
class Check:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None):
    """Register a query; without SQL only its rows are looked at (and a unit test pins its values)."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in CHECKS:
            raise ValueError(f"check {name} registered twice")
        CHECKS[name] = Check(name, fn, with_views(sql) if sql else None)
        return fn
    return register
