"""All core queries and the SQL that says the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("reports", "model", "graphs", "conversions", "formats", "integrity", "streams")


def _parts():
    return [importlib.import_module(f"sightline.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable]:
    return {name: f for part in _parts() for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _parts() for name, sql in part.SQL.items()}
