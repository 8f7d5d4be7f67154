"""DuckDB SQL for the registered queries."""

from __future__ import annotations

import importlib

MODULES = ("institute", "people", "portfolio", "checks", "insight", "exchange", "clusterings")


def statements() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= importlib.import_module(f"oracles.{name}").SQL
    return found
