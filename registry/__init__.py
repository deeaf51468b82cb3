"""Queries over the test tables, each with its DuckDB equivalent."""

from __future__ import annotations

from importlib import import_module

from registry.core import ORACLES, QUERIES

for _part in ("sources", "columns", "sampling", "metrics", "models", "reports"):
    import_module(f"registry.{_part}")

__all__ = ["ORACLES", "QUERIES"]
