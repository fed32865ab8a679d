"""All registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ["portfolio_queries", "history_queries", "sequence_queries", "tape_queries", "model_queries"]


def _collect(attr: str) -> dict:
    out = {}
    for m in MODULES:
        for name, value in getattr(import_module(f"verification.{m}"), attr).items():
            if name in out:
                raise ValueError(f"query {name} is registered twice")
            out[name] = value
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
