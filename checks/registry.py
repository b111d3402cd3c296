"""All registered queries and their SQL twins."""

from __future__ import annotations

import importlib

GROUPS = ["ingest", "retrieval", "pages", "chat", "learning", "catalog"]


def _collect(attribute: str) -> dict:
    out: dict = {}
    for group in GROUPS:
        part = getattr(importlib.import_module(f"checks.{group}"), attribute)
        repeated = set(out) & set(part)
        if repeated:
            raise ValueError(f"registered twice: {repeated}")
        out.update(part)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
