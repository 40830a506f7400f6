"""Operators of a training-data pipeline. Nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib

MODULES = ("line_dedup", "suffix_dedup", "jaccard", "mixing", "packing", "warc", "ann", "quality", "token_counts", "secrets")


def _gather(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"{__name__}.{module}"), name)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
