"""Registered queries: one Spark builder and one DuckDB oracle text per key.

Each area module exports ``QUERIES`` (key -> (spark, sf_dir) -> DataFrame)
and ``ORACLE`` (key -> SQL over the driver's tables). Keys without an oracle
get the driver's rows-only check and a brute-force test in ``tests/``.
"""

from __future__ import annotations

import importlib

AREAS = ["evaluation", "cleaning", "statistics", "examples", "catalog", "io", "profile"]


def all_queries() -> dict:
    out: dict = {}
    for a in AREAS:
        out.update(importlib.import_module(f"quarry.plans.{a}").QUERIES)
    return out


def all_oracles() -> dict:
    out: dict = {}
    for a in AREAS:
        out.update(importlib.import_module(f"quarry.plans.{a}").ORACLE)
    return out
