"""Registered queries over the driver tables, each with its DuckDB twin.

Each plan module exposes ``QUERIES`` (name -> callable(spark, sf_dir)) and
``ORACLE`` (name -> SQL).  A name missing from ``ORACLE`` is checked on rows
only (iterative / random / streaming operators).
"""

from __future__ import annotations

import importlib

MODULES = [
    "quarry.plans.sparse",
    "quarry.plans.dense_plans",
    "quarry.plans.hybrid_plans",
    "quarry.plans.tree_plans",
    "quarry.plans.eval_plans",
    "quarry.plans.ingest_plans",
    "quarry.plans.index_plans",
    "quarry.plans.stream_plans",
    "quarry.plans.route_plans",
    "quarry.plans.structured_plans",
    "quarry.plans.source_plans",
]


def _mods():
    return [importlib.import_module(m) for m in MODULES]


def all_queries():
    out = {}
    for m in _mods():
        out.update(m.QUERIES)
    return out


def all_oracle_sql():
    out = {}
    for m in _mods():
        out.update(m.ORACLE)
    return out
