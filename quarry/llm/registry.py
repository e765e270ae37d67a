"""The registered queries of this subpackage and their DuckDB twins.

Each module listed here exposes ``QUERIES`` (name -> callable(spark, sf_dir))
and ``ORACLE`` (name -> SQL; absent where SQL cannot express the operator).
"""

from __future__ import annotations

import importlib

MODULES = [
    "quarry.llm.mixing",
    "quarry.llm.secrets",
    "quarry.llm.lm_score",
    "quarry.llm.lang_id",
    "quarry.llm.chat_format",
    "quarry.llm.topk_search",
    "quarry.llm.decontaminate",
    "quarry.llm.licenses",
    "quarry.llm.suffix_dedup",
    "quarry.llm.ngram_join",
    "quarry.llm.toxicity",
    "quarry.llm.whitening",
    "quarry.llm.negatives",
]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(importlib.import_module(m), attribute))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")
