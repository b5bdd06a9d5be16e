"""The queries of this subpackage, one module for each operator."""

from __future__ import annotations

import importlib

MODULES = (
    "op1_quality",
    "op2_mix",
    "op3_language",
    "op4_fingerprint",
    "op5_toxicity",
    "op6_simhash",
    "op7_secrets",
    "op8_suffix",
    "op9_topk",
    "op10_bpe",
)


def _modules() -> list:
    return [importlib.import_module(f"siltlog.llm.{name}") for name in MODULES]


def queries() -> dict:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.ORACLE_SQL for m in _modules() if m.ORACLE_SQL}
