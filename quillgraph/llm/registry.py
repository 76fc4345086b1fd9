"""The queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

_MODULES = ("pii", "language", "secrets", "licenses", "neighbours", "fingerprints", "neardup", "quality", "tokenizer", "packing")


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in importlib.import_module(f"quillgraph.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in importlib.import_module(f"quillgraph.llm.{m}").ORACLES.items()}
