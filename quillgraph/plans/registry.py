"""All registered queries of the engine and their SQL equivalents."""

from __future__ import annotations

import importlib

FLAGSHIP = "rank_candidates"
_MODULES = ("scoring", "citing", "graphs", "reporting", "reasoning", "texts", "numeric", "feeds", "writing", "storage")


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in importlib.import_module(f"quillgraph.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in importlib.import_module(f"quillgraph.plans.{m}").ORACLES.items()}
