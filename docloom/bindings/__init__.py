"""Bindings of the driver tables to the corpus jobs."""

import importlib

_MODULES = ("catalog_reports", "catalog_text", "catalog_retrieval", "catalog_governance", "catalog_answers")


def load_catalog() -> tuple[dict, dict]:
    """(queries, oracle SQL) of every catalog module."""
    for name in _MODULES:
        importlib.import_module(f"docloom.bindings.{name}")
    from docloom.bindings.registry import ORACLES, QUERIES
    return dict(QUERIES), dict(ORACLES)
