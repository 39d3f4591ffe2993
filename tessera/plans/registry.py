"""Imports every query module so the catalog is complete."""

from __future__ import annotations

import functools
import importlib

from ..session import ship_package
from .catalog import ORACLES, QUERIES

_MODULES = ["billing_queries", "chunk_queries", "finance_queries", "moderation_queries", "message_queries", "chat_queries", "retrieval_queries", "source_queries", "stream_queries",
            "index_queries"]

for _m in _MODULES:
    importlib.import_module(f"{__package__}.{_m}")


def _shipping(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)
    return run


def queries():
    """Catalog callables; each first makes the package importable on executors."""
    return {name: _shipping(fn) for name, fn in QUERIES.items()}


def oracle_sql():
    return dict(ORACLES)
